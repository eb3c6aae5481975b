"""Toxicity: a subsequence string kernel, a support vector machine on Nystroem landmarks, and whole-text scoring.

The kernel compares words by their subsequences of three characters within a span of five, a gap costing a factor
DECAY a character; gapped or padded insults keep most of their subsequences. Values are normalised: each word is divided
by the root of its kernel value with itself, in which a subsequence that occurs several times counts by the square of
its summed weights. Landmarks are words of the labelled sample; the machine is linear in the Nystroem
features K(x, landmarks) K(landmarks, landmarks)^-1/2. As the kernel is an explicit sum over subsequences, the fitted
machine is one weight for each of the 64^3 possible ones, and a word costs six lookups a character, whatever the
number of landmarks. A document's labels stand for some word in it: the fit alternates between choosing the highest
word of each toxic document and separating these words from the words of clean documents. A document scores as
its two highest words, calibrated: toxic texts rarely hold one insult alone, and a clean one may resemble one by
chance. Runs of single-character words count as one word, so that spaced-out words are compared too. Each distinct word
of a batch is compared once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import linear
from framewright.llm import textkit as tk

DECAY = 0.6
SPAN = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
LANDMARKS = 256
ROUNDS = 5
PRIOR = 0.4  # share of toxic documents for which the probability is calibrated
LEAST_ODDS = np.log(7.0)  # of a word among the first guesses
FEATURES = 1 << 18
CHUNK = 1 << 16  # bytes of words that are compared at once


def _codes() -> np.ndarray:
    """A code below 64 for each byte: letters apart, digits together, the bytes of other scripts by their low bits."""
    out = np.zeros(256, np.int32)
    out[97:123] = np.arange(1, 27)
    out[65:91] = np.arange(1, 27)
    out[48:58] = 27
    out[128:] = 32 + (np.arange(128) & 31)
    return out


CODES = _codes()


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes without white space, and start, end and row of each word in them; runs of single characters join."""
    inside = ~tk.is_space(data)
    starts, ends, rows = tk.runs(inside, offsets)
    if not len(starts):
        return data[:0], starts, ends, rows
    kept = np.concatenate((np.zeros(1, np.int64), np.cumsum(inside)))
    short = (ends - starts) == 1
    joined = np.zeros(len(starts), bool)
    joined[1:] = short[1:] & short[:-1] & (rows[1:] == rows[:-1])
    first = np.flatnonzero(~joined)
    last = np.append(first[1:] - 1, len(starts) - 1)
    return data[inside], kept[starts[first]], kept[ends[last]], rows[first]


def occurrences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: int | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """(weight, subsequence, word) of all three-character subsequences (that start before a place), for each pattern of gaps."""
    code = CODES[data]
    word = np.repeat(np.arange(len(starts)), ends - starts)
    room = np.repeat(ends, ends - starts) - np.arange(len(data))
    for a, b in SPAN:
        at = np.flatnonzero(room[:before] > b)
        yield DECAY ** (b - 2), (code[at] << 12) | (code[at + a] << 6) | code[at + b], word[at]


def subsequences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, summed weight) of the distinct subsequences of each word, by word and subsequence."""
    found = list(occurrences(data, starts, ends))
    key = np.concatenate([word * FEATURES + sub for _, sub, word in found])
    weight = np.concatenate([np.full(len(sub), w) for w, sub, _ in found])
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight[order], begin) if len(begin) else np.zeros(0)
    return key[begin] // FEATURES, key[begin] % FEATURES, total


def norms(word: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Root of each word's kernel value with itself, 1 at least."""
    return np.sqrt(np.maximum(np.bincount(word, weights=weight * weight, minlength=n), 1.0))


def raw_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The machine's value for each word, without bias; start to end are all of data, one after the other.

    Words go in runs of at most CHUNK bytes, so that memory is bounded; a longer word's subsequences are summed by
    slices into one dense row.
    """
    out = np.zeros(len(starts))
    lo = 0
    while lo < len(starts):
        hi = max(int(np.searchsorted(ends, starts[lo] + CHUNK, side="right")), lo + 1)
        own = data[starts[lo] : ends[hi - 1]]
        if len(own) > CHUNK:
            row = np.zeros(FEATURES)
            for at in range(0, len(own), CHUNK):
                part = own[at : at + CHUNK + SPAN[-1][1]]  # patterns that start in the slice may end behind it
                for weight, sub, _ in occurrences(part, np.zeros(1, np.int64), np.array([len(part)]), CHUNK):
                    row += weight * np.bincount(sub, minlength=FEATURES)
            out[lo] = row @ table / np.sqrt(max(row @ row, 1.0))
        else:
            word, sub, weight = subsequences(own, starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo])
            out[lo:hi] = np.bincount(word, weights=weight * table[sub], minlength=hi - lo) / norms(word, weight, hi - lo)
        lo = hi
    return out


def kernel(words: tuple, used: np.ndarray, landmarks: np.ndarray, step: int = 500) -> np.ndarray:
    """Kernel values of words against landmarks, whose rows are dense over the subsequences in used."""
    place = np.full(FEATURES, -1, np.int32)
    place[used] = np.arange(len(used))
    dense = np.ascontiguousarray(landmarks.T, dtype=np.float32)
    data, starts, ends = words
    out = np.zeros((len(starts), len(landmarks)))
    for lo in range(0, len(starts), step):
        s, e = starts[lo : lo + step], ends[lo : lo + step]
        word, sub, weight = subsequences(data[s[0] : e[-1]], s - s[0], e - s[0])
        norm = norms(word, weight, len(s))
        at = place[sub]
        ok = at >= 0
        word, at, weight = word[ok], at[ok], weight[ok]
        if len(word):
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[lo + word[begin]] = np.add.reduceat(dense[at] * weight[:, None].astype(np.float32), begin)
        out[lo : lo + step] /= norm[:, None]
    return out


def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    return np.frombuffer(b"".join(words), np.uint8), ends - lengths, ends


def explicit(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences that the words have, and their normalised weights: one dense row a word."""
    word, sub, weight = subsequences(*spell(words))
    used, at = np.unique(sub, return_inverse=True)
    out = np.zeros((len(words), len(used)), np.float32)
    out[word, at] = weight / norms(word, weight, len(words))[word]
    return used, out


def padded(words: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """Each word with a mark inserted or a letter repeated, so that the fit meets padded insults too."""
    out = []
    for w in words:
        i = int(rng.integers(1, max(len(w), 2)))
        out.append(w[:i] + (w[i - 1 : i] if rng.random() < 0.5 else rng.choice([b"-", b".", b"*", b"_"])) + w[i:])
    return out


def machine(z: np.ndarray, y: np.ndarray, steps: int = 50, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, classes balanced, by Newton steps.

    Within a set of rows that miss the margin the loss is quadratic; a step solves for its least, halved until the loss
    falls, and steps end once that set stays the same.
    """
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    x = np.hstack((z, np.ones((len(z), 1))))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        slack = np.maximum(0, 1 - y * (x @ w))
        return 0.5 * decay * w @ w + (weight * slack * slack).sum(), slack > 0

    w = np.zeros(x.shape[1])
    now, missed = loss(w)
    for _ in range(steps):
        own, scaled = x[missed], x[missed] * (2 * weight[missed])[:, None]
        move = np.linalg.solve(scaled.T @ own + decay * np.eye(len(w)), scaled.T @ y[missed]) - w
        size = 1.0
        after, still = loss(w + move)
        while after > now and size > 1e-6:
            size /= 2
            after, still = loss(w + size * move)
        if after > now:
            break
        w, same = w + size * move, size == 1.0 and np.array_equal(still, missed)
        now, missed = after, still
        if same:
            break
    return w[:-1], w[-1]


@dataclass
class Model:
    table: np.ndarray
    a: float
    b: float
    floor: float  # the value of a text without words

    def word_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """raw_scores(), each distinct word compared once."""
        _, first, which = np.unique(tk.hashes(data, starts, ends), return_index=True, return_inverse=True)
        lengths = (ends - starts)[first]
        close = np.cumsum(lengths)
        take = np.repeat(starts[first] - (close - lengths), lengths) + np.arange(close[-1] if len(close) else 0)
        return raw_scores(data[take], close - lengths, close, self.table)[which]

    def document_scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean of a text's two highest words, or its only word's value."""
        text, starts, ends, rows = words_of(data, offsets)
        out = np.full(len(offsets) - 1, self.floor)
        if len(starts):
            value = self.word_scores(text, starts, ends)
            begin = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            first = np.maximum.reduceat(value, begin)
            top = np.flatnonzero(value == np.repeat(first, np.diff(np.append(begin, len(rows)))))
            value[top[np.unique(rows[top], return_index=True)[1]]] = -np.inf
            second = np.maximum.reduceat(value, begin)
            out[rows[begin]] = np.where(np.isfinite(second), (first + second) / 2, first)
        return out

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return linear.sigmoid(self.a * self.document_scores(data, offsets) + self.b)


def fit(sample: list[tuple[int, int, str]], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model:
    """The model of (doc_id, label, text) rows; without both classes it calls no text toxic."""
    y = np.array([x[1] for x in sample], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(FEATURES, np.float32), 0.0, -5.0, -1.0)
    held = np.array([zlib.crc32(str(x[0]).encode()) % 5 == 1 for x in sample])
    if min((y[held] == c).sum() for c in (0, 1)) == 0 or min((y[~held] == c).sum() for c in (0, 1)) == 0:
        held = np.zeros(len(y), bool)
    # distinct words, and the distinct (word, document) pairs
    data, offsets = tk.raw(pa.array([x[2] for x in sample], pa.string()))
    text, starts, ends, rows = words_of(tk.lower_ascii(data), offsets)
    h = tk.hashes(text, starts, ends)
    _, first, word = np.unique(h, return_index=True, return_inverse=True)
    lengths = (ends - starts)[first]
    pair = np.unique(word.astype(np.int64) * len(sample) + rows)
    pw, pd = pair // len(sample), pair % len(sample)
    fitted = ~held[pd] & (lengths[pw] >= 3)
    pw, pd = pw[fitted], pd[fitted]
    spelled = text.tobytes()
    strings = [spelled[starts[i] : ends[i]] for i in first.tolist()]
    n1, n0 = max((y[~held] == 1).sum(), 1), max((y[~held] == 0).sum(), 1)
    df1 = np.bincount(pw, weights=y[pd], minlength=len(first)) / n1
    df0 = np.bincount(pw, weights=1 - y[pd], minlength=len(first)) / n0
    value = np.log((df1 + 1 / min(n1, n0)) / (df0 + 1 / min(n1, n0)))  # the first guess: how much oftener toxic documents hold the word
    odds = value
    order = np.argsort(-value * (df1 > 0), kind="stable")
    rng = np.random.default_rng(11)
    clean = np.flatnonzero(df0 > 0)
    clean = rng.choice(clean, min(len(clean), 20 * landmarks), replace=False)
    all_words = spell(strings)
    table = np.zeros(FEATURES, np.float32)

    def top(docs_label: int, k: int, value: np.ndarray) -> np.ndarray:
        """The k highest words of each document of one class."""
        own = y[pd] == docs_label
        w, d = pw[own], pd[own]
        o = np.lexsort((w, -value[w], d))
        d = d[o]
        begin = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        at = (begin[:, None] + np.arange(k)).ravel()
        at = at[at < len(d)]
        keep = d[at] == np.repeat(d[begin], k)[: len(at)]
        return w[o[at[keep]]]

    marks = np.unique(np.concatenate((order[: landmarks // 2], rng.choice(clean, min(len(clean), landmarks // 2), replace=False))))
    positive = seen = np.zeros(0, np.int64)
    for turn in range(rounds):
        # the highest words by the machine so far, and those by the first guess that the machine doesn't contradict
        guess = top(1, 3, odds)
        guess = guess[(odds[guess] >= LEAST_ODDS) & (value[guess] > 0)]
        positive = np.concatenate((top(1, 1, value), guess))
        if turn:
            hard = np.unique(top(0, 1, value))
            good, often = np.unique(positive, return_counts=True)
            good = good[np.argsort(-often, kind="stable")][: landmarks // 2]
            marks = np.unique(np.concatenate((good, rng.choice(hard, min(len(hard), landmarks // 4), replace=False), rng.choice(clean, min(len(clean), landmarks // 4), replace=False))))
        used, phi = explicit([strings[i] for i in marks.tolist()])
        values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
        ok = values > 1e-6 * values[-1]
        root = vectors[:, ok] / np.sqrt(values[ok])
        seen = np.concatenate((seen, np.unique(top(0, 3, value))))  # of all rounds, so that none comes back
        negative = np.concatenate((seen, clean))
        chosen = np.concatenate((positive, negative))
        more = padded([strings[i] for i in positive.tolist()], rng) if turn else []
        z = kernel(spell([strings[i] for i in chosen.tolist()] + more), used, phi) @ root
        w, _ = machine(z, np.concatenate((np.ones(len(positive)), -np.ones(len(negative)), np.ones(len(more)))))
        table[:] = 0
        table[used] = (root @ w) @ phi
        value = raw_scores(*all_words, table)
    floor = float(value.min()) if len(value) else -1.0
    model = Model(table, 1.0, 0.0, floor)
    chosen = held if held.any() else ~held
    s = model.document_scores(*tk.raw(pa.array([x[2] for x, k in zip(sample, chosen, strict=True) if k], pa.string())))
    model.a, model.b = linear.platt(s, y[chosen], PRIOR)
    return model


def held_out(doc_id) -> F.Column:
    """The documents that no label is learnt from: crc32 of doc_id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def model_for(docs: DataFrame, labels: DataFrame) -> Model:
    """Fitted on a bounded sample of the labelled rows that aren't held out."""
    return linear.fitted(linear.labelled_sample(docs, labels.where(~held_out(F.col("doc_id"))), "toxic"), fit)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    docs has doc_id and text; NULL and empty texts and texts without words get the score of the least toxic word.
    Texts of any length are scored whole, a long one alone, in some 100 bytes of memory a byte; of words that tie for a text's highest one is its second. A NULL doc_id is scored and isn't held out. Repeated
    rows are scored one by one; an empty table gives an empty result; other columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 64^3 weights, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in tk.pieces(batch, "text"):
                p = m.probability(*tk.raw(part.column("text")))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score() doesn't predict as toxic, with all their columns, whatever their names.

    NULL, empty and wordless texts stay; texts of any length are scored whole; a score of 0.5 goes; repeated rows go or
    stay together; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return tk.passing(docs, lambda data, offsets: shared.value.probability(data, offsets) < 0.5)
