"""Quality rules: exact base rules, then a calibrated logistic regression on hashed word and character n-grams.

The model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS per class, linear.SAMPLE_BYTES a text);
a hashed fifth of the sample is left out of the fit and calibrates the probability. Every text is then scored whole,
in Arrow batches, against fixed thresholds. No shuffle: the documents are read once more than the sample is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framewright.llm import linear
from framewright.llm import textkit as tk

BITS = 16
SAMPLE_ROWS = 1000  # labelled rows a class at most
LEAST_WORDS = 10
REPEAT_PERCENT = 20
THRESHOLD = 0.1  # rejects only what is clearly poor
SYMBOLS = b"#*$%&|<>"


@dataclass
class Model:
    weights: np.ndarray  # (sizes, buckets)
    a: float
    b: float

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return linear.sigmoid(self.a * linear.scores(data, offsets, self.weights, BITS) + self.b)


def fit(sample: list[tuple[int, int, str]], prior: float = 0.5) -> Model:
    """The model of (doc_id, label, text) rows; without both classes it passes every text."""
    y = np.array([x[1] for x in sample], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros((3, 1 << BITS), np.float32), 0.0, 20.0)
    held = np.array([zlib.crc32(str(x[0]).encode()) % 5 == 1 for x in sample])
    if min((y[~held] == c).sum() for c in (0, 1)) == 0 or min((y[held] == c).sum() for c in (0, 1)) == 0:
        held = np.zeros(len(y), bool)
    texts = [x[2] for x in sample]
    w, _ = linear.fit([t for t, h in zip(texts, held, strict=True) if not h], y[~held], 2, BITS)
    weights = (w[:, :, 1] - w[:, :, 0]).astype(np.float32)
    chosen = held if held.any() else ~held
    s = linear.scores(*tk.raw(pa.array([t for t, h in zip(texts, chosen, strict=True) if h], pa.string())), weights, BITS)
    return Model(weights, *linear.platt(s, y[chosen], prior))


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every row."""
    n = len(offsets) - 1
    inside = ~tk.is_space(data)
    starts, ends, rows = tk.runs(inside, offsets)
    h = tk.hashes(data, starts, ends)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    # lines with a word: the pieces between line breaks that hold a byte of a word
    ls, le, lr = tk.runs(data != 10, offsets)
    words_before = np.concatenate((np.zeros(1, np.int64), np.cumsum(inside)))
    full = words_before[le] > words_before[ls]
    ls, le, lr = ls[full], le[full], lr[full]
    lines = tk.hashes(data, ls, le)
    order = np.lexsort((lines, lr))
    new = np.ones(len(order), bool)
    new[1:] = (lines[order][1:] != lines[order][:-1]) | (lr[order][1:] != lr[order][:-1])
    dup = np.bincount(lr, minlength=n) - np.bincount(lr[order][new], minlength=n)
    wh, at = tk.windows(h, rows, 5)
    with np.errstate(over="ignore"):
        key = wh + rows[at].astype(np.uint64) * tk.ODD
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    cover = np.zeros(len(h) + 6, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 5, -1)
    covered = np.cumsum(cover)[: len(h)] > 0
    return {
        "n_words": np.bincount(rows, minlength=n),
        "word_chars": tk.per_row(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": tk.per_row(symbol[data], offsets),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(rows[covered], minlength=n),
    }


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * base["n_words"])


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, the five base counts, base_failed, quality (the probability), kept.

    docs has doc_id and text. A NULL text is an empty one: no words, base_failed, not kept. Texts of any length are
    judged whole, a long one alone, in some 150 bytes of memory a byte; a probability at the threshold is kept; a NULL
    doc_id is as good as another. Repeated rows are judged one by one, an empty table gives an empty result, other
    columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets * sizes floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in tk.pieces(batch, "text"):
                data, offsets = tk.raw(part.column("text"))
                base = base_counts(data, offsets)
                failed = base_failed(base)
                p = m.probability(data, offsets)
                columns = {"doc_id": part.column("doc_id"), **{k: pa.array(v, pa.int64()) for k, v in base.items()}}
                columns |= {"base_failed": pa.array(failed), "quality": pa.array(p), "kept": pa.array(~failed & (p >= threshold))}
                yield pa.RecordBatch.from_pydict(columns)

    kind = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def model_for(docs: DataFrame, labels: DataFrame) -> Model:
    """Fitted on the labelled rows of docs."""
    return linear.fitted(linear.labelled_sample(docs, labels, "quality", SAMPLE_ROWS), fit)


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever their names.

    NULL, empty and wordless texts go, as they fail the base rules; texts of any length are judged whole; repeated rows
    go or stay together; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return ~base_failed(base_counts(data, offsets)) & (shared.value.probability(data, offsets) >= threshold)

    return tk.passing(docs, good)
