"""Secrets in texts: three fixed patterns, and strings that look random to character Markov models.

Two chains of characters, one of random strings and one of ordinary identifiers, are trained from labelled samples: what
the fixed patterns match in a bounded sample of documents, with strings drawn from the usual alphabets of keys, is
random; every other word of the sample is ordinary. A long run of key characters that no pattern covers is a secret if
its mean log-likelihood ratio is above a threshold. Texts are read once, in Arrow batches; a regular expression in C++
finds the rows that need a closer look, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from framewright.llm import linear
from framewright.llm import textkit as tk

# The kinds in their order, their patterns, and the least length of what must match.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
LEAST_RANDOM = 20  # characters of a run that the models judge
THRESHOLD = 0.5  # mean log-likelihood ratio a character
SAMPLE_ROWS = 2000  # documents that the models are trained on, at most
DRAWN = 400  # strings drawn from each alphabet
# The alphabets of keys.
KEY_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64])
#: Rows that may hold a match; a superset, as these expressions fold the cases of all scripts.
MAYBE = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_=-]{20}"""

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end; in code points


def base_spans(text: str) -> list[Span]:
    """The matches of the fixed patterns, leftmost and without overlap within a kind, in their order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found)


def uncovered(text: str, spans: list[Span], least: int) -> Iterator[re.Match]:
    """Maximal runs of key characters, of least characters or more, that overlap none of the sorted spans."""
    at, reached = 0, 0
    for m in RUN.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reached = max(reached, spans[at][2])
            at += 1
        if m.end() - m.start() >= least and reached <= m.start():
            yield m


def _codes(string: str) -> np.ndarray:
    """The places of characters in ALPHABET; its length for a line break, which stands before a first character."""
    table = np.full(128, len(ALPHABET), np.int64)
    table[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
    return table[np.frombuffer(string.encode("ascii"), np.uint8)]


@dataclass
class Models:
    """The log-likelihood ratio of each character after each other; the last row is that of a first character."""

    ratio: np.ndarray

    def score(self, string: str) -> float:
        own = _codes("\n" + string)
        return float(self.ratio[own[:-1], own[1:]].mean())


def chain(strings: list[str], smoothing: float = 0.5) -> np.ndarray:
    """Log probabilities of a first-order chain; the last row is the start's."""
    n = len(ALPHABET)
    own = _codes("\n" + "\n".join(strings))
    count = np.bincount(own[:-1] * (n + 1) + own[1:], minlength=(n + 1) ** 2).reshape(n + 1, n + 1)[:, :n] + smoothing
    return np.log(count / count.sum(axis=1, keepdims=True))


def drawn(seed: int = 12) -> list[str]:
    """Random strings of 20 to 44 characters over each alphabet of keys."""
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(a), rng.integers(20, 45))) for a in KEY_ALPHABETS for _ in range(DRAWN)]


def train(texts: list[str]) -> Models:
    """The models of a sample of texts; without an ordinary word nothing is told apart and no run is a secret."""
    random, ordinary = drawn(), []
    for text in texts:
        spans = base_spans(text)
        random += [x for start, _, end in spans for x in RUN.findall(text[start:end])[-1:]]
        ordinary += [m.group() for m in uncovered(text, spans, 1)]
    if not ordinary:
        return Models(np.zeros((len(ALPHABET) + 1, len(ALPHABET))))
    return Models(chain(random) - chain(ordinary))


def model_for(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = linear.SAMPLE_BYTES) -> Models:
    """Trained on at most rows documents of at most size bytes, one text a doc_id, in the order of a hash of doc_id."""
    return linear.fitted(linear.bounded_texts(docs, rows, size), lambda sample: train([text for _, text in sample]))


def all_spans(text: str, models: Models, threshold: float = THRESHOLD) -> list[Span]:
    """The base spans and those that the models add."""
    spans = base_spans(text)
    return sorted(spans + [(m.start(), 3, m.end()) for m in uncovered(text, spans, LEAST_RANDOM) if models.score(m.group()) > threshold])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, models: Models, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    docs has doc_id and text. spans are kind:start:end in code points, end exclusive, by start and kind, joined by
    commas; those of the models are of kind random and overlap no base span. A NULL text is an empty one, without spans;
    its hash is that of the empty string. Very long texts are scanned whole, one at a time. Repeated rows are scanned one
    by one, a NULL doc_id is as good as another, an empty table gives an empty result, other columns aren't read,
    whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # one table of characters by characters
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.pieces(batch, "text"):
                text = part.column("text").fill_null("")
                rows = np.flatnonzero(pc.match_substring_regex(text, MAYBE).to_numpy(zero_copy_only=False))
                counts = np.zeros((3, part.num_rows), np.int64)
                hashes, spans = [none] * part.num_rows, [""] * part.num_rows
                for i in rows.tolist():
                    found = all_spans(text[i].as_py(), shared.value, threshold)
                    base = [s for s in found if s[1] < 3]
                    for _, kind, _ in base:
                        counts[kind, i] += 1
                    hashes[i], spans[i] = hashlib.sha256(written(base).encode()).hexdigest(), written(found)
                columns = {"doc_id": part.column("doc_id")} | {f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS[:3], counts, strict=True)}
                yield pa.RecordBatch.from_pydict(columns | {"base_sha256": pa.array(hashes, pa.string()), "spans": pa.array(spans, pa.string())})

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, kind)
