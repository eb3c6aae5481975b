"""Vectorised text primitives over the raw UTF-8 bytes of an Arrow string column.

A batch of texts is one byte array plus offsets; words, lines and n-grams come from array operations over all bytes,
with no Python loop per character or word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
ODD = U64(0x9E3779B97F4A7C15)
_MUL = 0xD6E8FEB86659FD93
_INV = pow(_MUL, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
_table = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of at most limit bytes of text (a longer single row stands alone)."""
    lengths = pc.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its rows; NULL rows are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of True bytes that stays within one row."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    before = np.concatenate(([False], inside[:-1])) if n else inside
    starts = np.flatnonzero(inside & (~before | first))
    last = np.zeros(n + 1, bool)
    last[offsets[1:]] = True
    after = np.concatenate((inside[1:], [False])) if n else inside
    ends = np.flatnonzero(inside & (~after | last[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _power(name: str, base: int, n: int) -> np.ndarray:
    found = _powers.get(name)
    if found is None or len(found) < n:
        with np.errstate(over="ignore"):
            found = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(n, (1 << 20) + 1), base, np.uint64))))
        if n <= (1 << 20) + 1:
            _powers[name] = found
    return found[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: a polynomial hash of the bytes' random codes, by differences of prefix sums."""
    n = len(data)
    if not n:
        return np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_table[data] * _power("up", _MUL, n))))
        return mix((sums[ends] - sums[starts]) * _power("down", _INV, n + 1)[starts] + (ends - starts).astype(np.uint64))


def windows(h: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of size consecutive words of one row, and the index of its first word."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        for i in range(size):
            out = out * U64(_MUL) + h[at + i]
    return mix(out), at


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a value per byte over each row."""
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def passing(docs, test):
    """The rows of a DataFrame, all columns, whose text passes: test gets bytes and offsets and returns a mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield part.filter(pa.array(test(*raw(part.column("text")))))

    return docs.mapInArrow(run, docs.schema)
