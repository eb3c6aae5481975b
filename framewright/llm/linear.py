"""Small linear models fitted on a bounded sample: hashed n-gram logistic regression and its calibration."""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import textkit as tk

SAMPLE_ROWS = 1500  # labelled rows per class at most
SAMPLE_BYTES = 1 << 15  # longest text of a sampled row


def _bounded(docs: DataFrame, ids: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The rows of ids, each with one text, the least, of the documents of these keys of at most size bytes.

    Documents of one key meet in an aggregation, so there are no more rows than ids has.
    """
    texts = docs.where(F.octet_length("text") <= size).select(*keys, "text")
    return texts.join(F.broadcast(ids), keys).groupBy(*ids.columns).agg(F.min("text").alias("text"))


def bounded_texts(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, text of at most rows documents, by a hash of doc_id; one text a doc_id, however often it repeats."""
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return _bounded(docs, ids, ["doc_id"], size).select("doc_id", "text")


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, label, text of at most rows labelled documents of each class, in the order of a hash of doc_id.

    The sample is bounded by rows per class and by size bytes a text, both parameters, so it fits one task whatever the
    corpus's size and however often a doc_id repeats in either table: one text, the least, stands for a doc_id. A label
    is 0 or 1; other labels, NULLs and longer texts are not sampled.
    """
    ids = None
    for label in (0, 1):
        own = labels.where((F.col(target) == label) & F.col("doc_id").isNotNull()).select("doc_id", F.lit(label).alias("label")).distinct()
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        ids = own if ids is None else ids.unionByName(own)
    return _bounded(docs, ids, ["doc_id"], size).select("doc_id", "label", "text")


def domain_sample(docs: DataFrame, labels: DataFrame, names: list[str], column: str, rows: int, size: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, domain, text of at most rows labelled documents of each named domain, bounded as labelled_sample."""
    docs = docs.select("doc_id", F.col(column).alias("domain"), "text")
    keys = docs.select("doc_id", "domain").join(labels.select("doc_id").distinct(), "doc_id", "left_semi").distinct()  # reads no texts
    ids = None
    for name in names:
        part = keys.where(F.col("domain") == name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        ids = part if ids is None else ids.unionByName(part)
    return _bounded(docs, ids, ["doc_id", "domain"], size).select("doc_id", "domain", "text")


def _hand_back() -> None:
    """Gives memory that a fit has freed back to the system, where its C library can, as the worker goes on to other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def fitted(sample: DataFrame, fit_rows: Callable[[list[tuple]], object]) -> object:
    """What fit_rows makes of the sorted rows of a bounded sample, in one task; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(tuple(r.values()) for batch in batches for r in batch.to_pylist())
        model = pickle.dumps(fit_rows(rows))
        del rows
        _hand_back()
        yield pa.RecordBatch.from_pydict({"model": pa.array([model], pa.binary())})

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()  # one row
    return pickle.loads(found[0].model) if found else fit_rows([])  # a plan without any partition has no task


SIZES = ((4,), (1, 2))  # sizes of character and of word n-grams


def ngrams(data: np.ndarray, offsets: np.ndarray, bits: int, sizes: tuple = SIZES) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every hashed character n-gram (of bytes, within a row) and word n-gram, one pair per size."""
    out, (chars, words) = [], sizes
    shift = tk.U64(64 - bits)
    if words:
        starts, ends, rows = tk.runs(~tk.is_space(data), offsets)
        h = tk.hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        for n in words:
            own, at = tk.windows(h, rows, n) if n > 1 else (h, np.arange(len(h)))
            out.append((((own * tk.ODD + tk.U64(n)) >> shift).astype(np.int32), rows[at]))
        byte_rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for n in chars:
            m = len(data) - n + 1
            if m <= 0:
                out.append((np.zeros(0, np.int32), np.zeros(0, np.int64)))
                continue
            code = np.zeros(m, np.uint64)
            for i in range(n):
                code = (code << tk.U64(8)) | data[i : m + i].astype(np.uint64)
            same = byte_rows[:m] == byte_rows[n - 1 :]
            code = ((code * tk.ODD) * tk.U64(0xBF58476D1CE4E5B9)) >> shift
            out.append((code[same].astype(np.int32), byte_rows[:m][same]))
    return out


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bits: int, sizes: tuple = SIZES) -> np.ndarray:
    """For each row the sum over n-gram sizes of the mean weight of its n-grams; weights is (sizes, buckets[, classes])."""
    n = len(offsets) - 1
    total = np.zeros((n, *weights.shape[2:]))
    for w, (bucket, row) in zip(weights, ngrams(data, offsets, bits, sizes), strict=True):
        count = np.maximum(np.bincount(row, minlength=n), 1)
        if w.ndim == 1:
            total += np.bincount(row, weights=w[bucket], minlength=n) / count
        else:
            for c in range(w.shape[1]):
                total[:, c] += np.bincount(row, weights=w[bucket, c], minlength=n) / count
    return total


def features(texts: list[str], bits: int, sizes: tuple = SIZES, step: int = 100) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Per n-gram size: (row, bucket, frequency) of the distinct n-grams of each text; step texts are cut at a time."""
    found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(len(sizes[0]) + len(sizes[1]))]
    for lo in range(0, max(len(texts), 1), step):
        part = texts[lo : lo + step]
        for own, (bucket, row) in zip(found, ngrams(*tk.raw(pa.array(part, pa.string())), bits, sizes), strict=True):
            key, count = np.unique(row.astype(np.int64) << bits | bucket, return_counts=True)
            r = key >> bits
            size = np.maximum(np.bincount(r, weights=count, minlength=len(part)), 1)
            own.append(((r + lo).astype(np.int32), (key & ((1 << bits) - 1)).astype(np.int32), (count / size[r]).astype(np.float32)))
    return [tuple(np.concatenate(x) for x in zip(*own, strict=True)) for own in found]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], y: np.ndarray, classes: int, bits: int, steps: int = 60, rate: float = 40.0, decay: float = 1e-5, sizes: tuple = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by gradient steps with momentum: weights (sizes, buckets, classes) and bias (classes).

    Of two classes only the second is stepped: from 0 on, the first one's weights are its negatives.
    """
    parts = features(texts, bits, sizes)
    own = range(1, 2) if classes == 2 else range(classes)
    w = np.zeros((len(parts), len(own), 1 << bits))
    v, bias, bv = np.zeros_like(w), np.zeros(len(own)), np.zeros(len(own))
    onehot = np.eye(classes)[y][:, own]
    balance = (1 / np.maximum(np.eye(classes)[y].sum(axis=0), 1))[y][:, None] / classes
    # frequencies are small; scale each bucket by its root mean square so that rare and common n-grams learn alike
    scale, rows = [], []
    for r, b, f in parts:
        rms = np.sqrt(np.bincount(b, weights=f * f, minlength=1 << bits) / len(texts))
        scale.append(1 / (rms + 1e-4))
        rows.append(np.flatnonzero(np.diff(r, prepend=-1)))  # where each text with n-grams begins, as parts go by text
    for _ in range(steps):
        z = np.tile(bias, (len(texts), 1))
        for i, (r, b, f) in enumerate(parts):
            for c in range(len(own)):
                if len(r):
                    z[r[rows[i]], c] += np.add.reduceat(f * w[i, c][b], rows[i])
        p = softmax(np.hstack((-z, z))) if classes == 2 else softmax(z)
        g = (p[:, own] - onehot) * balance
        for i, (r, b, f) in enumerate(parts):
            for c in range(len(own)):
                grad = np.bincount(b, weights=f * g[r, c], minlength=1 << bits) * scale[i] + decay * w[i, c]
                v[i, c] = 0.9 * v[i, c] - rate * grad * scale[i] / 1e3
                w[i, c] += v[i, c]
        bv = 0.9 * bv - 0.5 * g.sum(axis=0)
        bias = bias + bv
    if classes == 2:
        w, bias = np.concatenate((-w, w), axis=1), np.concatenate((-bias, bias))
    return np.ascontiguousarray(w.transpose(0, 2, 1)), bias


def platt(s: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """a, b of the calibrated probability 1 / (1 + exp(-(a s + b))), each class weighted to the given prior of 1."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    mean, std = s.mean(), s.std() + 1e-9
    x = (s - mean) / std
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9)) / len(y)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps on the two parameters
        p = 1 / (1 + np.exp(-(a * x + b)))
        d = weight * (p - target)
        q = np.maximum(weight * p * (1 - p), 1e-12)
        h = np.array([[(q * x * x).sum() + 1e-4, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(d * x).sum() + 1e-4 * a, d.sum()]))
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a / std, b - a * mean / std


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
