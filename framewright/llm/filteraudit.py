"""Interaction of filters: what each one removes in every order of applying them.

Documents become rows of a failure mask. Each partition packs them into NumPy bitsets, one a filter and one a label,
laid out part by part in whole bytes; AND-NOT and a popcount give what a filter removes after each subset of the others,
and the partitions' counts are summed. Orders and Shapley sums follow from the subsets: an order's step is what its
filter removes after the set of those before it.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm import textkit as tk
from framewright.llm.common import Workspace

# The filters, and when a text fails one of the first four.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
DUPLICATE = 1 << FILTERS.index("E")
GOOD, TOXIC = 1, 2
PARTS = 4096  # parts whose counts a task holds before it hands them on


def text_failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mask of A to D of every row."""
    n = len(offsets) - 1
    starts, ends, rows = tk.runs(~tk.is_space(data), offsets)
    h = tk.hashes(data, starts, ends)
    order = np.lexsort((h, rows))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    words, distinct = np.bincount(rows, minlength=n), np.bincount(rows[order][new], minlength=n)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    failed = [
        words < LEAST_WORDS,
        100 * distinct < DISTINCT_PERCENT * words,
        100 * tk.per_row((data >= 65) & (data <= 90), offsets) > UPPER_PERCENT * tk.per_row((data & 0xC0) != 0x80, offsets),
        tk.per_row(symbol[data], offsets) > 0,
    ]
    return sum(f.astype(np.int32) << i for i, f in enumerate(failed))


def _masks(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part, fails (the mask of A to D) and a digest of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tk.pieces(batch, "text"):
                data, offsets = tk.raw(piece.column("text"))
                view, at = memoryview(data), offsets.tolist()
                digests = [hashlib.sha256(view[a:b]).digest() for a, b in itertools.pairwise(at)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": piece.column("doc_id"), "part": piece.column("part").fill_null(""), "fails": pa.array(text_failures(data, offsets), pa.int32()), "digest": pa.array(digests, pa.binary())}
                )

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, fails int, digest binary"
    return docs.select("doc_id", F.col(part).cast("string").alias("part"), "text").mapInArrow(run, kind)


def document_masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per document: part, fails (the mask of FILTERS, A the lowest bit), marks (GOOD, TOXIC).

    Texts are read once; copies are found by digest: the least doc_id of each digest that has several, joined back.
    """
    work = Workspace(docs.sparkSession, "filteraudit")
    rows = work.keep(_masks(docs, part))
    same = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    marks = F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(marks.alias("marks")).where("marks > 0")
    # both are written, so that a join can split a document's or text's rows without a final aggregation in between
    same, known = work.keep(same), work.keep(known)
    found = rows.join(same, "digest", "left").join(known, "doc_id", "left")
    fails = F.col("fails").bitwiseOR(F.when(F.col("doc_id") > F.col("least"), DUPLICATE).otherwise(0))
    return found.select("part", fails.alias("fails"), F.coalesce("marks", F.lit(0)).cast("int").alias("marks"))


def bitsets(codes: np.ndarray, n_parts: int, masks: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first byte of each part, and the packed bitset of each mask: a part's rows begin at a whole byte.

    Every part has a row.
    """
    order = np.argsort(codes, kind="stable")
    sizes = np.bincount(codes, minlength=n_parts)
    width = (sizes + 7) // 8
    first = np.cumsum(width) - width
    rank = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(first * 8, sizes) + rank
    out = []
    for mask in masks:
        bits = np.zeros(int(width.sum()) * 8, bool)
        bits[at] = mask[order]
        out.append(np.packbits(bits))
    return first, out


def subset_counts(codes: np.ndarray, n_parts: int, fails: np.ndarray, marks: np.ndarray, k: int) -> np.ndarray:
    """(part, subset, filter, 4): what filter keeps, removes, and removes of good and of toxic rows, after the subset.

    Zeros where the subset holds the filter.
    """
    ones = np.ones(len(codes), bool)
    first, found = bitsets(codes, n_parts, [ones, (marks & GOOD) > 0, (marks & TOXIC) > 0, *[(fails >> i & 1) > 0 for i in range(k)]])
    every, good, toxic, *filters = found
    count = lambda bits: np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first)
    union = [np.zeros_like(every)]
    for subset in range(1, 1 << k):
        low = (subset & -subset).bit_length() - 1
        union.append(union[subset & (subset - 1)] | filters[low])
    out = np.zeros((n_parts, 1 << k, k, 4), np.int64)
    for subset in range(1 << k):
        for f in range(k):
            if not subset >> f & 1:
                removed = filters[f] & ~union[subset]
                for i, bits in enumerate((every & ~union[subset | 1 << f], removed, removed & good, removed & toxic)):
                    out[:, subset, f, i] = count(bits)
    return out


def _orders(k: int, names: str) -> list[tuple[str, int, int, int]]:
    """(order, step, mask of the filters before it, its filter) of every order of the filters."""
    return [("".join(names[f] for f in order), i + 1, sum(1 << g for g in order[:i]), f) for order in itertools.permutations(range(k)) for i, f in enumerate(order)]


def audit(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """For each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    masks has part, fails (bit i: fails filter i of names) and marks, as of document_masks. A part's rows may lie in any
    partitions, and its share of all rows doesn't matter. An empty table gives an empty result.
    """
    k = len(names)
    pairs = [(s, f) for s in range(1 << k) for f in range(k) if not s >> f & 1]

    def rows(parts: list[str], counts: list[np.ndarray]) -> pa.RecordBatch:
        table = np.stack(counts)[:, [s for s, _ in pairs], [f for _, f in pairs]].reshape(-1, 4)
        columns = {
            "part": pa.array(np.repeat(np.array(parts, object), len(pairs)), pa.string()),
            "before": pa.array(np.tile([s for s, _ in pairs], len(parts)), pa.int32()),
            "filter": pa.array(np.tile([f for _, f in pairs], len(parts)), pa.int32()),
        }
        return pa.RecordBatch.from_pydict(columns | {c: pa.array(table[:, i], pa.int64()) for i, c in enumerate(("kept", "removed", "good_lost", "toxic_lost"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").dictionary_encode()
            found = subset_counts(part.indices.to_numpy(), len(part.dictionary), batch.column("fails").to_numpy(), batch.column("marks").to_numpy(), k)
            for name, own in zip(part.dictionary.to_pylist(), found, strict=True):
                sums[name] = sums[name] + own if name in sums else own
            if len(sums) > PARTS:
                yield rows(list(sums), list(sums.values()))
                sums = {}
        if sums:
            yield rows(list(sums), list(sums.values()))

    counts = ("kept", "removed", "good_lost", "toxic_lost")
    kind = "part string, before int, filter int, " + ", ".join(f"{c} long" for c in counts)
    total = masks.mapInArrow(run, kind).groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in counts])
    own = Window.partitionBy("part", "filter")  # one row a subset of the others
    orders_of = F.element_at(F.array(*[F.lit(math.factorial(i) * math.factorial(k - 1 - i)) for i in range(k)]), F.bit_count("before") + 1)
    others = F.lit((1 << k) - 1) - F.call_function("shiftleft", F.lit(1), F.col("filter"))
    total = total.withColumns(
        {
            "fails": F.sum(F.when(F.col("before") == 0, F.col("removed"))).over(own),
            "unique_fails": F.sum(F.when(F.col("before") == others, F.col("removed"))).over(own),
            "shapley": F.sum(F.col("removed") * orders_of).over(own),
        }
    )
    orders = masks.sparkSession.createDataFrame(_orders(k, names), "filter_order string, step int, before int, filter int")  # k * k! rows
    out = total.join(F.broadcast(orders), ["before", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit() of the five fixed filters over whole texts, by source.

    docs has doc_id, source and text, labels doc_id, quality and toxic; other columns aren't read, whatever their names.
    A NULL text is an empty one: it fails A, and E where a smaller doc_id has an empty or NULL text. A NULL doc_id
    neither fails E nor makes another fail; a NULL source is the part of the empty string. Rows that repeat count each,
    and those of one doc_id aren't smaller than each other. A document's labels are good or toxic if any of its rows in
    labels says so. Very long texts are read whole, one at a time. Without documents there are no parts and no rows.
    """
    return audit(document_masks(docs, labels))
