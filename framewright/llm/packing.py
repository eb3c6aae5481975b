"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bulk-synchronous best fit. Documents are range-sorted by length (one distributed sort, ties by document, so that a
third of all rows of one length spreads over many partitions) and so get a rank among the pieces of their length.
Gaps are kept sorted by size too. As lengths and gaps are whole numbers up to the sequence length, equal gaps are
interchangeable: both sides are kept as runs (size, number), which loses nothing and is bounded by the sequence length,
not by the corpus. Each round takes the longest length that is left: all its pieces are matched at once with the
smallest gaps that hold them (the successor of the length among the gap sizes), conflicts between pieces go by rank
(the k-th piece takes the k-th gap of a run), gaps shrink and join the run of their new size, and the next round
follows. The rounds yield a table of runs (length, first rank, sequence, step, offset), by which every piece finds its
place without another shuffle.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import Workspace

SEQUENCE = 1024
END_ID = 2
SPECIAL = "<|endoftext|>"
LONGEST_BLANK = 10_000
BLANK = re.compile(rf"\s{{{LONGEST_BLANK}}}")
KEPT = ["doc_id", "piece", "start", "length", "ids_crc32"]
KIND = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of a byte-level tokenizer file, by the faster of two libraries that share its vocabulary.

    Texts with the file's special token, with characters for which the libraries' letter classes may differ, or with
    more than LONGEST_BLANK characters of white space on end, over which the faster one's pattern would recurse, are
    encoded by the file's own library.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        from framewright.llm.wordpiece import byte_symbols

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        table = byte_symbols()
        ranks = {bytes(table[c] for c in piece): i for piece, i in vocabulary.items() if piece != SPECIAL}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.path = path

    @cached_property
    def exact(self):
        """The file's own library, loaded by the workers that meet a text for it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if text.isascii() or max(text) < "ɐ":  # Latin letters, the same in every Unicode version
            if SPECIAL not in text and not (len(text) > LONGEST_BLANK and BLANK.search(text)):
                return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. The first piece of a long document is the short one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(enc.ids(text or ""), np.array([END_ID], "<u4"))
                    raw, n = ids.tobytes(), len(ids)
                    first = n % sequence or sequence
                    cuts = [0, *range(first, n + 1, sequence)] if n > sequence else [0, n]
                    out += [(doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                doc, piece, start, length, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, KIND)


@dataclass
class Gaps:
    """Runs of equal gaps, by size: a run is (number, first sequence, sequences apart are 1)."""

    runs: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    sizes: list[int] = field(default_factory=list)

    def add(self, size: int, number: int, first: int) -> None:
        if size and number:
            if size not in self.runs:
                bisect.insort(self.sizes, size)
            self.runs[size].append((number, first))

    def take(self, at_least: int, number: int) -> tuple[int, int, int] | None:
        """(size, number, first sequence) of a run of the smallest gaps that hold at_least."""
        i = bisect.bisect_left(self.sizes, at_least)
        if i == len(self.sizes):
            return None
        size = self.sizes[i]
        have, first = self.runs[size].pop()
        if have > number:
            self.runs[size].append((have - number, first + number))
        elif not self.runs[size]:
            del self.runs[size]
            self.sizes.pop(i)
        return size, min(have, number), first


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int]]:
    """Runs (length, first rank, first sequence, offset): rank r of the run lies in sequence first + r - first rank."""
    gaps, out, used = Gaps(), [], 0
    for length in sorted(histogram, reverse=True):  # a round for each length, the longest first
        rank, left = 0, histogram[length]
        while left:
            found = gaps.take(length, left)
            if found is None:  # new sequences, as many as hold the rest of this length
                per = sequence // length
                number = -(-left // per)
                found = (sequence, number, used)
                used += number
            size, number, first = found
            number_here = min(number, left)
            out.append((length, rank, first, sequence - size))
            rank, left = rank + number_here, left - number_here
            gaps.add(size - length, number_here, first)
            gaps.add(size, number - number_here, first + number_here)
    return out


def ranked(cut: DataFrame, partitions: int) -> DataFrame:
    """The pieces range-sorted by falling length, each with its partition and its rank among the pieces of its length there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            length = batch.column("length").to_numpy()
            begin = np.flatnonzero(np.concatenate(([True], length[1:] != length[:-1])))
            rank = np.arange(len(length))
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(length)], strict=True):
                size = int(length[lo])
                rank[lo:hi] += seen[size] - lo
                seen[size] += hi - lo
            columns = {c: batch.column(c) for c in KEPT}
            yield pa.RecordBatch.from_pydict(columns | {"part": pa.array(np.full(len(length), part, np.int32)), "rank": pa.array(rank, pa.int64())})

    cut = cut.withColumn("salt", F.monotonically_increasing_id())  # tells repeated rows apart
    order = [F.desc("length"), F.col("doc_id"), F.col("piece"), F.col("salt")]
    ordered = cut.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return ordered.drop("salt").mapInArrow(run, f"{KIND}, part int, rank long")


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs has doc_id and text. A NULL text is an empty one, whose only id is the closing one; texts of any length, and
    of any characters, are cut whole, a worker holding one text's ids at a time; pieces of equal length are placed in
    the order of doc_id and piece; a NULL doc_id is as good as another; repeated rows are packed each for itself; an
    empty table gives an empty result; other columns are not read, whatever their names. Pieces of the sequence's
    length fill one each. path is a tokenizer file on every worker.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    cut = work.keep(pieces(docs, path, sequence))  # kept first: sampling the ranges would tokenise every text once more
    ordered = work.keep(ranked(cut, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)))
    work.drop(cut)
    # at most one row for each length, and one more for each partition, as the partitions are ranges of length
    counts = ordered.groupBy("part", "length").agg(F.count("*").alias("n")).collect()
    histogram: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in sorted(counts, key=lambda r: r.part):
        before[r.part, r.length] = histogram.get(r.length, 0)
        histogram[r.length] = histogram.get(r.length, 0) + r.n
    by_length = defaultdict(list)
    for length, rank, first, offset in plan(histogram, sequence):
        by_length[length].append((rank, first, offset))
    table = {length: tuple(np.array(x, np.int64) for x in zip(*own, strict=True)) for length, own in by_length.items()}
    shared = spark.sparkContext.broadcast((table, before))  # bounded by lengths and partitions, not by rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, earlier = shared.value
        for batch in batches:
            key = batch.column("part").to_numpy().astype(np.int64) * (sequence + 1) + batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            order = np.argsort(key, kind="stable")
            begin = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))).tolist() if len(key) else []
            sequence_id, offset = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            for lo, hi in zip(begin, [*begin[1:], len(key)], strict=False):
                own = order[lo:hi]
                part, size = divmod(int(key[own[0]]), sequence + 1)
                r = rank[own] + earlier[part, size]
                ranks, first, at = places[size]
                i = np.searchsorted(ranks, r, side="right") - 1
                sequence_id[own] = first[i] + r - ranks[i]
                offset[own] = at[i]
            columns = {c: batch.column(c) for c in KEPT}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(sequence_id), "offset": pa.array(offset)})

    return ordered.mapInArrow(place, f"{KIND}, sequence_id long, offset long")
