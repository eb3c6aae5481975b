"""Approximate nearest neighbours by multiprobe p-stable hashing with exact reranking.

Each of TABLES tables hashes a vector by FUNCTIONS functions floor((a v + b) / WIDTH), a being normally distributed. A
query visits, in each table, the PROBES buckets that most likely hold near vectors: perturbations of its own bucket in
rising order of the summed squared distances to the cell borders that they cross (Lv et al., Multi-probe LSH, 2007).
The sets of perturbations are drawn once, in the order of their expected sums, and each query picks and orders its own
among them, in array steps.

Rows go to their buckets once a table, as they are stored (floats stay floats); probes of buckets that hold no row are
dropped before they carry a vector. In a bucket the queries come first and the rows stream past them, so a bucket of
any size is held by its queries only; the few buckets with more than one in HUBS of all entries are split into parts.
Distances are exact; a task keeps the best rows of each query over all its buckets, and table candidates are merged per
query at the end. Queries whose probes found too few rows are compared with all rows, in blocks.

Every row is indexed, but of exact copies of a vector only the count + 1 of smallest id: no other can be among a
query's nearest. Recall depends on the distances, not on the number of rows, so the parameters are the same for every
size; they are arguments of search(), as structured vectors do with fewer and smaller buckets: settings() measures some on
a bounded sample of the vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm import linear
from framewright.llm.common import Workspace
from framewright.llm.components import HUBS

TABLES, FUNCTIONS, WIDTH, PROBES = 4, 8, 3.0, 50
PART, HELD, BLOCK = 128, 1 << 20, 1000
# Functions, width and probes that settings() measures.
CHOICES = [(k, width, number) for k in (6, 8, 12, 16) for width in (1.0, 2.0, 3.0) for number in (20, 50)]
SAMPLE_ROWS, SAMPLE_QUERIES = 4000, 100  # distinct vectors that settings() measures on at most


class Hashing:
    """The functions of all tables for one dimension; scale is the median length of the vectors."""

    def __init__(self, dimension: int, functions: int, width: float, scale: float):
        rng = np.random.default_rng([64, dimension])
        self.k, self.scale, self.width, self.salt = functions, scale, width, np.int64(dimension)
        self.a = rng.normal(size=(dimension, TABLES * functions))
        self.b = rng.random(TABLES * functions) * width
        mix = np.random.default_rng(65).integers(1, 1 << 62, TABLES * functions, dtype=np.int64)
        self.mix = (mix * 2 + 1).reshape(TABLES, functions)

    def project(self, v: np.ndarray) -> np.ndarray:
        return ((v / self.scale) @ self.a + self.b).reshape(len(v), TABLES, self.k) / self.width

    def codes(self, cells: np.ndarray, table: int) -> np.ndarray:
        """64-bit bucket codes of cells (..., function) of a table; vectors of another dimension have others."""
        with np.errstate(over="ignore"):
            h = (cells.astype(np.int64) * self.mix[table]).sum(axis=-1) + self.salt * np.int64(0x2545F4914F6CDD1D)
            return (h ^ (h >> 31)) * np.int64(0x5851F42D4C957F2D)


@lru_cache(8)
def perturbations(k: int, number: int) -> np.ndarray:
    """The likeliest number sets of places among a query's 2 k sorted border distances, one row each, the empty set first.

    The j-th smallest squared distance, to k, is expected at j (j + 1) / (4 (k + 1) (k + 2)); the same function's other
    border is then the j-th from the end, 1 - j / (k + 1) more. A set never crosses both borders of a function.
    """
    j = np.arange(1, k + 1, dtype=float)
    low = j * (j + 1) / (4 * (k + 1) * (k + 2))
    z = np.concatenate((low, (1 - j / (k + 1) + low)[::-1]))
    out, heap = [()], [(z[0], (0,))]
    while heap and len(out) < number:
        s, chosen = heapq.heappop(heap)
        if not any(2 * k - 1 - i in chosen for i in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (s - z[last] + z[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (s + z[last + 1], (*chosen, last + 1)))
    rows = np.zeros((len(out), 2 * k))
    for i, chosen in enumerate(out):
        rows[i, list(chosen)] = 1
    return rows


def probes(x: np.ndarray, count: int) -> np.ndarray:
    """Moves (-1, 0 or 1 a function) to the count likeliest buckets, likeliest first; x has the places within the cells."""
    k = len(x)
    score = np.concatenate((x**2, (1 - x) ** 2))
    order = np.argsort(score, kind="stable")
    sets = perturbations(k, 4 * count)
    crossed = np.zeros((2 * k, 2 * k))
    crossed[np.arange(2 * k), order] = 1  # place among the sorted distances -> border
    borders = sets @ crossed
    valid = (borders[:, :k] + borders[:, k:]).max(axis=1) <= 1
    borders, sums = borders[valid], (sets[valid] @ score[order])
    best = np.argsort(sums, kind="stable")[:count]
    return borders[best, k:] - borders[best, :k]


def _groups(column: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) of the vectors of each length in a binary column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        if len(rows) == len(sizes):
            flat = data[offsets[0] : offsets[-1]]
        else:
            flat = data[(offsets[rows][:, None] + np.arange(size)).ravel()]
        yield rows, np.frombuffer(flat.tobytes(), kind).reshape(len(rows), -1).astype(np.float64)


def _distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, a few queries at a time."""
    out = np.empty((len(q), len(v)))
    step = max(1, (1 << 21) // max(v.size, 1))
    for lo in range(0, len(q), step):
        d = q[lo : lo + step, None, :] - v[None]
        out[lo : lo + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


class Best:
    """The count nearest rows of each query so far, with ties to the smaller id, as parallel arrays."""

    def __init__(self, count: int):
        self.count, self.parts, self.size = count, [], 0

    def add(self, queries: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        """Distances of some queries and rows; whatever is no farther than a query's count-th here is kept."""
        d = np.where(queries[:, None] == ids[None], np.inf, d)
        if len(ids) > self.count:
            keep = d <= np.partition(d, self.count - 1, axis=1)[:, self.count - 1 : self.count]
        else:
            keep = np.ones(d.shape, bool)
        i, j = np.nonzero(keep & np.isfinite(d))
        self.parts.append((queries[i], ids[j], d[i, j]))
        self.size += len(i)
        if self.size > HELD:
            self.parts = [self.best()]
            self.size = len(self.parts[0][0])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, ids, d = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((ids, d, q))
        q, ids, d = q[order], ids[order], d[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, d = q[new], ids[new], d[new]
        begin = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        keep = rank < self.count
        return q[keep], ids[keep], d[keep]

    def batch(self) -> pa.RecordBatch:
        q, ids, d = self.best()
        return pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(d, pa.float64())})


def _usable(table: DataFrame, kind: str) -> DataFrame:
    """vec_id and v (the components as bytes) of the rows whose vector is neither NULL nor zero and all finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            flat = column.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(kind)
            sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
            bad, some = np.concatenate(([0], np.cumsum(~np.isfinite(values)))), np.concatenate(([0], np.cumsum(values != 0)))
            good = (bad[offsets[1:]] == bad[offsets[:-1]]) & (some[offsets[1:]] > some[offsets[:-1]]) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            width = values.dtype.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer((offsets * width).tobytes()), pa.py_buffer(values.tobytes())])
            keep = pa.array(good)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id").filter(keep), "v": packed.filter(keep).cast(pa.binary())})

    return table.select("vec_id", "embedding").mapInArrow(run, "vec_id long, v binary")


def _merged(found: DataFrame, count: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= count)


def measured(v: np.ndarray, count: int = 10, choices: list[tuple[int, float, int]] | None = None) -> list[tuple[float, float, tuple[int, float, int]]]:
    """(share of rows that become candidates, recall, choice) of each choice, the first SAMPLE_QUERIES of the rows asking."""
    asked = min(len(v), SAMPLE_QUERIES)
    if len(v) < 2:
        return [(1.0, 1.0, c) for c in choices or CHOICES]
    own = np.arange(asked)
    d = _distances(v[:asked], v)
    d[own, own] = np.inf
    nearest = np.argsort(d, axis=1, kind="stable")[:, : min(count, len(v) - 1)]
    scale = float(np.median(np.linalg.norm(v, axis=1)))
    out = []
    for functions, width, number in choices or CHOICES:
        h = Hashing(v.shape[1], functions, width, scale)
        places = h.project(v)
        cells = np.floor(places)
        reached = np.zeros((asked, len(v)), bool)
        for t in range(TABLES):
            codes = h.codes(cells[:, t], t)
            for i in range(asked):
                reached[i] |= np.isin(codes, h.codes(cells[i, t] + probes(places[i, t] - cells[i, t], number), t))
        recall = float(np.take_along_axis(reached, nearest, axis=1).mean())
        reached[own, own] = False
        out.append((float(reached.sum() / (asked * (len(v) - 1))), recall, (functions, width, number)))
    return out


def settings(table: DataFrame, recall: float = 0.95, count: int = 10) -> dict[str, float]:
    """functions, width and number for search(): the choice with the fewest candidates that reaches recall on a sample.

    The sample has SAMPLE_ROWS distinct vectors at most, by hash of their bytes, whatever the table's size, and is
    measured in one task. Its nearest rows are farther off than the whole table's, so that recall there is rather
    higher. If no choice reaches recall, that of the highest one is taken. Of several dimensions the most frequent one
    of the sample is measured. Unusable vectors and NULL ids take no part, repeated ones count once; of a table without
    two usable vectors the first choice is taken; other columns are not read, whatever their names.
    """
    kind = "<f4" if table.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    sample = _usable(table, kind).select("v").distinct().withColumn("h", F.xxhash64("v")).orderBy("h", "v").limit(SAMPLE_ROWS).select("h", "v")

    def choose(rows: list[tuple]) -> tuple[int, float, int]:
        groups = [v for _, v in _groups(pa.array([v for _, v in rows], pa.binary()), kind)]
        found = measured(max(groups, key=len) if groups else np.zeros((0, 1)), count)
        enough = [x for x in found if x[1] >= recall]
        return min(enough)[2] if enough else max(found, key=lambda x: (x[1], -x[0]))[2]

    return dict(zip(("functions", "width", "number"), linear.fitted(sample, choose), strict=True))


def search(table: DataFrame, every: int = 100, count: int = 10, functions: int = FUNCTIONS, width: float = WIDTH, number: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the count nearest rows found for each row whose vec_id is divisible by every.

    table has vec_id and embedding. Rows whose vector is NULL, empty, zero, or has NULL or non-finite components take
    no part, nor do those whose vec_id is NULL; vectors of another dimension than the query's are no candidates. Of
    rows at the same distance those of smaller vec_id come first. Rows that repeat a vec_id with its vector count once; of
    a query's vectors that differ the least by its bytes asks;
    an empty table gives an empty result; other columns are not read, whatever their names. A query always gets count
    rows, or all others of its dimension if there are fewer.
    """
    spark = table.sparkSession
    work = Workspace(spark, "neighbours")
    kind = "<f4" if table.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    rows = work.keep(_usable(table, kind).select("vec_id", "v").distinct())  # repeated rows meet in their tasks first
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(BLOCK).collect()  # bounded, for the scale only
    scale = float(np.median([np.linalg.norm(np.frombuffer(r.v, kind).astype(float)) for r in sample])) if sample else 1.0
    copies = Window.partitionBy("v").orderBy("vec_id")
    candidates = work.keep(rows.withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= count + 1).select("vec_id", "v"))
    queries = work.keep(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).repartition(partitions, "vec_id"))
    work.drop(rows)
    made: dict[int, Hashing] = {}

    def hashing(dimension: int) -> Hashing:
        if dimension not in made:
            made[dimension] = Hashing(dimension, functions, width, scale)
        return made[dimension]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                codes = np.zeros((TABLES, part.num_rows), np.int64)
                for own, v in _groups(part.column("v"), kind):
                    h = hashing(v.shape[1])
                    cells = np.floor(h.project(v))
                    for t in range(TABLES):
                        codes[t, own] = h.codes(cells[:, t], t)
                for t in range(TABLES):
                    yield pa.RecordBatch.from_pydict({"t": pa.array(np.full(part.num_rows, t, np.int32)), "bucket": pa.array(codes[t]), "id": part.column("vec_id"), "v": part.column("v")})

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for own, v in _groups(batch.column("v"), kind):
                h = hashing(v.shape[1])
                places = h.project(v)
                cells = np.floor(places)
                for t in range(TABLES):
                    codes, whose = [], []
                    for i, query in enumerate(ids[own].tolist()):
                        moves = probes(places[i, t] - cells[i, t], number)
                        codes.append(h.codes(cells[i, t] + moves, t))
                        whose.append(np.full(len(moves), query, np.int64))
                    whole = np.concatenate(codes)
                    yield pa.RecordBatch.from_pydict({"t": pa.array(np.full(len(whole), t, np.int32)), "bucket": pa.array(whole), "id": pa.array(np.concatenate(whose))})

    indexed = candidates.mapInArrow(index, "t int, bucket long, id long, v binary")
    counts = work.keep(indexed.groupBy("t", "bucket").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    crowded = counts.where(F.col("n") > max(total / HUBS, PART)).select("t", "bucket", F.ceil(F.col("n") / PART).cast("int").alias("parts"))  # less than HUBS buckets
    crowded = F.broadcast(crowded)
    part = F.coalesce(F.pmod(F.xxhash64("id"), "parts").cast("int"), F.lit(0)).alias("part")
    placed = indexed.join(crowded, ["t", "bucket"], "left").select("t", "bucket", part, F.lit(1).alias("kind"), "id", "v")
    wanted = queries.mapInArrow(probing, "t int, bucket long, id long").distinct()
    met = wanted.join(counts.hint("merge"), ["t", "bucket"], "left_semi").join(crowded, ["t", "bucket"], "left")
    met = met.select("t", "bucket", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(0).alias("kind"), "id")
    met = met.hint("merge").join(queries.withColumnRenamed("vec_id", "id").hint("merge"), "id").select("t", "bucket", "part", "kind", "id", "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key, asked = Best(count), None, {}
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("t", "bucket", "part", "kind")], axis=1)
            ids, v = batch.column("id").to_numpy(), batch.column("v")
            begin = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))).tolist() if len(keys) else []
            for lo, hi in zip(begin, [*begin[1:], len(keys)], strict=False):
                here = tuple(keys[lo, :3].tolist())
                if here != key:
                    key, asked = here, {}
                if keys[lo, 3] == 1 and not asked:
                    continue
                for own, vectors in _groups(v.slice(lo, hi - lo), kind):
                    whose, size = ids[lo:hi][own], vectors.shape[1]
                    if keys[lo, 3] == 0:  # a bucket's queries come before its rows, perhaps in two batches
                        before = asked.get(size)
                        asked[size] = (whose, vectors) if before is None else (np.concatenate((before[0], whose)), np.concatenate((before[1], vectors)))
                    elif size in asked:
                        best.add(asked[size][0], whose, _distances(asked[size][1], vectors))
        yield best.batch()

    result = "query_id long, vec_id long, score double"
    spread = placed.unionByName(met).repartition(partitions, "t", "bucket", "part").sortWithinPartitions("t", "bucket", "part", "kind", "id")
    found = work.keep(_merged(spread.mapInArrow(meet, result), count))
    short = queries.join(found.where(F.col("rank") == count).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    left = work.keep(short.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))))
    extra, lows = None, left.count()
    for b in range(-(-lows // BLOCK)):  # none, unless probes found fewer than count rows for some query
        step = (1 << 20) / -(-lows // BLOCK)
        chosen = left.where((F.col("block") >= int(b * step)) & (F.col("block") < int((b + 1) * step))).collect()  # some BLOCK queries
        asked = spark.sparkContext.broadcast([(r.vec_id, bytes(r.v)) for r in chosen])

        def scan(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            best = Best(count)
            ids, column = np.array([q for q, _ in asked.value], np.int64), pa.array([v for _, v in asked.value], pa.binary())
            wanted = {v.shape[1]: (ids[own], v) for own, v in _groups(column, kind)}
            for batch in batches:
                for own, v in _groups(batch.column("v"), kind):
                    if v.shape[1] in wanted:
                        q, matrix = wanted[v.shape[1]]
                        best.add(q, batch.column("vec_id").to_numpy()[own], _distances(matrix, v))
            yield best.batch()

        part = work.keep(_merged(candidates.mapInArrow(scan, result), count))
        extra = part if extra is None else extra.unionByName(part)
    if extra is not None:
        found = found.join(left.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(extra)
    out = work.keep(found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    work.keep_only(out)
    return out
