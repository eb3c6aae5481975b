"""Near duplicates by HyperMinHash: compressed registers, banding, corrected estimates, and exact links.

A document's set holds its distinct word shingles, as 64-bit hashes. A signature has REGISTERS registers: the set is
dealt to them by hash and each keeps the leading zeros of its least value and the MANTISSA bits that follow (an empty
register borrows another one's, chosen by hash, so that sets of every size have the same kind of registers). BANDS
bands of ROWS registers are hashed to keys; documents that share a key are candidates.

Exact copies are one class from the start. Each candidate is first compared with its bucket's leader, the least one, by
the corrected estimate from their registers: what the leader resembles at all (loose) hangs to it. What it doesn't
resemble closely (tight) may still link with another such member of the bucket, so these hang together by the least of
them. Two members that link are at most 1 - percent apart; if one is close to the leader, the other can't be unlike it,
as distances of sets add up, so every linked pair of a bucket hangs together.

Candidates that hang together form a cluster. Links inside a cluster are found whole, yet without listing pairs: with a
common set P of the cluster (a central member, moved to what most members hold) and the difference E of each member to
P, two members x and y link if and only if

    37 * |E_x| - 3 * n_x + 37 * |E_y| - 3 * n_y  <=  74 * |E_x and E_y in common|         (for 85 percent)

Writing a for the left terms of one member, a_x + a_y <= 0 links without anything in common, so all such members hang
together through the member of least a: one comparison each. All other links need elements of E in common, and enough
of them that most members are ruled out by counting elements that members of two components hold; the rest meet through
a prefix of their rarest elements, are estimated from their registers and verified on their full differences. Where many
meet under one element they are compared with one of them first, which makes a component of each further dense family
without listing its pairs; what is listed in the end are pairs of different components only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import textkit as tk
from framewright.llm.common import Workspace, unused
from framewright.llm.components import HUBS, connected, matched

REGISTERS, BANDS, ROWS, MANTISSA = 125, 25, 5, 10
PART = 128  # members of a cluster that are handled together
PAIRS = 4  # pairs a row from which on members are compared with leaders first
TIGHT, MARGIN = 0.7, 0.25  # a close resemblance; what estimates may err by, six to eight of their standard deviations
_rng = np.random.default_rng(20)
_SEEDS = _rng.integers(1, 1 << 63, 2, dtype=np.uint64) | tk.U64(1)
_PROBES = _rng.integers(0, REGISTERS, (256, REGISTERS))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, by row and hash; a text with fewer words is one shingle."""
    data = tk.lower_ascii(data)
    starts, ends, rows = tk.runs(~tk.is_space(data), offsets)
    h = tk.hashes(data, starts, ends)
    own, at = tk.windows(h, rows, size)
    row = rows[at]
    number = np.bincount(rows, minlength=len(offsets) - 1)
    few = np.flatnonzero((number > 0) & (number < size))
    if len(few):
        first = np.searchsorted(rows, few)
        extra = np.zeros(len(few), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size - 1):
                has = number[few] > k
                extra[has] = extra[has] * tk.ODD + h[first[has] + k] + tk.U64(k + 1)
        own, row = np.concatenate((own, tk.mix(extra))), np.concatenate((row, few))
    order = np.lexsort((own, row))
    own, row = own[order], row[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    return row[new], own[new]


def _register(value: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits after the first one, in 16 bits."""
    exponent = np.frexp(value.astype(np.float64))[1].astype(np.int64)  # value < 2 ** exponent
    exponent = np.where((exponent > 0) & (value < (tk.U64(1) << np.maximum(exponent - 1, 0).astype(np.uint64))), exponent - 1, exponent)
    shift = np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64)
    return (((64 - exponent).astype(np.uint64) << tk.U64(MANTISSA)) | ((value >> shift) & tk.U64((1 << MANTISSA) - 1))).astype(np.uint16)


def signatures(own: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The registers of sets, whose shingles are dealt to them; empty ones borrow. own has the shingles set by set."""
    n, none = len(size), np.iinfo(np.uint64).max
    with np.errstate(over="ignore"):
        h = tk.mix(own * _SEEDS[0])
        value = tk.mix(h ^ _SEEDS[1])
    slot = ((h >> tk.U64(32)) * tk.U64(REGISTERS)) >> tk.U64(32)
    key = np.repeat(np.arange(n), size) * REGISTERS + slot.astype(np.int64)
    least = np.full(n * REGISTERS, none, np.uint64)
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    least[key[new]] = value[new]
    least = least.reshape(n, REGISTERS)
    filled = least.copy()
    row, register = np.nonzero((least == none) & (size > 0)[:, None])
    for probe in _PROBES:
        source = least[row, probe[register]]
        found = source != none
        filled[row[found], register[found]] = source[found]
        row, register = row[~found], register[~found]
    return _register(filled)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    own = registers[:, : BANDS * ROWS].reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(registers), 1))
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = tk.mix(out * tk.ODD + own[:, :, k])
    return out.view(np.int64)


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, corrected for registers that agree by chance in their compressed form."""
    chance = 0.72 / (1 << MANTISSA) * nx * ny / np.maximum((nx + ny).astype(np.float64) ** 2, 1)
    return ((x == y).mean(axis=1) - chance) / (1 - chance)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def sign(docs: DataFrame, size: int) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, h1 and h2 (hashes of the set), bands, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.pieces(batch, "text"):
                n = part.num_rows
                row, own = shingles(*tk.raw(part.column("text")), size)
                sizes = np.bincount(row, minlength=n)
                registers = signatures(own, sizes)
                h1, h2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                some = np.flatnonzero(sizes)
                if len(some):
                    begin = (np.cumsum(sizes) - sizes)[some]
                    h1[some] = np.add.reduceat(tk.mix(own), begin)
                    h2[some] = np.bitwise_xor.reduceat(tk.mix(own ^ tk.ODD), begin)
                raw = registers.astype("<u2").tobytes()
                width = 2 * REGISTERS
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_shingles": pa.array(sizes, pa.int64()),
                        "h1": pa.array(h1.view(np.int64)),
                        "h2": pa.array(h2.view(np.int64)),
                        "bands": _lists(band_keys(registers[some]).ravel(), BANDS * (sizes > 0), pa.int64()),
                        "registers": pa.array([raw[i * width : (i + 1) * width] for i in range(n)], pa.binary()),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, registers binary")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """rep, cluster, n, registers and the sorted set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.pieces(batch, "text"):
                row, own = shingles(*tk.raw(part.column("text")), size)
                columns = {c: part.column(c) for c in ("rep", "cluster", "part", "parts", "registers")}
                own = own.view(np.int64)
                order, sizes = np.lexsort((own, row)), np.bincount(row, minlength=part.num_rows)
                yield pa.RecordBatch.from_pydict(columns | {"n": pa.array(sizes, pa.int64()), "own": _lists(own[order], sizes, pa.int64())})

    return texts.select("rep", "cluster", "part", "parts", "registers", "text").mapInArrow(run, "rep long, cluster long, part int, parts int, registers binary, n long, own array<long>")


def _differences(sets: DataFrame, common: DataFrame) -> DataFrame:
    """rep, cluster, n, registers and e, the sorted symmetric difference of the set and its cluster's common set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                found = [np.setxor1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True) for x, y in zip(part.column("own"), part.column("common"), strict=True)]
                columns = {c: part.column(c) for c in ("rep", "cluster", "part", "parts", "n", "registers")}
                yield pa.RecordBatch.from_pydict(columns | {"e": _lists(np.concatenate(found), np.array([len(x) for x in found]), pa.int64())})

    joined = sets.join(common, ["cluster", "part"]).select("rep", "cluster", "part", "parts", "n", "registers", "own", "common")
    return joined.mapInArrow(run, "rep long, cluster long, part int, parts int, n long, registers binary, e array<long>")


def _for_parts(clusters: DataFrame) -> DataFrame:
    """clusters with a row for each of their parts: members are dealt to parts, so that a large cluster isn't one task."""
    return clusters.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).drop("parts")


def _estimated(pairs: DataFrame) -> DataFrame:
    """rep, leader, central and the estimate of their resemblance, from both registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("xr", "yr"))
            found = estimate(x, y, batch.column("xn").to_numpy(), batch.column("yn").to_numpy())
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("rep", "leader", "central")} | {"estimate": pa.array(found, pa.float64())})

    return pairs.select("rep", "leader", "central", "xn", "yn", "xr", "yr").mapInArrow(run, "rep long, leader long, central long, estimate double")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: estimated from their registers, then counted on their full differences."""
    low, high = 100 - percent, 100 + percent  # 100 (s - d) >= percent (s + d), d the symmetric difference, s both sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("xr", "yr"))
                nx, ny = part.column("xn").to_numpy(), part.column("yn").to_numpy()
                likely = estimate(x, y, nx, ny) >= percent / 100 - MARGIN
                keep = np.zeros(part.num_rows, bool)
                ex, ey = part.column("xe"), part.column("ye")
                for i in np.flatnonzero(likely).tolist():
                    d = len(np.setxor1d(ex[i].values.to_numpy(), ey[i].values.to_numpy(), assume_unique=True))
                    keep[i] = low * (nx[i] + ny[i]) >= high * d
                yield pa.RecordBatch.from_pydict({"a": part.column("a").filter(pa.array(keep)), "b": part.column("b").filter(pa.array(keep))})

    return pairs.select("a", "b", "xn", "yn", "xr", "yr", "xe", "ye").mapInArrow(run, "a long, b long")


def _meetings(e: DataFrame, lows: DataFrame, links_found: DataFrame | None, work: Workspace, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (rep, cluster, comp, a, u, s): members by the elements under which they can meet one of another component.

    The first table has members that hang to no star, the second whatever may link with one of these. Only elements that
    members of several components hold count: links are sought between components alone.
    """
    double = 2 * (100 + percent)
    place = ["cluster", "part"]
    beyond = lows.where("hub.a + most > 0").select("cluster", "hub", "parts")
    hub = F.col("hub.a")
    held = e.join(_for_parts(beyond), place).withColumn("comp", F.when(F.col("a") + hub <= 0, F.col("hub.rep")).otherwise(F.col("rep")))
    if links_found is not None:
        held = held.join(links_found, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "comp"))
    table = work.keep(held.select("rep", *place, "parts", "comp", "a", hub.alias("least")))
    items = held.select("rep", "cluster", "comp", F.explode("e").alias("s"))
    df = items.groupBy("cluster", "s").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("cluster", "s", "df")
    shared = items.drop("comp").join(df, ["cluster", "s"]).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("shared"))  # part of one set
    known = work.keep(table.join(shared, "rep").withColumn("u", F.size("shared")))
    most = known.groupBy("cluster").agg(F.max(F.lit(double) * F.col("u") - F.col("a")).alias("most"), F.first("parts").alias("parts"))
    x = known.where("a + least > 0").join(_for_parts(most), place).where((F.col("a") <= F.col("most")) & (F.lit(double) * F.col("u") >= F.col("a") + F.col("least")))
    need = x.groupBy("cluster").agg(F.min("a").alias("need"), F.first("parts").alias("parts"))
    y = known.join(_for_parts(need), place).where(F.lit(double) * F.col("u") >= F.col("a") + F.col("need"))

    def listed(side: DataFrame, other: str) -> DataFrame:
        common = F.greatest(F.ceil((F.col("a") + F.col(other)) / double).cast("int"), F.lit(1))
        prefix = F.slice("shared", F.lit(1), F.greatest(F.col("u") - common + 1, F.lit(0)))
        return work.keep(side.select("rep", "cluster", "comp", "a", "u", F.explode(prefix["s"]).alias("s")))

    met = listed(x, "least"), listed(y, "need")
    work.drop(table, known)
    return met


def _number_of_pairs(xs: DataFrame, ys: DataFrame) -> tuple[int, int]:
    """How many rows meet one of another component under one element, and how many rows there are."""
    both = xs.select("cluster", "s", "comp", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(ys.select("cluster", "s", "comp", F.lit(0).alias("x"), F.lit(1).alias("y")))
    own = both.groupBy("cluster", "s", "comp").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    of_s = own.groupBy("cluster", "s").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("inner"))
    found = of_s.agg(F.sum((F.col("x") * F.col("y") - F.col("inner")).cast("decimal(38,0)")).alias("pairs"), F.sum(F.col("x") + F.col("y")).alias("rows")).first()
    return int(found.pairs or 0), found.rows or 0


def _beyond_stars(e: DataFrame, lows: DataFrame, star: DataFrame, work: Workspace, percent: int) -> list[DataFrame]:
    """Tables of links (a, b) between members that the stars leave in different components, enough to connect all that link.

    Where many would meet under an element, as in further dense families of a cluster, all of them are first compared
    with one, the same of a family for nearly all its elements, so that families become components without listing
    their pairs. Elements that only one component holds then rule their members out. This is repeated while a fifth of
    the pairs goes each time; those left are listed and verified.
    """
    double = 2 * (100 + percent)
    side = e.select("rep", "n", "registers", "e")

    def verified(some: DataFrame) -> DataFrame:
        met = some.join(ys.withColumnRenamed("rep", "y"), ["cluster", "s"]).where((F.col("comp") != F.col("xc")) & (F.lit(double) * F.least("u", "xu") >= F.col("a") + F.col("xa")))
        met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        return work.keep(_verified(met.join(side.toDF("a", "xn", "xr", "xe"), "a").join(side.toDF("b", "yn", "yr", "ye"), "b"), percent))

    own = [F.col("rep").alias("x"), F.col("comp").alias("xc"), F.col("a").alias("xa"), F.col("u").alias("xu")]
    found: list[DataFrame] = []
    xs, ys = _meetings(e, lows, None, work, percent)
    pairs, rows = _number_of_pairs(xs, ys)
    before = 2 * pairs + 1
    while pairs > PAIRS * rows and 5 * pairs <= 4 * before:
        by = F.struct(F.xxhash64("rep", F.lit(len(found))).alias("h"), *own)
        leaders = xs.groupBy("cluster", "s").agg(F.min(by).alias("first")).select("cluster", "s", "first.*").drop("h")
        found.append(verified(leaders))
        work.drop(xs, ys)
        labels = connected(reduce(DataFrame.unionByName, found, star), work)
        xs, ys = _meetings(e, lows, labels, work, percent)
        before = pairs
        pairs, rows = _number_of_pairs(xs, ys)
    if pairs:
        found.append(verified(xs.select("cluster", "s", *own)))
    return found


def links(docs: DataFrame, reps: DataFrame, work: Workspace, size: int, percent: int) -> DataFrame:
    """Edges (a, b) between class representatives, enough to connect all that link.

    reps has rep, n, bands, registers; two representatives that share no band key count as no link.
    """
    exploded = reps.select("rep", F.explode("bands").alias("key"))
    buckets = exploded.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    hits = work.keep(exploded.join(buckets, "key"))
    side = reps.select("rep", "n", "registers")
    pairs = hits.groupBy("rep", "leader").agg(F.sum("n").alias("central")).join(side.toDF("rep", "xn", "xr"), "rep").join(side.toDF("leader", "yn", "yr"), "leader")
    met = work.keep(_estimated(pairs))  # a leader for each band of a candidate at most
    first = met.where(F.col("estimate") >= TIGHT - (1 - percent / 100) - MARGIN).select("rep", "leader", "central")
    again = hits.join(met.where(F.col("estimate") < TIGHT).select("rep", "leader"), ["rep", "leader"]).select("rep", "key")
    second = again.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    others = again.join(second, "key").select("rep", "leader", F.lit(0).cast("long").alias("central"))
    hung = first.unionByName(others).groupBy("rep").agg(F.array_sort(F.collect_set("leader")).alias("leaders"), F.sum("central").alias("central"))  # two for each band at most
    hung = work.keep(hung.select("rep", F.get("leaders", F.lit(0)).alias("top"), "leaders", "central"))
    work.drop(hits, met)
    # leaders of one document are one cluster's; documents follow their least leader
    between = connected(hung.where(F.size("leaders") > 1).select(F.explode("leaders").alias("a"), F.col("top").alias("b")), work)
    named = hung.groupBy("top").agg(F.count("*").alias("own")).join(between, F.col("top") == F.col("node"), "left").select("top", "own", F.coalesce("component", "top").alias("cluster"))
    sizes = named.groupBy("cluster").agg(F.sum("own").alias("members")).where("members > 1")
    named = work.keep(named.join(sizes, "cluster").withColumn("parts", F.ceil(F.col("members") / PART).cast("int")))
    number = hung.count()
    members = matched(hung.select("rep", "top", "central"), named, "top", F.col("own") > number / HUBS)
    members = work.keep(members.select("rep", "cluster", "central", "members", "parts", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part")))
    texts = docs.select("doc_id", "text").join(members.join(reps.select("rep", "registers"), "rep"), F.col("doc_id") == F.col("rep")).dropDuplicates(["rep"])
    sets = work.keep(_sets(texts, size))
    pivots = members.groupBy("cluster").agg(F.max_by("rep", F.struct("central", (-F.col("rep")).alias("r"))).alias("pivot"), F.first("members").alias("members"), F.first("parts").alias("parts"))
    common = pivots.join(sets.select(F.col("rep").alias("pivot"), F.col("own").alias("common")), "pivot").select("cluster", "members", "parts", "common")
    common = work.keep(common)
    first = work.keep(_differences(sets, _for_parts(common.select("cluster", "parts", "common"))))
    # the common set moves to what more than half of the members hold
    usual = first.select("cluster", F.explode("e").alias("s")).groupBy("cluster", "s").agg(F.count("*").alias("df"))
    usual = usual.join(common.select("cluster", "members", "parts").where("members > 3"), "cluster").where("2 * df > members")
    usual = usual.groupBy("cluster").agg(F.collect_list("s").alias("moved"), F.first("parts").alias("parts"))  # at most twice the mean difference
    # the difference to the moved set is that to the old one, with what was moved exchanged
    exchanged = F.array_union(F.array_except("e", "moved"), F.array_except("moved", "e"))
    e = first.join(_for_parts(usual), ["cluster", "part"], "left").withColumn("e", F.when(F.col("moved").isNull(), F.col("e")).otherwise(F.array_sort(exchanged)))
    e = work.keep(e.drop("moved"))
    work.drop(first, sets)
    low, high = 100 - percent, 100 + percent
    e = e.withColumn("a", F.lit(high) * F.size("e") - F.lit(low) * F.col("n"))
    lows = e.groupBy("cluster").agg(F.min(F.struct("a", "rep")).alias("hub"), F.max("a").alias("most"), F.first("parts").alias("parts"))
    lows = work.keep(lows)
    star = e.drop("parts").join(_for_parts(lows), ["cluster", "part"]).where("a + hub.a <= 0 and rep <> hub.rep")
    star = work.keep(star.select(F.col("rep").alias("a"), F.col("hub.rep").alias("b")))
    others = _beyond_stars(e, lows, star, work, percent)
    return work.keep(reduce(DataFrame.unionByName, others, star))


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable over links), kept.

    docs has doc_id and text; A-Z are lower-cased and words are what white space separates; size words make a shingle,
    and documents link if percent of the union of their sets is in common. NULL and empty texts and texts without
    words have an empty set and link with nothing; a row whose doc_id is NULL links with nothing and is kept. Texts of
    any length are read whole, a long one alone, in some 100 bytes of memory a byte. Of documents that link the least
    doc_id names the component. Rows of one doc_id are one document; where their texts differ, each has its exact copies
    and one of them its near ones. Repeated rows are one class; an
    empty table gives an empty result; other columns are not read, whatever their names.
    """
    work = Workspace(docs.sparkSession, "neardup")
    signed = work.keep(sign(docs, size))
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("registers").alias("registers"))
    classes = work.keep(classes)
    found = links(docs, classes.select("rep", F.col("n_shingles").alias("n"), "bands", "registers"), work, size, percent)
    components = connected(found, work)
    of_class = classes.select("h1", "h2", F.col("n_shingles").alias("n"), "rep").join(components, F.col("rep") == F.col("node"), "left")
    of_class = work.keep(of_class.select("h1", "h2", "n", F.coalesce("component", "rep").alias("component_id")))
    work.keep_only(signed, of_class)
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(
        of_class, (signed.h1 == of_class.h1) & (signed.h2 == of_class.h2) & (signed.n_shingles == of_class.n) & signed.doc_id.isNotNull(), "left"
    )
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that near_duplicates() keeps; of rows that repeat doc_id and text, one stays.

    A doc_id with several texts stays with each of them that differs, if one is kept. Rows without doc_id stay, as do
    texts that are NULL, empty or without words, which are nothing's copies; texts of any length are compared whole; of
    a group the least doc_id stays; an empty table gives an empty one; columns of any name pass through.
    """
    judged = near_duplicates(docs, size, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    (same,) = unused(docs.columns, "same_text")
    stay = docs.where("doc_id is not null").join(judged, "doc_id", "left_semi").withColumn(same, F.xxhash64("text"))
    return stay.dropDuplicates(["doc_id", same]).drop(same).unionByName(docs.where("doc_id is null"))
