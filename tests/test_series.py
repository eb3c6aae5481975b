import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.operators import inventory, occupancy
from framewright.operators.ordered import RANGE, ranged, with_neighbours, with_running_sums
from framewright.schemas import FRAMES, SECOND, Settings

S = Settings()
T, LEFT, RIGHT = (0, 10, 20, 100, 110, 120), (1, 3, 5, 7, 9, 11), (3, 1, 0, 1, 3, 5)


def series(spark, t=T, left=LEFT, right=RIGHT, valid=None):
    rows = [("A", i, s * SECOND, a, b, v) for i, (s, a, b, v) in enumerate(zip(t, left, right, valid or [True] * len(t), strict=True))]
    return spark.createDataFrame(rows, FRAMES)


def bins(spark, frames, step, axis):
    iv = occupancy.intervals(frames, S)
    rows = occupancy.rebin(iv, frames, [step], (axis,)).orderBy("bin").collect()
    of = lambda x: None if x is None else round(x * 60, 9)
    return [(of(r.left_insect_minutes), of(r.right_insect_minutes), r.observed_seconds, r.interval_pieces) for r in rows]


def test_synthetic_series(spark):
    f = series(spark)
    iv = occupancy.intervals(f, S).orderBy("start_t").collect()
    assert len(iv) == 4 and iv[-1].eff_end == 40 * SECOND
    assert (iv[2].start_t, iv[2].eff_start, iv[2].segment) == (100 * SECOND, 20 * SECOND, 2)
    assert bins(spark, f, 15, "effective") == [(37.5, 23.75, 15, 2), (102.5, 21.25, 15, 2), (100, 40, 10, 1)]
    assert bins(spark, f, 30, "actual") == [(60, 25, 20, 2), (None, None, 0, 0), (None, None, 0, 0), (180, 60, 20, 2)]


def test_variants(spark):
    assert occupancy.intervals(series(spark, valid=[True, False, True, True, True, True]), S).count() == 2
    assert occupancy.intervals(series(spark, valid=[True, None, True, True, True, True]), S).count() == 2
    zero = series(spark, (0, 10), (0, 0), (0, 0))
    assert occupancy.overall(zero, occupancy.intervals(zero, S)).first().left_share is None
    assert occupancy.intervals(series(spark, (0, 0, 10), (1, 1, 1), (1, 1, 1)), S).count() == 1
    missing = series(spark, (0, 10), (1, None), (1, 1))
    iv = occupancy.intervals(missing, S)
    assert iv.count() == 0 and occupancy.rebin(iv, missing, [15]).count() == 0
    row = occupancy.overall(missing, iv).first()
    assert (row.n_images, row.n_valid, row.effective_hours, row.left_mean) == (2, 2, 0, None)
    assert occupancy.gaps(missing, S).count() == 0  # a missing count makes no gap row


def test_ordered_operators_equal_plain_windows(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.randrange(2000), i, rng.randrange(9)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, t long, id long, v int")
    w = Window.partitionBy("g").orderBy("t", "id")
    plain = df.select("*", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    out = with_running_sums(with_neighbours(ranged(df, ["g"], ["t", "id"]), ["g"], ["t", "id"], ["v"]), ["g"], ["t", "id"], {"s": F.col("v")})
    got = out.select("g", "t", "id", "v", F.col("prev.v").alias("p"), F.col("next.v").alias("n"), "s")
    assert sorted(got.collect()) == sorted(plain.collect())


@pytest.fixture
def many_ranges(spark):
    """Sixteen ranges, however few the rows."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_ranges_follow_the_rows_not_the_time(spark, many_ranges):
    crowded = spark.range(20000).selectExpr("'a' g", "if(id < 15000, 7L, id) t", "id")  # three quarters in one moment
    sizes = [r["count"] for r in ranged(crowded, ["g"], ["t", "id"]).groupBy(RANGE).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20000 / 16
    rows = with_running_sums(with_neighbours(ranged(crowded, ["g"], ["t", "id"]), ["g"], ["t", "id"], []), ["g"], ["t", "id"], {"s": F.lit(1)})
    assert rows.where("s <> id + 1 or coalesce(prev.id, -1) <> id - 1 or (next.id is null) <> (id = 19999)").count() == 0


def test_intervals_across_ranges(spark, many_ranges):
    rng = random.Random(4)
    rows, t = [], {"A": 0, "B": 0}
    for i in range(900):
        g = rng.choice("AAB")
        t[g] += rng.choice([0, 3, 10, 15, 16, 400])
        rows.append((g, i, t[g] * SECOND, rng.randrange(6), rng.randrange(6), rng.random() < 0.9))
    got = [(r.grp, r.start_t, r.end_t, r.segment, r.eff_start, r.eff_end) for r in occupancy.intervals(spark.createDataFrame(rows, FRAMES), S).collect()]
    want = []
    for g in "AB":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))
        last, segment, filled = None, 0, 0
        for a, b in zip(own, own[1:], strict=False):
            if a[5] and b[5] and 0 < b[2] - a[2] <= 15 * SECOND:
                segment += a[2] != last
                want.append((g, a[2], b[2], segment, filled, filled + b[2] - a[2]))
                last, filled = b[2], filled + b[2] - a[2]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_invariants(spark, seed):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(300):
        t += rng.choice([0, 3, 10, 15, 16, 400])
        rows.append((rng.choice("AB"), i, t * SECOND, rng.randrange(6), rng.randrange(6), rng.random() < 0.9))
    f = spark.createDataFrame(rows, FRAMES)
    iv = occupancy.intervals(f, S)
    b, totals = occupancy.rebin(iv, f, [7, 60]).cache(), occupancy.overall(f, iv).cache()
    assert occupancy.conservation(b, totals).where("not conserved").count() == 0
    assert b.where("abs(left_share + right_share - 1) > 1e-9 or (observed_seconds = 0 and left_mean is not null) or observed_seconds > end_s - start_s + 1e-9").count() == 0
    splices = occupancy.splice_map(iv, f).orderBy("grp", "segment").collect()
    for a, c in zip(splices, splices[1:], strict=False):
        assert a.grp != c.grp or abs(a.effective_end_s - c.effective_start_s) < 1e-9
    assert all(abs((s.actual_end_s - s.actual_start_s) - (s.effective_end_s - s.effective_start_s)) < 1e-9 for s in splices)
    lost = {r.grp: r.s for r in occupancy.gaps(f, S).groupBy("grp").agg(F.sum("seconds").alias("s")).collect()}
    for r in totals.collect():
        assert abs(lost.get(r.grp, 0) + r.effective_hours * 3600 - r.actual_hours * 3600) < 1e-6


def test_samples(spark):
    f = spark.range(200).selectExpr("'A' grp", "id frame_id", "id * 1000000 t")
    rows = inventory.samples(f, S).collect()
    cal = sorted(r["rank"] for r in rows if r.split == "calibration")
    val = sorted(r["rank"] for r in rows if r.split == "holdout")
    assert len(rows) == 50 and cal[0] == 0 and cal[-1] == 199 and len(set(val) & set(cal)) <= 30
    big = inventory.holdout_ranks(8019, list(range(0, 8019, 422)), 30)
    assert len(big) == 30 and all(abs(a - b) > 6 for a in big for b in range(0, 8019, 422))
