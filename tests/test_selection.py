import bisect
import random
import time

import pytest
from pyspark.sql import functions as F

from framewright.operators import detections, review
from framewright.plans import catalogue


def points(rng, n, frames, spread):
    return [(rng.randrange(frames), i, rng.uniform(-spread, spread), rng.uniform(-spread, spread), rng.choice([0.5, 1.0, rng.random()])) for i in range(n)]


def one_by_one(rows, order, near, taken=()):
    kept, places = [], list(taken)
    for r in sorted(rows, key=order):
        if not any(near(r[2] - x, r[3] - y) for x, y in places):
            kept.append(r[1])
            places.append((r[2], r[3]))
    return kept


@pytest.mark.parametrize(("spread", "frames"), [(150, 1), (900, 3)])
def test_greedy_equals_taking_one_by_one(spark, spread, frames):
    rows = points(random.Random(spread), 400, frames, spread)
    rows += [(0, 1000 + i, 5.0, 5.0, 0.4) for i in range(300)] + [(frames, 2000 + i, 40.0 * i, 0.0, -float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "frame long, id long, x double, y double, score double")
    got = sorted(r.id for r in detections.greedy(df, 48, 82).where("kept").collect())
    near = lambda dx, dy: (dx / 48) ** 2 + (dy / 82) ** 2 < 1
    want = [i for f in range(frames + 1) for i in one_by_one([r for r in rows if r[0] == f], lambda r: (-r[4], r[1]), near)]
    assert got == sorted(want)
    assert detections.greedy(df, 48, 82).count() == len(rows) and detections.greedy(df.limit(0), 48, 82).count() == 0


def test_supplement_equals_taking_one_by_one(spark):
    rows = points(random.Random(9), 300, 2, 500)
    df = spark.createDataFrame(rows, "frame long, id long, x double, y double, score double")
    got = sorted(r.id for r in detections.supplement(df.where("score > 0.9"), df.where("score <= 0.9")).collect())
    near = lambda dx, dy: abs(dx) < 65 and abs(dy) < 100
    want = []
    for f in range(2):
        own = [r for r in rows if r[0] == f]
        want += one_by_one([r for r in own if r[4] <= 0.9], lambda r: r[1], near, [(r[2], r[3]) for r in own if r[4] > 0.9])
    assert got == sorted(want)


def test_labels_of_many_segments_in_one_group(spark):
    """A hundred thousand segments of one group against the fold, some of them at the same hour."""
    hours = spark.range(100000).selectExpr("'a' grp", "id + 1 segment", "cast(floor((id * 7919L % 100003) / 2) * 0.9 as double) effective_start_s").unionByName(
        spark.createDataFrame([("b", 1, 5.0), ("c", 1, 0.0), ("c", 2, 60.0), ("c", 3, 60.0)], "grp string, segment long, effective_start_s double")
    )
    rows = [(r.grp, r.effective_start_s / 3600) for r in hours.where("segment > 1").collect()]
    spans = spark.createDataFrame([("a", 8.0), ("b", 1.0), ("c", 0.1)], "grp string, hours double")
    want = []
    for grp, span in (("a", 8.0), ("b", 1.0), ("c", 0.1)):
        last = -1e20
        for h in sorted(h for g, h in rows if g == grp):
            if h > last + max(span * 0.035, 0.3):
                want.append((grp, h))
                last = h
    found = review.splice_labels(hours, spans)
    assert sorted((r.grp, r.hour) for r in found.where("labelled").collect()) == want
    assert found.count() == len(rows)


def test_next_far_hours_of_one_range(spark):
    """Thirty thousand hours of one group and range: the time grows with them, not with their square."""
    rng = random.Random(4)
    hours = sorted({rng.randrange(10**7) / 1024 for _ in range(30000)})
    least = {"a": 350.5, "b": 0.25}  # exact in binary, so that some places fall on hours
    df = spark.createDataFrame([("a", h) for h in hours] + [("b", h / 4) for h in range(12)], "grp string, hour double").repartition(4)
    far = spark.createDataFrame(list(least.items()), "grp string, least double")
    began = time.monotonic()
    got = {(r.grp, r.hour): r.to for r in review.next_far(df.unionByName(df), far).collect()}
    assert time.monotonic() - began < 30
    for grp, own in (("a", hours), ("b", [h / 4 for h in range(12)])):
        places = [bisect.bisect_right(own, h + least[grp]) for h in own]
        assert [got.pop((grp, h)) for h in own] == [own[i] if i < len(own) else None for i in places]
    assert not got


def test_splice_labels_of_a_long_group(spark, tmp_path):
    """Two hundred thousand events of one type, every third invalid, so that segments are of a minute each: the time does not grow with their square."""
    events = spark.range(199998).selectExpr("id event_id", "timestampadd(SECOND, 60 * id, TIMESTAMP_NTZ'2024-01-01') ts", "0L user_id", "'view' event_type", "if(id % 3 = 2, 1.0D, 9.0D) value", "'{\"k\": 1}' props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    began = time.monotonic()
    got = sorted((r.hour, r.labelled) for r in catalogue.queries()["splice_labels"](spark, str(tmp_path)).collect())
    assert time.monotonic() - began < 150
    want, last = [], None
    for k in range(1, 66666):
        far = last is None or k - last > 66666 * 0.035
        last = k if far else last
        want.append((round(k / 60, 6), far))
    assert got == want


def test_pages(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("grp"), F.col("id").alias("frame_id"), (F.col("id") * 37 % 1000 + 5).alias("t"))
    review.write_pages(df.unionByName(spark.createDataFrame([("0", 5000, None)], df.schema)), str(tmp_path / "pages"))
    for g in ("0", "1", "2"):
        own = sorted((r.t, r.frame_id) for r in df.where(F.col("grp") == g).collect())
        for i in (-1, 0, 1, 77, 332, 333, 10**9):
            r = review.page(spark, str(tmp_path / "pages"), g, i).collect()
            at = max(0, min(len(own) - 1, i))
            assert [(x.t, x.frame_id, x.place, x.total) for x in r] == [(*own[at], at, len(own))]
    assert review.page(spark, str(tmp_path / "pages"), "none", 0).count() == 0
