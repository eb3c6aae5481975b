import random

from pyspark.sql import functions as F

from framewright.operators import occupancy
from framewright.schemas import FRAMES, SECOND, Settings
from framewright.streaming import logs, segments


DAY = 24 * 3600  # seconds


def run(spark, folder, sink, checkpoint, gap=15):
    spark.conf.set(*segments.STORE)
    stream = logs.file_stream(spark, folder, f"{FRAMES}, ts timestamp", files_per_trigger=1)
    logs.replay(segments.segments_of(stream, "ts", gap * SECOND, "10 hours"), "update", sink, checkpoint)
    return spark.read.option("basePath", sink).parquet(sink)


def test_segments_equal_the_batch_ones_over_restarts(spark, tmp_path):
    rng = random.Random(6)
    rows, t = [], {"A": DAY, "B": DAY}  # a stream begins after the epoch, where its watermark starts
    for i in range(600):
        g = rng.choice("AAB")
        t[g] += rng.choice([0, 3, 10, 15, 16, 400])
        rows.append((g, i, t[g] * SECOND, rng.choice([1, 2, None]) if i % 11 == 0 else 1, 2, rng.random() < 0.9))
    rows += [("lone", 1000, (DAY + 5) * SECOND, 1, 1, True), ("edge", 1001, DAY * SECOND, 1, 1, True), ("edge", 1002, (DAY + 15) * SECOND, 1, 1, True), ("edge", 1003, (DAY + 31) * SECOND, 1, 1, True)]
    frames = spark.createDataFrame(rows, FRAMES).withColumn("ts", F.timestamp_micros("t"))
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for lo, hi in ((0, 200), (200, 450), (450, 2000)):  # each a run of its own from the checkpoint
        frames.where((F.col("frame_id") >= lo) & (F.col("frame_id") < hi)).coalesce(1).write.mode("append").parquet(source)
        found = run(spark, source, sink, checkpoint)
    got = segments.latest_segments(found).select("grp", "segment", "eff_start", "eff_end", "first_frame", "last_frame").collect()
    plain = spark.createDataFrame(rows, FRAMES)
    iv = occupancy.intervals(plain, Settings())
    want = occupancy.splice_map(iv, plain).select("grp", "segment", (F.col("effective_start_s") * SECOND).cast("long"), (F.col("effective_end_s") * SECOND).cast("long"), "first_frame", "last_frame").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert found.agg(F.sum("late")).first()[0] == 0 and not [r for r in got if r.grp == "lone"]
    assert [(r.eff_end, r.last_frame) for r in got if r.grp == "edge"] == [(15 * SECOND, 1002)]


def test_timers_close_and_late_frames_are_reported(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    hour = 3600 * SECOND
    batches = [[("A", 1, hour, 1, 1, True), ("A", 2, hour + 10 * SECOND, 1, 1, True)], [("B", 3, 30 * hour, 1, 1, True), ("B", 4, 30 * hour + SECOND, 1, 1, True)], [("B", 5, 30 * hour - SECOND, 1, 1, True)]]
    for rows in batches:
        spark.createDataFrame(rows, FRAMES).withColumn("ts", F.timestamp_micros("t")).coalesce(1).write.mode("append").parquet(source)
        found = run(spark, source, sink, checkpoint)
    last = {r.grp: r for r in segments.latest_segments(found).collect()}
    assert last["A"].closed and not last["B"].closed and last["B"].last_frame == 4
    assert found.agg(F.sum("late")).first()[0] == 1
