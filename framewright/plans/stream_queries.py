"""Streaming replays of the tables, whose results must equal the batch ones, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framewright.operators import occupancy, review
from framewright.plans.bindings import SETTINGS, frames, rounded, table
from framewright.plans.registry import registry
from framewright.plans.series_queries import SQL as SERIES
from framewright.schemas import SECOND
from framewright.staging import shared_dir, stage
from framewright.streaming import logs, segments

QUERIES, SQL, query = registry()


def scratch(spark) -> str:
    return f"{shared_dir(spark)}/framewright-stream-{uuid.uuid4().hex}"


def stream_of(spark, d, name):
    """A table's files as a stream; the pattern also fits where the table is one file."""
    schema = table(spark, d, name).schema
    return logs.file_stream(spark, f"{d}/[{name[0]}]{name[1:]}.parquet", schema)


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k FROM conversations) WHERE k = 1")
def stream_latest_review(spark, d):
    root = scratch(spark)
    stream = logs.latest_stream(stream_of(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")
    logs.replay(stream, "update", f"{root}/out", f"{root}/checkpoint")
    return logs.latest_of(spark, f"{root}/out", "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query("SELECT event_id AS frame_id, CASE WHEN value < 3 THEN 'error' ELSE 'processed' END AS status, floor(value)::INTEGER AS left_count FROM events")
def stream_resume(spark, d):
    root = scratch(spark)

    def work(rows):
        return rows.select(F.col("event_id").alias("frame_id"), F.when(F.col("value") < 3, "error").otherwise("processed").alias("status"), F.floor("value").cast("int").alias("left_count"))

    path, schema = f"{d}/[e]vents.parquet", table(spark, d, "events").schema
    logs.process_new(spark, path, schema, work, root, f"{root}/checkpoint")
    return logs.process_new(spark, path, schema, work, root, f"{root}/checkpoint")  # the second run finds nothing new


@query(
    """WITH r AS (SELECT conv_id::VARCHAR || ':' || turn AS frame_id, text AS reviewer, turn % 3 <> 2 AS confirmed FROM conversations)
SELECT frame_id, CASE WHEN trim(coalesce(reviewer, '')) = '' THEN 'no reviewer' WHEN NOT confirmed THEN 'not confirmed' WHEN ends_with(frame_id, '3') THEN 'unknown kind' WHEN ends_with(frame_id, '4') THEN 'box outside the image' END AS problem FROM r"""
)
def review_problems(spark, d):
    c = table(spark, d, "conversations")
    rows = c.select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("frame_id"), F.col("text").alias("reviewer"), (F.col("turn") % 3 != 2).alias("confirmed"))
    box = F.struct(F.when(F.col("frame_id").endswith("3"), "wing").otherwise("left").alias("kind"), F.when(F.col("frame_id").endswith("4"), F.array(F.lit(4410.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))).otherwise(F.array(F.lit(1.0), F.lit(1.0), F.lit(5.0), F.lit(5.0))).alias("bbox"))
    return review.checked(rows.withColumn("boxes", F.array(box)), rows).select("frame_id", "problem")


@query(SERIES["splice_map"])
def stream_segments(spark, d):
    """The splice map from a stream of frames that arrive in three parts, each run going on from the last one's checkpoint."""
    root, f = scratch(spark), stage(frames(spark, d).where("t is not null").withColumn("ts", F.timestamp_micros("t")))
    a, b = f.approxQuantile("t", [0.3, 0.7], 0.01) or (0, 0)
    before = spark.conf.get(segments.STORE[0], None)
    spark.conf.set(*segments.STORE)
    try:
        for lo, hi in ((-(2**62), a), (a, b), (b, 2**62)):
            f.where((F.col("t") >= lo) & (F.col("t") < hi)).write.mode("append").parquet(f"{root}/in")
            stream = logs.file_stream(spark, f"{root}/in", f.schema)
            logs.replay(segments.segments_of(stream, "ts", SETTINGS.max_gap, "7 days"), "update", f"{root}/out", f"{root}/checkpoint")
    finally:
        if before is None:
            spark.conf.unset(segments.STORE[0])
        else:
            spark.conf.set(segments.STORE[0], before)
    out = segments.latest_segments(spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out")).join(occupancy.spans(f), "grp")
    seconds = {"actual_start_s": F.col("start_t") - F.col("t0"), "actual_end_s": F.col("end_t") - F.col("t0"), "effective_start_s": F.col("eff_start"), "effective_end_s": F.col("eff_end")}
    return rounded(out.select("grp", "segment", *[(c / SECOND).alias(n) for n, c in seconds.items()], "first_frame", "last_frame"))
