"""How the driver's tables stand in for the domain's: frames from events, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.schemas import SECOND, Settings

#: The frame binding uses a longer gap than photographs do, as its groups have minutes between rows.
SETTINGS = Settings(max_gap=1800 * SECOND)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: group event_type, time in microseconds, counts from value and props.k, valid from 3 on."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("grp"),
        F.col("event_id").alias("frame_id"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("t"),
        F.floor("value").cast("int").alias("left_count"),
        k.alias("right_count"),
        (F.col("value") >= 3).alias("valid"),
        (F.col("value") * 2).alias("brightness"),
        k.cast("double").alias("sharpness"),
        (k / 100).alias("overlap"),
    )


def tied_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with times cut to the minute, so that frames tie, and some counts missing."""
    return frames(spark, sf_dir).withColumns({"t": F.floor(F.col("t") / (60 * SECOND)) * (60 * SECOND), "right_count": F.when(F.col("frame_id") % 17 != 0, F.col("right_count"))})


FRAMES = """frames AS (
  SELECT event_type AS grp, event_id AS frame_id, epoch_us(ts) AS t, floor(value)::INTEGER AS left_count, (props->>'k')::INTEGER AS right_count, value >= 3 AS valid,
    value * 2 AS brightness, (props->>'k')::DOUBLE AS sharpness, (props->>'k')::INTEGER / 100 AS overlap
  FROM events)"""
TIED = FRAMES.replace("epoch_us(ts) AS t", "epoch_us(date_trunc('minute', ts)) AS t").replace("(props->>'k')::INTEGER AS right_count", "CASE WHEN event_id % 17 <> 0 THEN (props->>'k')::INTEGER END AS right_count")
#: Intervals with segment and effective time, and each group's span.
INTERVALS = """pairs AS (
  SELECT grp, t AS start_t, frame_id AS start_frame, left_count AS l0, right_count AS r0, valid AS v0,
    lead(t) OVER w AS end_t, lead(frame_id) OVER w AS end_frame, lead(left_count) OVER w AS l1, lead(right_count) OVER w AS r1, lead(valid) OVER w AS v1
  FROM frames WINDOW w AS (PARTITION BY grp ORDER BY t, frame_id)),
kept AS (SELECT * FROM pairs WHERE v0 AND v1 AND l0 + r0 + l1 + r1 IS NOT NULL AND end_t - start_t > 0 AND end_t - start_t <= 1800000000),
broken AS (SELECT *, CASE WHEN lag(end_t) OVER (PARTITION BY grp ORDER BY start_t, start_frame) = start_t THEN 0 ELSE 1 END AS brk FROM kept),
iv AS (
  SELECT *, (sum(brk) OVER w)::BIGINT AS segment, (sum(end_t - start_t) OVER w)::BIGINT AS eff_end, (sum(end_t - start_t) OVER w - (end_t - start_t))::BIGINT AS eff_start
  FROM broken WINDOW w AS (PARTITION BY grp ORDER BY start_t, start_frame ROWS UNBOUNDED PRECEDING)),
spans AS (SELECT grp, min(t) AS t0, max(t) - min(t) AS last FROM frames GROUP BY grp)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, so that the order of summation does not show; halves of minutes go up in spite of noise."""
    noise = lambda c: F.col(c) + 1e-9 if c.endswith("_minutes") else F.col(c)
    return df.select(*[F.round(noise(c), digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
