"""Append-only logs as streams: resumable processing and the latest record per key.

File streams read what is new since their checkpoint, so a restarted query goes on where it stopped; available-now
triggers make a batch of it. The state per key is bounded by the number of keys and kept by Spark's state store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, folder: str, schema, kind: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the files of a folder, in bounded batches."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def latest_stream(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key so far: a stateful aggregation, for the update or complete mode."""
    rest = [c for c in log.columns if c != key]
    record = F.struct(order, *[c for c in rest if c != order])
    return log.groupBy(key).agg(F.max(record).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def replay(stream: DataFrame, mode: str, sink: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Runs what is available to the end, each batch written to sink/batch=<id> once, however often it is retried."""

    def write(batch: DataFrame, number: int) -> None:
        (shape(batch) if shape else batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def latest_of(spark: SparkSession, sink: str, key: str, order: str) -> DataFrame:
    """The last record of each key among the written batches of an update-mode replay."""
    written = spark.read.parquet(sink).drop("batch")
    return latest_stream(written, key, order)


def process_new(spark: SparkSession, folder: str, schema, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, retry_errors: bool = False, kind: str = "parquet") -> DataFrame:
    """Runs work on rows not seen before and returns all records so far.

    Records with status error count as done, too; with retry_errors, rows that ended so are worked on again, from the
    folder, and the later record wins.
    """
    replay(file_stream(spark, folder, schema, kind), "append", f"{sink}/first", checkpoint, work)
    done = spark.read.option("basePath", f"{sink}/first").parquet(f"{sink}/first").drop("batch")
    if not retry_errors:
        return done
    failed = done.where("status = 'error'").select("frame_id")
    again = work(spark.read.format(kind).schema(schema).load(folder).join(failed, "frame_id", "left_semi"))
    again.write.mode("overwrite").parquet(f"{sink}/again")
    return done.join(failed, "frame_id", "left_anti").unionByName(spark.read.parquet(f"{sink}/again"))


def gap_sessions(events: DataFrame, key: str, time: str, gap: str, lateness: str) -> DataFrame:
    """Sessions of a stream that a gap ends, with a watermark for late rows: start, end and number.

    Unlike the batch segments of occupancy.intervals, a single row makes a session, validity breaks none, and a step of
    exactly the gap begins a new one; use it to watch acquisition, not to integrate counts.
    """
    windows = events.withWatermark(time, lateness).groupBy(key, F.session_window(time, gap).alias("s"))
    return windows.agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
