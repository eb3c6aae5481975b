"""Review: which frames to look at first, why, the reviewers' records, and point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.operators.ordered import RANGE, range_sizes, ranged, with_neighbours
from framewright.schemas import SECOND, Settings
from framewright.staging import discard, stage

KINDS = ("left", "right", "other", "suspect")


def top(df: DataFrame, by: Column, number: int, keys: tuple[str, ...] = ("t", "frame_id")) -> DataFrame:
    """The first rows of each group by an order, NULLs dropped, ties to the earlier frame."""
    own = Window.partitionBy("grp").orderBy("by__", *keys)
    return df.withColumn("by__", by).where("by__ is not null").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= number).drop("by__")


def count_changes(frames: DataFrame) -> DataFrame:
    """grp, frame_id, t, interval_s and count_change: the larger change of the two sides since the frame before."""
    rows = ranged(frames.select("grp", "t", "frame_id", "left_count", "right_count"), ["grp"], ["t", "frame_id"])
    near = with_neighbours(rows, ["grp"], ["t", "frame_id"], ["left_count", "right_count"])
    change = F.greatest(F.abs(F.col("left_count") - F.col("prev.left_count")), F.abs(F.col("right_count") - F.col("prev.right_count")))
    return near.select("grp", "frame_id", "t", ((F.col("t") - F.col("prev.t")) / SECOND).alias("interval_s"), change.alias("count_change"))


def largest_changes(frames: DataFrame, settings: Settings, number: int = 3) -> DataFrame:
    """The frames of each group with the largest change over a step that is positive and short enough."""
    gap = settings.max_gap / SECOND
    return top(count_changes(frames).where((F.col("interval_s") > 0) & (F.col("interval_s") <= gap)), -F.col("count_change"), number)


def gap_neighbours(frames: DataFrame, settings: Settings) -> DataFrame:
    """grp, frame_id of frames just before or after a step that is too long."""
    near = with_neighbours(ranged(frames.select("grp", "t", "frame_id"), ["grp"], ["t", "frame_id"]), ["grp"], ["t", "frame_id"], [])
    far = (F.col("t") - F.col("prev.t") > settings.max_gap) | (F.col("next.t") - F.col("t") > settings.max_gap)
    return near.where(F.coalesce(far, F.lit(False))).select("grp", "frame_id")


def reasons(parts: dict[str, DataFrame]) -> DataFrame:
    """frame_id and reason: the distinct reasons of each frame, sorted, joined by '; '."""
    every = None
    for text, df in parts.items():
        own = df.select("frame_id", F.lit(text).alias("reason"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("frame_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"))


def priority(frames: DataFrame, settings: Settings, number: int = 3) -> DataFrame:
    """frame_id and reason of the frames to review first; counts are never altered.

    frames: grp, t, frame_id, left_count, right_count, sharpness, suspect_count, and, if checked, reference_error: the larger
    error against a reference.
    """
    parts = {
        "least sharp of its group": top(frames, F.col("sharpness"), number),
        "most suspect detections of its group": top(frames, -F.col("suspect_count"), number),
        "large change between adjacent frames": largest_changes(frames, settings, number),
        "beside an acquisition gap": gap_neighbours(frames, settings),
    }
    if "reference_error" in frames.columns:
        parts["off the reference by more than two"] = frames.where(F.abs("reference_error") > 2)
    return reasons(parts)


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key in an append-only log; of records with the same place, one by its content."""
    rest = [c for c in log.columns if c != key]
    record = F.struct(order, *[c for c in rest if c != order])
    return log.groupBy(key).agg(F.max(record).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def checked(records: DataFrame, known: DataFrame, image: tuple[int, int] = (4416, 2488)) -> DataFrame:
    """Review records with problem (NULL if valid) and the four counts, which are taken from the boxes anew."""

    def bad(b: Column) -> Column:
        x, y, w, h = (F.get(b["bbox"], F.lit(i)) for i in range(4))
        within = (x >= 0) & (x < image[0]) & (y >= 0) & (y < image[1]) & (w > 0) & (w <= image[0] - x) & (h > 0) & (h <= image[1] - y)
        return ~F.coalesce(within, F.lit(False))

    ids = known.select("frame_id").distinct().withColumn("known__", F.lit(True))
    problem = (
        F.when(F.col("known__").isNull(), "unknown frame")
        .when(F.trim(F.coalesce("reviewer", F.lit(""))) == "", "no reviewer")
        .when(~F.coalesce("confirmed", F.lit(False)), "not confirmed")
        .when(F.col("boxes").isNull() | (F.size("boxes") > 1000), "no valid boxes")
        .when(F.exists("boxes", lambda b: ~F.coalesce(b["kind"].isin(*KINDS), F.lit(False))), "unknown kind")
        .when(F.exists("boxes", bad), "box outside the image")
    )
    def number(kind: str) -> Column:
        return F.size(F.filter("boxes", lambda b: b["kind"] == kind))

    counts = {f"{k}_count": number(k) for k in KINDS}
    return records.join(ids, "frame_id", "left").withColumn("problem", problem).withColumns(counts).drop("known__")


def write_pages(frames: DataFrame, path: str) -> None:
    """The page index of frames (grp, t, frame_id and more): its rows in ranges of group, time and id, and the ranges' sizes.

    rows holds a folder a range and ranges a row for each group and range, with the number of the group's rows before it.
    """
    rows = frames.where("grp is not null and t is not null").repartitionByRange("grp", "t", "frame_id").withColumn(RANGE, F.spark_partition_id())
    rows.write.mode("overwrite").partitionBy(RANGE).parquet(f"{path}/rows")
    range_sizes(frames.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows"), ["grp"]).write.mode("overwrite").parquet(f"{path}/ranges")


def page(spark: SparkSession, path: str, group: str, index: int) -> DataFrame:
    """The frame at a place of its group by time and id, the place moved into the group's range, with place and total.

    A point query on a page index: the ranges' table says which range holds the place, and only that one is read and
    ordered. A group without frames gives no row.
    """
    ranges = spark.read.parquet(f"{path}/ranges").where(F.col("grp") == group)
    total = ranges.agg(F.sum("n").alias("n")).first().n or 0
    at = max(0, min(total - 1, index))
    found = ranges.where((F.col("before") <= at) & (F.col("before") + F.col("n") > at)).first()
    if not found:
        return ranges.where(F.lit(False))
    own = spark.read.parquet(f"{path}/rows/{RANGE}={found[RANGE]}").where(F.col("grp") == group)  # no other range is listed or read
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("t", "frame_id")) - 1 + F.lit(found.before))
    return own.where(F.col("place") == at).withColumn("total", F.lit(total).cast("long"))


def next_far(hours: DataFrame, least: DataFrame) -> DataFrame:
    """grp, hour, to: for each distinct hour the first one of its group that is more than the group's least after it.

    Hours and the places that lie least after them are ordered together, in ranges; the next hour after such a place is
    found within its range, or is the first of a later range. The last hours have none. Windows run from the end, as one
    that reaches forward to the end of its rows is evaluated anew at each row.
    """
    hours = hours.join(least, "grp").select("grp", "hour", "least").distinct()
    kinds = F.array(F.struct(F.col("hour").alias("at"), F.lit(0).alias("place")), F.struct((F.col("hour") + F.col("least")).alias("at"), F.lit(1).alias("place")))
    rows = ranged(hours.select("grp", "hour", F.explode(kinds).alias("k")).select("grp", "hour", "k.*"), ["grp"], ["at", "place", "hour"])
    point = F.when(F.col("place") == 0, F.col("hour"))
    over = Window.partitionBy("grp").orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    later = rows.groupBy("grp", RANGE).agg(F.min(point).alias("first")).select("grp", RANGE, F.min("first").over(over).alias("later"))
    own = Window.partitionBy("grp", RANGE).orderBy(F.desc("at"), F.desc("place"), F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(later, ["grp", RANGE]).withColumn("to", F.coalesce(F.min(point).over(own), "later"))
    return found.where("place = 1").select("grp", "hour", "to")


def splice_labels(splices: DataFrame, spans: DataFrame) -> DataFrame:
    """grp, hour, labelled: each segment's start but the first, labelled if it is far enough from the last labelled one.

    Far is more than 0.035 of the span and 0.3 hours; of equal starts one is labelled. spans: grp, hours. Each start
    points to the next one that is far enough. Labelled is what the first start reaches: in each round the starts found
    so far follow pointers that are twice as long as before, so that n labels take log2(n) rounds.
    """
    starts = splices.where("segment > 1").select("grp", (F.col("effective_start_s") / 3600).alias("hour"))
    least = spans.select("grp", F.greatest(F.col("hours") * 0.035, F.lit(0.3)).alias("least"))
    jump = stage(next_far(starts, least).where("to is not null"))
    labels = stage(starts.join(least, "grp", "left_semi").groupBy("grp").agg(F.min("hour").alias("hour")))
    while True:
        more = labels.join(jump, ["grp", "hour"]).select("grp", F.col("to").alias("hour"))
        known, labels = labels, stage(labels.unionByName(more))
        longer = jump.join(jump.select("grp", F.col("hour").alias("to"), F.col("to").alias("further")), ["grp", "to"]).select("grp", "hour", F.col("further").alias("to"))
        old, jump = jump, stage(longer)
        discard(old, known)
        if jump.isEmpty():
            break
    first = Window.partitionBy("grp", "hour").orderBy(F.lit(1))
    marked = starts.withColumn("k", F.row_number().over(first)).join(labels.withColumn("found", F.lit(True)), ["grp", "hour"], "left")
    return marked.select("grp", "hour", (F.coalesce("found", F.lit(False)) & (F.col("k") == 1)).alias("labelled"))
