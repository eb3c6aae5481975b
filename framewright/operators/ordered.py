"""Ordered operators that scale past the number of groups.

A plain window over a group runs each group in one task. Here rows are first dealt to ranges of (group, order) of about
equally many rows, by Spark's range shuffle, and written with their range. Windows run within (group, range); one row a
range carries what crosses its borders, the neighbour rows and the sums so far. The ranges follow the rows, so that
neither a long group nor a crowded minute ends in one task, and the table of borders is as long as there are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.staging import stage

RANGE = "range__"


def ranged(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df written in ranges of group and order, with RANGE, which rises with them; order must be unique within a group.

    There are as many ranges as shuffle partitions, or fewer where adaptive execution joins small ones.
    """
    return stage(df.repartitionByRange(*group, *order).withColumn(RANGE, F.spark_partition_id()))


def _within(group: list[str], order: list[str]) -> tuple:
    """The window of a range's rows, and the one that runs up to the current row."""
    own = Window.partitionBy(*group, RANGE).orderBy(*order)
    return own, own.rowsBetween(Window.unboundedPreceding, 0)


def with_neighbours(df: DataFrame, group: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """df, as ranged() gives it, with structs prev and next: the order and carry columns of the group's rows beside it."""
    record = F.struct(*order, *[c for c in carry if c not in order])
    ends = df.groupBy(*group, RANGE).agg(F.min(record).alias("first"), F.max(record).alias("last"))
    over = Window.partitionBy(*group).orderBy(RANGE)
    ends = ends.select(*group, RANGE, F.lead("first").over(over).alias("after__"), F.lag("last").over(over).alias("before__"))
    own, _ = _within(group, order)
    out = df.join(ends, [*group, RANGE])
    out = out.withColumns({"prev": F.coalesce(F.lag(record).over(own), "before__"), "next": F.coalesce(F.lead(record).over(own), "after__")})
    return out.drop("after__", "before__")


def with_running_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df, which has RANGE, with, for each name, the sum of its expression over the group's rows up to and with this one.

    The sums of whole ranges are written, a few rows, so that reading the result often costs no second aggregation.
    """
    df = df.withColumns({f"{n}__": c for n, c in sums.items()})
    over = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, RANGE).agg(*[F.sum(f"{n}__").alias(n) for n in sums])
    totals = stage(totals.select(*group, RANGE, *[F.coalesce(F.sum(n).over(over), F.lit(0)).alias(f"{n}_so_far__") for n in sums]))
    _, running = _within(group, order)
    out = df.join(totals, [*group, RANGE])
    out = out.withColumns({n: F.coalesce(F.sum(f"{n}__").over(running), F.lit(0)) + F.col(f"{n}_so_far__") for n in sums})
    return out.drop(*[f"{n}__" for n in sums], *[f"{n}_so_far__" for n in sums])


def segmented(df: DataFrame, group: list[str], start: str, end: str, order: str) -> DataFrame:
    """Spans (start, end) with RANGE, numbered by segment, and eff_start and eff_end: the time that spans have filled so far.

    A segment ends where the next span of the group begins elsewhere than the last one ended. Spans go by start and
    order; neither overlaps the next. Within a range windows find breaks and sums; whether a range's first span continues
    the range before, and what all earlier ranges hold, comes from one row a range.
    """
    own, running = _within(group, [start, order])
    length = F.col(end) - F.col(start)
    df = df.withColumn("break__", F.when(F.lag(end).over(own) != F.col(start), 1).otherwise(0))
    local = stage(df.withColumns({"segment": F.sum("break__").over(running), "eff_end": F.sum(length).over(running)}).drop("break__"))
    ends = local.groupBy(*group, RANGE).agg(F.min(start).alias("first"), F.max(end).alias("last"), F.max("segment").alias("breaks"), F.max("eff_end").alias("filled"))
    over = Window.partitionBy(*group).orderBy(RANGE)
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("new", F.when(F.lag("last").over(over) == F.col("first"), 0).otherwise(1))
    carried = stage(
        ends.select(
            *group, RANGE, (F.coalesce(F.sum(F.col("breaks") + F.col("new")).over(earlier), F.lit(0)) + F.col("new")).alias("segments__"),
            F.coalesce(F.sum("filled").over(earlier), F.lit(0)).alias("filled__"),
        )
    )
    out = local.join(carried, [*group, RANGE]).withColumns({"segment": F.col("segment") + F.col("segments__"), "eff_end": F.col("eff_end") + F.col("filled__")})
    return out.withColumn("eff_start", F.col("eff_end") - length).drop("segments__", "filled__", RANGE)


def range_sizes(df: DataFrame, group: list[str]) -> DataFrame:
    """For each group and range of df, as ranged() gives it: n, its rows, and before, those of earlier ranges."""
    n = df.groupBy(*group, RANGE).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))

