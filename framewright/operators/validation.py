"""Validation of counts against a reference, and the acceptance of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.schemas import Settings


def long_form(predictions: DataFrame, reference: DataFrame, version: str) -> DataFrame:
    """One row per sample and side: version, grp, sample_id, side, reference_count, auto_count, error (NULL if unresolved).

    predictions: grp, sample_id, auto_left_count, auto_right_count; reference: sample_id, left_count, right_count. A
    sample without prediction is an error of the run and shows as a NULL auto_count.
    """
    joined = reference.join(predictions, "sample_id", "left")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_count").alias("reference_count"), F.col(f"auto_{s}_count").alias("auto_count")) for s in ("left", "right")])
    out = joined.select(F.lit(version).alias("version"), "grp", "sample_id", F.explode(sides).alias("x"))
    return out.select("version", "grp", "sample_id", "x.*", (F.col("x.auto_count") - F.col("x.reference_count")).alias("error"))


def metrics(long: DataFrame, settings: Settings, accepted_version: str) -> DataFrame:
    """Per version, group and side: numbers, mean absolute error, share within two, and whether the check passed.

    All prespecified samples must be resolved for a pass, which only the accepted version can get.
    """
    e = F.abs("error")
    out = long.groupBy("version", "grp", "side").agg(
        F.count("*").alias("selected_samples"), F.count("error").alias("usable_reference_sides"), F.avg(e.cast("double")).alias("mae"), F.avg((e <= 2).cast("double")).alias("within_two_fraction")
    )
    numerical = F.coalesce((F.col("usable_reference_sides") > 0) & (F.col("mae") <= settings.mae_limit) & (F.col("within_two_fraction") >= settings.within_two), F.lit(False))
    passed = numerical & (F.col("usable_reference_sides") == settings.holdouts) & (F.col("version") == accepted_version)
    return out.withColumns({"unresolved_reference_sides": F.col("selected_samples") - F.col("usable_reference_sides"), "numerical_target": numerical, "passed": passed})


def acceptance(metric_rows: DataFrame, version: str) -> DataFrame:
    """grp and accepted: exactly two sides, both passed."""
    own = metric_rows.where(F.col("version") == version)
    return own.groupBy("grp").agg(((F.count("*") == 2) & F.every("passed")).alias("accepted"))
