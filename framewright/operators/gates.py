"""Quality and acceptance gates: a count is published only where image and group passed, else it is NULL with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.schemas import Settings


def quality_reasons(settings: Settings, unchanged: Column, brightness: Column, sharpness: Column, overlap: Column) -> Column:
    """Array of what is wrong with an image, in this order; a missing measurement counts as a failure."""
    low, high = settings.brightness
    checks = [
        ("source changed", ~F.coalesce(unchanged, F.lit(False))),
        ("exposure", ~F.coalesce((brightness >= low) & (brightness <= high), F.lit(False))),
        ("out of focus", ~F.coalesce(sharpness >= settings.sharpness, F.lit(False))),
        ("scene moved", ~F.coalesce(overlap >= settings.overlap, F.lit(False))),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in checks]))


def group_failure(settings: Settings, group: Column, sharpness: Column) -> Column:
    """Whether a group's own sharpness rule fails; a missing value counts as 0."""
    out = F.lit(False)
    for name, least in settings.group_sharpness:
        out = out | ((group == name) & (F.coalesce(sharpness, F.lit(0.0)) < least))
    return out


def published(df: DataFrame, usable: Column, passed: Column, counts: dict[str, str]) -> DataFrame:
    """df with each published count, valid_primary and primary_missing_reason; a group's failure outranks an image's."""
    usable, passed = F.coalesce(usable, F.lit(False)), F.coalesce(passed, F.lit(False))
    reason = F.when(~passed, "group not accepted").when(~usable, "image not usable")
    out = {name: F.when(usable & passed, F.col(source)) for name, source in counts.items()}
    return df.withColumns(out | {"valid_primary": usable & passed, "primary_missing_reason": reason})


def candidate_view(df: DataFrame, counts: dict[str, str], valid: str = "valid_candidate_summary") -> DataFrame:
    """df with the automatic counts in place of the published ones, and the candidate validity."""
    return df.withColumns({name: F.col(source) for name, source in counts.items()} | {"valid_primary": F.col(valid), "data_status": F.lit("automatic candidate, to be reviewed")})
