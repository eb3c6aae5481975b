"""Queries over gates, validation and acceptance, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from framewright.operators import gates, integrity, occupancy, validation
from framewright.plans.bindings import FRAMES, INTERVALS, SETTINGS, frames, rounded, table
from framewright.plans.registry import registry
from framewright.plans.series_queries import OVERALL

QUERIES, SQL, query = registry()
GATES = replace(SETTINGS, group_sharpness=(("error", 90.0),))
VALIDATION = replace(SETTINGS, holdouts=30, within_two=0.5)
COUNTS = {"left_count": "auto_left_count", "right_count": "auto_right_count"}

REASONS = """array_to_string(list_filter([CASE WHEN frame_id % 13 = 0 THEN 'source changed' END, CASE WHEN NOT (brightness >= 45 AND brightness <= 235) THEN 'exposure' END,
  CASE WHEN sharpness < 20 THEN 'out of focus' END, CASE WHEN overlap < 0.35 THEN 'scene moved' END], lambda x: x IS NOT NULL), '; ')"""
GATED = f"""{FRAMES}, q AS (SELECT *, {REASONS} AS reasons, grp = 'error' AND coalesce(sharpness, 0) < 90 AS group_fails FROM frames),
g AS (SELECT *, reasons = '' AND NOT group_fails AS usable, grp IN ('click', 'error', 'view') AS passed FROM q)"""


def gated(spark, d):
    f = frames(spark, d)
    reasons = gates.quality_reasons(GATES, F.col("frame_id") % 13 != 0, F.col("brightness"), F.col("sharpness"), F.col("overlap"))
    f = f.withColumns({"reasons": reasons, "group_fails": gates.group_failure(GATES, F.col("grp"), F.col("sharpness"))})
    f = f.withColumn("usable", (F.size("reasons") == 0) & ~F.col("group_fails")).withColumn("passed", F.col("grp").isin("click", "error", "view"))
    f = f.withColumns({"auto_left_count": F.col("left_count"), "auto_right_count": F.col("right_count")})
    return gates.published(f, F.col("usable"), F.col("passed"), COUNTS)


@query(f"WITH {FRAMES} SELECT grp, frame_id, {REASONS} AS reasons FROM frames")
def quality_reasons(spark, d):
    return gated(spark, d).select("grp", "frame_id", F.array_join("reasons", "; ").alias("reasons"))


@query(f"WITH {FRAMES} SELECT grp, count(*) AS n, count(*) FILTER (grp = 'error' AND coalesce(sharpness, 0) < 90) AS failed FROM frames GROUP BY grp")
def group_specific_gate(spark, d):
    return gated(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.count_if("group_fails").alias("failed"))


@query(
    f"""WITH {GATED} SELECT grp, frame_id, CASE WHEN usable AND passed THEN left_count END AS left_count, CASE WHEN usable AND passed THEN right_count END AS right_count,
  CASE WHEN NOT passed THEN 'group not accepted' WHEN NOT usable THEN 'image not usable' END AS primary_missing_reason FROM g"""
)
def gated_measure(spark, d):
    return gated(spark, d).select("grp", "frame_id", "left_count", "right_count", "primary_missing_reason")


def _overall(flag: str) -> str:
    gated_frames = f"{GATED.replace('frames AS (', 'base AS (').replace('FROM frames', 'FROM base')}, frames AS (SELECT grp, frame_id, t, left_count, right_count, {flag} AS valid FROM g)"
    return OVERALL.replace(FRAMES, gated_frames)


@query(
    f"""SELECT * FROM ({_overall("usable AND passed").replace("SELECT b.grp,", "SELECT 'primary' AS status, b.grp,")})
UNION ALL BY NAME SELECT * FROM ({_overall("usable").replace("SELECT b.grp,", "SELECT 'candidate' AS status, b.grp,")})"""
)
def candidate_vs_primary(spark, d):
    f = gated(spark, d)
    primary = f.withColumn("valid", F.col("valid_primary"))
    candidate = gates.candidate_view(f, COUNTS, "usable").withColumn("valid", F.col("valid_primary"))
    iv = occupancy.intervals(candidate, GATES)  # those of the groups that passed are the primary ones, too
    passed = iv.join(f.where("passed").select("grp").distinct(), "grp", "left_semi")
    parts = [rounded(occupancy.overall(x, own)).withColumn("status", F.lit(s)) for s, x, own in (("primary", primary, passed), ("candidate", candidate, iv))]
    return parts[0].unionByName(parts[1])


@query(
    f"""WITH {GATED}, p AS (SELECT passed, CASE WHEN usable AND passed THEN left_count END AS l, CASE WHEN usable AND passed THEN right_count END AS r, NULL::INTEGER AS other FROM g)
SELECT count(*) FILTER (NOT passed AND (l IS NOT NULL OR r IS NOT NULL)) AS published_of_failed_groups, count(*) FILTER (other IS NOT NULL) AS never_published FROM p"""
)
def published_null_contract(spark, d):
    f = gated(spark, d).withColumn("other_count", F.lit(None).cast("int"))
    return integrity.published_nulls(f, f.select("grp", F.col("passed").alias("accepted")).distinct(), ["left_count", "right_count"], ["other_count"])


@query(
    f"""WITH {GATED} SELECT count(*) FILTER (NOT passed AND (left_count IS NOT NULL OR right_count IS NOT NULL)) AS published_of_failed_groups, count(*) FILTER (brightness IS NOT NULL) AS never_published FROM g"""
)
def published_null_breaches(spark, d):
    """The same check on counts that nobody has gated, where it must find them."""
    f = gated(spark, d).withColumns({"left_count": F.col("auto_left_count"), "right_count": F.col("auto_right_count")})
    return integrity.published_nulls(f, f.select("grp", F.col("passed").alias("accepted")).distinct(), ["left_count", "right_count"], ["brightness"])


def labelled(spark, d):
    """Documents as samples: sides are the labels quality and toxic, predicted by length; unlabelled ones are unresolved."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    predictions = docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("sample_id"), (F.col("n_chars") > 400).cast("int").alias("auto_left_count"), (F.col("n_chars") % 7 == 0).cast("int").alias("auto_right_count"))
    reference = docs.select("doc_id").join(labels, "doc_id", "left").select(F.col("doc_id").alias("sample_id"), F.col("quality").alias("left_count"), F.col("toxic").alias("right_count"))
    return validation.long_form(predictions, reference, "v1")


LONG = """l AS (SELECT 'v1' AS version, lang AS grp, d.doc_id AS sample_id, side, CASE side WHEN 'left' THEN quality ELSE toxic END AS reference_count,
  CASE side WHEN 'left' THEN (n_chars > 400)::INTEGER ELSE (n_chars % 7 = 0)::INTEGER END AS auto_count FROM documents d LEFT JOIN labels USING (doc_id), (VALUES ('left'), ('right')) s(side)),
long AS (SELECT *, auto_count - reference_count AS error FROM l)"""
METRICS = f"""{LONG}, m AS (SELECT version, grp, side, count(*) AS selected_samples, count(error) AS usable_reference_sides, avg(abs(error)) AS mae, avg((abs(error) <= 2)::INTEGER) AS within_two_fraction FROM long GROUP BY ALL),
metrics AS (SELECT *, selected_samples - usable_reference_sides AS unresolved_reference_sides, coalesce(usable_reference_sides > 0 AND mae <= 1 AND within_two_fraction >= 0.5, false) AS numerical_target,
  coalesce(usable_reference_sides > 0 AND mae <= 1 AND within_two_fraction >= 0.5, false) AND usable_reference_sides = 30 AS passed FROM m)"""


@query(f"WITH {LONG} SELECT * FROM long")
def validation_long(spark, d):
    return labelled(spark, d)


@query(f"WITH {METRICS} SELECT * REPLACE (round(mae, 6) AS mae, round(within_two_fraction, 6) AS within_two_fraction) FROM metrics")
def validation_metrics(spark, d):
    return rounded(validation.metrics(labelled(spark, d), VALIDATION, "v1"))


@query(f"WITH {METRICS} SELECT grp, count(*) = 2 AND bool_and(passed) AS accepted FROM metrics WHERE version = 'v1' GROUP BY grp")
def group_acceptance(spark, d):
    return validation.acceptance(validation.metrics(labelled(spark, d), VALIDATION, "v1"), "v1")


assert INTERVALS in OVERALL
