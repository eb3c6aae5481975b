"""Queries over frames: inventory, intervals, bins, summaries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import inventory, occupancy
from framewright.plans.bindings import FRAMES, INTERVALS, SETTINGS, TIED, frames, rounded, tied_frames
from framewright.plans.registry import registry
from framewright.sources import writers

QUERIES, SQL, query = registry()
STEPS = "steps AS (SELECT grp, frame_id, t, (t - lag(t) OVER (PARTITION BY grp ORDER BY t, frame_id)) / 1e6 AS interval_s FROM frames)"


@query(f"WITH {TIED}, {STEPS} SELECT grp, frame_id, t, round(interval_s, 6) AS interval_s FROM steps")
def interval_lag(spark, d):
    return rounded(inventory.steps(tied_frames(spark, d)))


@query(f"WITH {FRAMES} SELECT grp, frame_id, round((t - min(t) OVER (PARTITION BY grp)) / 1e6, 6) AS elapsed_s FROM frames")
def elapsed(spark, d):
    return rounded(inventory.elapsed(frames(spark, d)))


@query(f"WITH {TIED} SELECT grp, frame_id, count(*) OVER (PARTITION BY grp, t) > 1 AS timestamp_duplicate FROM frames")
def duplicate_ts(spark, d):
    return inventory.duplicate_times(tied_frames(spark, d))


@query(f"WITH {FRAMES}, {STEPS} SELECT grp, frame_id, t, round(interval_s, 6) AS interval_s FROM steps WHERE interval_s > 1800")
def acquisition_gaps(spark, d):
    return rounded(inventory.acquisition_gaps(frames(spark, d), SETTINGS))


@query(
    f"""WITH {TIED}, {STEPS}, d AS (SELECT grp, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS dup FROM (SELECT grp, t, count(*) AS n FROM frames GROUP BY grp, t) GROUP BY grp)
SELECT grp, count(*) AS n, min(t) AS first_t, max(t) AS last_t, round((max(t) - min(t)) / 3.6e9, 6) AS elapsed_hours,
  round(coalesce(sum(CASE WHEN interval_s > 0 AND interval_s <= 1800 THEN interval_s END), 0) / 3600, 6) AS potentially_observed_hours,
  any_value(dup) AS timestamp_duplicates, count(*) FILTER (t IS NULL) AS metadata_errors FROM steps JOIN d USING (grp) GROUP BY grp"""
)
def inventory_summary(spark, d):
    return rounded(inventory.summary(tied_frames(spark, d), SETTINGS))


@query(f"WITH {TIED}, {STEPS} SELECT grp, interval_s AS seconds, count(*) AS n FROM steps WHERE interval_s IS NOT NULL GROUP BY ALL")
def interval_histogram(spark, d):
    return inventory.interval_histogram(tied_frames(spark, d)).withColumnRenamed("interval_s", "seconds")


@query(
    f"""WITH {FRAMES}, r AS (SELECT grp, frame_id, row_number() OVER (PARTITION BY grp ORDER BY t, frame_id) - 1 AS rank, count(*) OVER (PARTITION BY grp) AS n FROM frames),
w AS (SELECT DISTINCT grp, j::INTEGER AS j, round_even((j - 1) * (n - 1) / 19.0::DOUBLE, 0)::BIGINT AS rank FROM r, range(1, 21) x(j))
SELECT grp, frame_id, rank, j FROM r JOIN w USING (grp, rank)"""
)
def systematic_sample(spark, d):
    return inventory.systematic_sample(frames(spark, d))


@query(
    f"""WITH RECURSIVE {FRAMES}, r AS (SELECT grp, frame_id, row_number() OVER (PARTITION BY grp ORDER BY t, frame_id) - 1 AS rank, count(*) OVER (PARTITION BY grp) AS n FROM frames),
sizes AS (SELECT DISTINCT grp, n FROM r),
cal AS (SELECT grp, j::BIGINT AS j, round_even(j * (n - 1) / 19.0::DOUBLE, 0)::BIGINT AS rank FROM sizes, range(20) x(j)),
pick AS (SELECT s.grp, s.n, 0::BIGINT AS j, (SELECT list(rank) FROM cal WHERE cal.grp = s.grp) AS taken, NULL::BIGINT AS rank FROM sizes s
  UNION ALL SELECT grp, n, j + 1, list_append(taken, k), k FROM (
    SELECT grp, n, j, taken, least(n - 1, floor((j + 0.43::DOUBLE) * n / 30)::BIGINT
      + 7 * list_filter(range(0, 121), lambda m: len(list_filter(taken, lambda c: abs(floor((j + 0.43::DOUBLE) * n / 30)::BIGINT + 7 * m - c) <= 6)) = 0)[1]) AS k
    FROM pick WHERE j < 30)),
w AS (SELECT grp, 'calibration' AS split, grp || '_cal_' || lpad((j + 1)::VARCHAR, 2, '0') AS sample_id, rank FROM cal
  UNION ALL SELECT grp, 'holdout', grp || '_val_' || lpad(j::VARCHAR, 2, '0'), rank FROM pick WHERE j > 0)
SELECT r.grp, frame_id, split, sample_id, rank FROM r JOIN w USING (grp, rank)"""
)
def holdout_sample(spark, d):
    return inventory.samples(frames(spark, d), SETTINGS)



@query(
    f"""WITH {TIED}, {INTERVALS} SELECT grp, start_t, end_t, start_frame, end_frame, l0 AS left0, l1 AS left1, r0 AS right0, r1 AS right1, segment, eff_end, eff_start FROM iv"""
)
def intervals(spark, d):
    return occupancy.intervals(tied_frames(spark, d), SETTINGS)


@query(
    f"""WITH {FRAMES}, {INTERVALS} SELECT grp, segment, round(min(start_t - t0) / 1e6, 6) AS actual_start_s, round(max(end_t - t0) / 1e6, 6) AS actual_end_s, round(min(eff_start) / 1e6, 6) AS effective_start_s,
  round(max(eff_end) / 1e6, 6) AS effective_end_s, arg_min(start_frame, start_t) AS first_frame, arg_max(end_frame, end_t) AS last_frame FROM iv JOIN spans USING (grp) GROUP BY grp, segment"""
)
def splice_map(spark, d):
    f = frames(spark, d)
    return rounded(occupancy.splice_map(occupancy.intervals(f, SETTINGS), f))


@query(
    f"""WITH {TIED}, {INTERVALS}, g AS (SELECT *, lag(frame_id) OVER w AS before, lag(t) OVER w AS bt, lag(valid) OVER w AS bv FROM frames WINDOW w AS (PARTITION BY grp ORDER BY t, frame_id))
SELECT g.grp, before, frame_id AS after, round((bt - t0) / 1e6, 6) AS start_s, round((t - t0) / 1e6, 6) AS end_s, round((t - bt) / 1e6, 6) AS seconds,
  CASE WHEN t - bt > 1800000000 THEN 'acquisition_gap' ELSE 'quality_gap' END AS reason FROM g JOIN spans USING (grp) WHERE before IS NOT NULL AND (t - bt > 1800000000 OR NOT valid OR NOT bv)"""
)
def gap_rows(spark, d):
    return rounded(occupancy.gaps(tied_frames(spark, d), SETTINGS))


@query(
    f"""WITH {TIED}, g AS (SELECT *, t - lag(t) OVER w AS dt, lag(valid) OVER w AS bv, lag(sharpness) OVER w AS bs FROM frames WINDOW w AS (PARTITION BY grp ORDER BY t, frame_id)),
e AS (SELECT *, CASE WHEN valid AND bv AND dt > 0 AND dt <= 1800000000 THEN dt ELSE 0 END AS a, CASE WHEN sharpness >= 20 AND bs >= 20 AND dt > 0 AND dt <= 1800000000 THEN dt ELSE 0 END AS b FROM g)
SELECT grp, frame_id, round((sum(a) OVER w)::DOUBLE / 1e6, 6) AS primary_effective_elapsed_s, round((sum(b) OVER w)::DOUBLE / 1e6, 6) AS image_effective_elapsed_s
FROM e WINDOW w AS (PARTITION BY grp ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING)"""
)
def effective_elapsed(spark, d):
    f = tied_frames(spark, d).withColumn("sharp", F.col("sharpness") >= 20)
    return rounded(occupancy.valid_elapsed(f, SETTINGS, {"primary_effective_elapsed_s": "valid", "image_effective_elapsed_s": "sharp"}))


def bins_sql(step: int, axis: str, source: str = FRAMES, keyed: bool = False) -> str:
    p, q = ("eff_start", "eff_end") if axis == "effective" else ("start_t - t0", "end_t - t0")
    us = step * 1_000_000
    key = ", segment" if keyed else ""
    sums = f"""WITH {source}, {INTERVALS}, placed AS (SELECT iv.*, {p} AS p, {q} AS q FROM iv JOIN spans USING (grp)),
pieces AS (SELECT *, greatest(p, b * {us}) AS lo, least(q, (b + 1) * {us}) AS hi FROM (SELECT *, unnest(range(p // {us}, (q - 1) // {us} + 1)) AS b FROM placed)),
s AS (SELECT grp{key}, b, sum(hi - lo)::BIGINT AS obs, count(*) AS n,
  sum((l0 + (l1 - l0) * (lo - p) / (q - p) + l0 + (l1 - l0) * (hi - p) / (q - p)) / 2 * (hi - lo) / 1e6) AS ls,
  sum((r0 + (r1 - r0) * (lo - p) / (q - p) + r0 + (r1 - r0) * (hi - p) / (q - p)) / 2 * (hi - lo) / 1e6) AS rs FROM pieces GROUP BY grp{key}, b),
ends AS (SELECT grp, {"max(eff_end)" if axis == "effective" else "any_value(last)"} AS span FROM iv JOIN spans USING (grp) GROUP BY grp),
"""
    if keyed:
        return sums + f"""o AS (SELECT s.*, span, b * {us} AS st, least((b + 1) * {us}, span) AS en FROM s JOIN ends USING (grp)),
seg AS (SELECT grp, segment, min(start_t - t0) / 1e6 AS from_s, max(end_t - t0) / 1e6 AS to_s FROM iv JOIN spans USING (grp) GROUP BY grp, segment)"""
    return sums + f"""spine AS (SELECT grp, span, unnest(range(0, (span - 1) // {us} + 1)) AS b FROM ends),
o AS (SELECT spine.*, obs, n, ls, rs, spine.b * {us} AS st, least((spine.b + 1) * {us}, span) AS en FROM spine LEFT JOIN s ON spine.grp = s.grp AND spine.b = s.b)"""


MEASURES = """round(coalesce(obs, 0) / 1e6, 6) AS observed_seconds, round(coalesce(obs, 0) / (en - st), 6) AS coverage, coalesce(n, 0) AS interval_pieces,
  round(ls / (obs / 1e6), 6) AS left_mean, round(rs / (obs / 1e6), 6) AS right_mean, round(ls / 60 + 1e-9, 6) AS left_insect_minutes, round(rs / 60 + 1e-9, 6) AS right_insect_minutes,
  round(ls / nullif(ls + rs, 0), 6) AS left_share, round(rs / nullif(ls + rs, 0), 6) AS right_share"""


def bins_query(step: int, axis: str):
    def run(spark, d):
        f = frames(spark, d)
        return rounded(occupancy.rebin(occupancy.intervals(f, SETTINGS), f, [step], (axis,)))

    run.__name__ = f"rebin_{step}_{axis}"
    sql = bins_sql(step, axis)
    query(f"{sql} SELECT grp, {step} AS window_seconds, '{axis}' AS axis, b AS bin, round(st / 1e6, 6) AS start_s, round(en / 1e6, 6) AS end_s, round(st / 3.6e9, 6) AS start_hour, round(en / 3.6e9, 6) AS end_hour, {MEASURES} FROM o")(run)


for _step in (600, 3600, 86400):
    for _axis in ("effective", "actual"):
        bins_query(_step, _axis)


@query(SQL["rebin_3600_effective"])
def rebin_hourly_effective(spark, d):
    return QUERIES["rebin_3600_effective"](spark, d)


@query(
    f"""{bins_sql(600, "actual", keyed=True)} SELECT o.grp, o.segment, 600 AS window_seconds, 'actual' AS axis, b AS bin, round(greatest(st / 1e6, from_s), 6) AS start_s, round(least(en / 1e6, to_s), 6) AS end_s,
  round(greatest(st / 1e6, from_s) / 3600, 6) AS start_hour, round(least(en / 1e6, to_s) / 3600, 6) AS end_hour, {MEASURES} FROM o JOIN seg ON o.grp = seg.grp AND o.segment = seg.segment"""
)
def rebin_segmented(spark, d):
    f = frames(spark, d)
    return rounded(occupancy.rebin_segments(occupancy.intervals(f, SETTINGS), f, 600))


OVERALL = f"""WITH {FRAMES}, {INTERVALS}, w AS (SELECT grp, sum(end_t - start_t)::BIGINT AS obs, sum((l0 + l1) / 2 * (end_t - start_t) / 1e6) AS ls, sum((r0 + r1) / 2 * (end_t - start_t) / 1e6) AS rs FROM iv GROUP BY grp),
b AS (SELECT grp, count(*) AS n_images, count(*) FILTER (valid) AS n_valid, min(t) AS first_t, max(t) AS last_t FROM frames GROUP BY grp)
SELECT b.grp, n_images, n_valid, n_images - n_valid AS n_invalid, first_t, last_t, round((last_t - first_t) / 3.6e9, 6) AS actual_hours, round(coalesce(obs, 0) / 3.6e9, 6) AS effective_hours,
  round(coalesce(obs, 0) / nullif(last_t - first_t, 0), 6) AS coverage, round(ls / (obs / 1e6), 6) AS left_mean, round(rs / (obs / 1e6), 6) AS right_mean, round(ls / nullif(ls + rs, 0), 6) AS left_share,
  round(rs / nullif(ls + rs, 0), 6) AS right_share, round(ls / 60 + 1e-9, 6) AS left_insect_minutes, round(rs / 60 + 1e-9, 6) AS right_insect_minutes FROM b LEFT JOIN w USING (grp)"""


@query(OVERALL)
def overall(spark, d):
    f = frames(spark, d)
    return rounded(occupancy.overall(f, occupancy.intervals(f, SETTINGS)))


@query(
    f"""WITH {FRAMES}, {INTERVALS}, w AS (SELECT grp, sum(end_t - start_t) / 1e6 AS obs, sum((l0 + l1) / 2 * (end_t - start_t) / 1e6) / 60 AS ls, sum((r0 + r1) / 2 * (end_t - start_t) / 1e6) / 60 AS rs FROM iv GROUP BY grp)
SELECT grp, axis, window_seconds::INTEGER AS window_seconds, round(obs, 4) AS bin_seconds, round(ls, 4) AS bin_left, round(rs, 4) AS bin_right, abs(s - obs) < 1e-2 AND abs(l - ls) < 1e-2 AND abs(r - rs) < 1e-2 AS conserved
FROM w JOIN ({" UNION ALL ".join(f"SELECT grp, axis, window_seconds, sum(observed_seconds) AS s, sum(left_insect_minutes) AS l, sum(right_insect_minutes) AS r FROM ({SQL[f'rebin_{n}_{a}']}) GROUP BY ALL" for n in (600, 3600) for a in ("effective", "actual"))}) USING (grp)"""
)
def conservation_check(spark, d):
    f = frames(spark, d)
    iv = occupancy.intervals(f, SETTINGS)
    return rounded(occupancy.conservation(occupancy.rebin(iv, f, [600, 3600]), occupancy.overall(f, iv)), 4)


@query(f"SELECT grp, round(greatest(max(left_mean), max(right_mean)), 6) AS highest FROM ({SQL['rebin_600_effective']}) GROUP BY grp")
def curve_limit(spark, d):
    f = frames(spark, d)
    return rounded(writers.curve_limit(occupancy.rebin(occupancy.intervals(f, SETTINGS), f, [600], ("effective",))))


@query(f"SELECT grp, start_hour, end_hour, side, round(CASE side WHEN 'left' THEN left_share ELSE right_share END * 100, 4) AS percent FROM ({SQL['rebin_3600_effective']}), (VALUES ('left'), ('right')) s(side)")
def heatmap_cells(spark, d):
    f = frames(spark, d)
    cells = writers.heatmap(rounded(occupancy.rebin(occupancy.intervals(f, SETTINGS), f, [3600], ("effective",))))
    return cells.withColumn("percent", F.round("percent", 4))
