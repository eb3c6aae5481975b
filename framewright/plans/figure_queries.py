"""Queries over figures: written as SVG, read back, and counted, with SQL over the bins that they draw."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framewright.operators import occupancy, review
from framewright.plans import detection_queries, series_queries
from framewright.plans.bindings import FRAMES, SETTINGS, frames, rounded
from framewright.plans.registry import registry
from framewright.sources import figures
from framewright.staging import shared_dir, stage

QUERIES, SQL, query = registry()
NOTE = "automatic candidate, to be reviewed"


def _points(name: str, bins: str, segment: str) -> str:
    """The lines' points by column, and how many of them each side's lines keep, of a figure's bins."""
    return f"""{name}_b AS ({bins}), {name}_e AS (SELECT grp, greatest(max(end_hour), 0.1::DOUBLE) AS span FROM {name}_b GROUP BY grp),
{name}_s AS (SELECT grp, {segment} AS segment, (start_hour + end_hour) / 2 AS hour, unnest(['left', 'right']) AS side, unnest([left_mean, right_mean]) AS value FROM {name}_b),
{name}_p AS (SELECT s.*, least(floor(hour / span * 960), 959)::INTEGER AS col FROM {name}_s s JOIN {name}_e USING (grp) WHERE value IS NOT NULL),
{name}_k AS (SELECT grp, side, segment, col, len(list_distinct([
    {{'h': min(hour), 'v': arg_min(value, hour)}}, {{'h': max(hour), 'v': arg_max(value, hour)}},
    {{'h': min({{'v': value, 'h': hour}}).h, 'v': min(value)}}, {{'h': max({{'v': value, 'h': hour}}).h, 'v': max(value)}}])) AS kept FROM {name}_p GROUP BY ALL),
{name}_l AS (SELECT grp, side, segment, sum(kept) AS kept, min(col) AS c0, max(col) AS c1 FROM {name}_k GROUP BY ALL),
{name}_n AS (SELECT grp, side, count(*) FILTER (c0 < c1) + count(DISTINCT c0) FILTER (c0 = c1) AS paths, coalesce(sum(kept) FILTER (c0 < c1), 0) + 2 * count(DISTINCT c0) FILTER (c0 = c1) AS points FROM {name}_l GROUP BY ALL)"""


_SIDES = ", ".join(f"coalesce(max({n}.{c}) FILTER ({n}.side = '{s}'), 0)::INTEGER AS {s}_{o}" for n in ("n",) for s in ("left", "right") for c, o in (("paths", "paths"), ("paths", "moves"), ("points", "points")))
_NO_SIDES = ", ".join(f"0 AS {s}_{c}" for s in ("left", "right") for c in ("paths", "moves", "points"))
FIGURES = f"""WITH {FRAMES}, groups AS (SELECT DISTINCT grp FROM frames), labels AS ({detection_queries.SQL["splice_labels"]}),
{_points("ef", series_queries.SQL["rebin_600_effective"], "0")},
{_points("ac", series_queries.SQL["rebin_segmented"], "segment")},
h_b AS ({series_queries.SQL["rebin_3600_effective"]}), h_e AS (SELECT grp, greatest(max(end_hour), 0.1::DOUBLE) AS span FROM h_b GROUP BY grp),
cells AS (SELECT grp, side, col, max(end_hour) - min(start_hour) > 0.3 AND count(share) > 0 AS shown FROM (
  SELECT grp, start_hour, end_hour, least(floor(start_hour / span * 960), 959)::INTEGER AS col, unnest(['left', 'right']) AS side, unnest([left_share, right_share]) AS share FROM h_b JOIN h_e USING (grp)) GROUP BY ALL),
h AS (SELECT grp, count(*) AS cells, count(*) FILTER (shown) AS shares FROM cells GROUP BY grp),
marks AS (SELECT f, l.grp, count(*) FILTER (labelled) AS words, count(DISTINCT least(floor(hour / span * 960), 959)::INTEGER) AS ticks
  FROM labels l JOIN (SELECT 'curve_effective' AS f, * FROM ef_e UNION ALL SELECT 'heatmap', * FROM h_e) e ON l.grp = e.grp GROUP BY ALL)
SELECT 'curve_effective' AS figure, g.grp, '{NOTE}' AS note, (3 + coalesce(any_value(words), 0))::INTEGER AS texts, 1 AS titles, coalesce(any_value(words), 0)::INTEGER AS words, 0 AS shares, 0 AS empty,
  coalesce(any_value(ticks), 0)::INTEGER AS ticks, 0 AS cells, {_SIDES} FROM groups g LEFT JOIN ef_n n ON n.grp = g.grp LEFT JOIN marks m ON m.grp = g.grp AND f = 'curve_effective' GROUP BY g.grp
UNION ALL BY NAME SELECT 'curve_actual' AS figure, g.grp, '{NOTE}' AS note, 3 AS texts, 1 AS titles, 0 AS words, 0 AS shares, 0 AS empty, 0 AS ticks, 0 AS cells, {_SIDES} FROM groups g LEFT JOIN ac_n n ON n.grp = g.grp GROUP BY g.grp
UNION ALL BY NAME SELECT 'heatmap' AS figure, g.grp, '{NOTE}' AS note, (3 + coalesce(words, 0) + shares)::INTEGER AS texts, 1 AS titles, coalesce(words, 0)::INTEGER AS words, shares::INTEGER AS shares, 0 AS empty,
  coalesce(ticks, 0)::INTEGER AS ticks, cells::INTEGER AS cells, {_NO_SIDES} FROM groups g JOIN h ON h.grp = g.grp LEFT JOIN marks m ON m.grp = g.grp AND f = 'heatmap'"""


@query(FIGURES)
def figures_inspected(spark, d):
    """Every figure of every group, written, read back and counted."""
    f = frames(spark, d)
    iv = occupancy.intervals(f, SETTINGS)
    groups = stage(f.select("grp").distinct())
    spans = iv.groupBy("grp").agg((F.max("eff_end") / 1e6 / 3600).alias("hours"))
    labels = stage(rounded(review.splice_labels(occupancy.splice_map(iv, f), spans)))
    bins = stage(rounded(occupancy.rebin(iv, f, [600, 3600], ("effective",))))
    segments = stage(rounded(occupancy.rebin_segments(iv, f, 600)))
    folder = f"{shared_dir(spark)}/framewright-figures-{uuid.uuid4().hex}"
    drawn = figures.curves(bins.where("window_seconds = 600"), groups, NOTE, "effective", labels)
    drawn = drawn.unionByName(figures.curves(segments, groups, NOTE, "actual")).unionByName(figures.heatmap(bins.where("window_seconds = 3600"), groups, NOTE, labels))
    figures.write_figures(drawn, folder)
    return figures.inspected(figures.read_figures(spark, folder))
