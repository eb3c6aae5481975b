"""Queries over detections, integrity and review, and their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators import detections, integrity, occupancy, review
from framewright.plans.bindings import FRAMES, INTERVALS, SETTINGS, TIED, frames, rounded, table, tied_frames
from framewright.plans.registry import registry
from framewright.sources import readers, writers
from framewright.staging import shared_dir

QUERIES, SQL, query = registry()

# --- detections: orders are frames, their lines detections -----------------------------------------------------------


def lines(spark, d):
    li = table(spark, d, "lineitem")
    z = detections.zone(F.col("l_quantity") * 1.2, F.col("l_extendedprice") / 40, F.lit(1200.0), 50, True)
    out = li.select(
        F.col("l_orderkey").alias("frame"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("id"), F.col("l_partkey").cast("double").alias("x"),
        (F.col("l_extendedprice") / 40).alias("y"), (F.col("l_quantity") * 1.2).alias("distance"), z.alias("zone"), (F.col("l_discount") * 20).alias("score"), (F.col("l_returnflag") == "R").alias("suspect"),
    )
    return out.withColumn("side", detections.side(F.col("zone"), F.col("x"), F.lit(1000.0)))


LINES = """p AS (SELECT l_orderkey AS frame, l_linenumber, l_partkey, l_extendedprice, l_partkey::DOUBLE AS x, l_extendedprice / 40 AS y, l_quantity * 1.2 AS distance, l_discount * 20 AS score, l_returnflag = 'R' AS suspect FROM lineitem),
z AS (SELECT *, CASE WHEN y >= 1200 THEN 'reflection_or_bottom' WHEN distance <= 50 AND y < 1180 THEN 'plant' WHEN y >= 1120 THEN 'bottom' ELSE 'other' END AS zone FROM p),
d AS (SELECT *, CASE WHEN zone <> 'plant' THEN '' WHEN x < 1000 THEN 'left' ELSE 'right' END AS side FROM z)"""
COUNTED = """c AS (SELECT frame, count(*) FILTER (side = 'left') AS auto_left_count, count(*) FILTER (side = 'right') AS auto_right_count, count(*) FILTER (zone IN ('other', 'bottom')) AS auto_other_count,
  count(*) FILTER (zone = 'reflection_or_bottom') AS reflection_or_bottom_count, count(*) FILTER (suspect) AS suspect_count FROM d GROUP BY frame)"""


@query(f"WITH {LINES} SELECT zone, side, count(*) AS n FROM d GROUP BY ALL")
def zone_case(spark, d):
    return lines(spark, d).groupBy("zone", "side").agg(F.count("*").alias("n"))


@query(f"WITH {LINES}, {COUNTED} SELECT * FROM c")
def side_counts(spark, d):
    return detections.side_counts(lines(spark, d))


@query(f"WITH {LINES}, {COUNTED} SELECT * FROM c")
def array_counts(spark, d):
    rows = lines(spark, d).groupBy("frame").agg(F.collect_list(F.struct("side", "zone", "suspect")).alias("detections"))
    return rows.select("frame", *[c.cast("long").alias(n) for n, c in detections.array_counts().items()])


@query(
    f"""WITH {LINES}, {COUNTED}, r AS (SELECT o_orderkey AS frame, (o_orderkey % 3)::BIGINT AS auto_left_count, (o_orderkey % 2)::BIGINT AS auto_right_count FROM orders)
SELECT r.frame, r.auto_left_count, r.auto_right_count, coalesce(c.auto_left_count, 0) AS l, coalesce(c.auto_right_count, 0) AS r FROM r LEFT JOIN c USING (frame)
WHERE r.auto_left_count <> coalesce(c.auto_left_count, 0) OR r.auto_right_count <> coalesce(c.auto_right_count, 0)"""
)
def count_vs_children(spark, d):
    recorded = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame"), (F.col("o_orderkey") % 3).alias("auto_left_count"), (F.col("o_orderkey") % 2).alias("auto_right_count"))
    return detections.count_mismatches(recorded, lines(spark, d))


@query(f"WITH {LINES} SELECT frame, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY frame ORDER BY x, y, l_linenumber, l_partkey, l_extendedprice)::INTEGER AS detection_id FROM d")
def detection_numbering(spark, d):
    return detections.numbered(lines(spark, d)).select("frame", "id.*", "detection_id")


@query(
    f"""WITH {LINES} SELECT frame, l_linenumber, l_partkey, l_extendedprice, array_to_string(list_filter([CASE WHEN zone = 'reflection_or_bottom' THEN 'below the surface or a reflection, not counted' END,
  CASE WHEN distance > 25 AND zone = 'plant' THEN 'edge of the plant' END, CASE WHEN y > 1080 THEN 'near the base or the surface' END, CASE WHEN score < 1.1 THEN 'low shape score' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM d"""
)
def detection_reasons(spark, d):
    found = detections.review_reasons(F.col("zone"), F.col("distance"), F.col("y"), F.lit(1200.0), F.col("score"))
    return lines(spark, d).select("frame", "id.*", F.array_join(found, "; ").alias("reasons"))


def points(spark, d):
    """Embeddings as points: frame is the label."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").cast("long").alias("frame"), F.col("vec_id").alias("id"), *[(F.get("embedding", F.lit(i)).cast("double") * s).alias(n) for n, i, s in (("x", 0, 1000), ("y", 1, 1000), ("score", 2, 1))])


POINTS = "pt AS (SELECT label::BIGINT AS frame, vec_id AS id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, embedding[3]::DOUBLE AS score FROM embeddings)"


@query(f"WITH {POINTS} SELECT frame, id, EXISTS (SELECT 1 FROM pt q WHERE q.frame = pt.frame AND q.id <> pt.id AND abs(q.x - pt.x) < 95 AND abs(q.y - pt.y) < 125) AS has_neighbour FROM pt")
def neighbour_flag(spark, d):
    return detections.with_neighbours(points(spark, d), 95.0, 125.0).select("frame", "id", "has_neighbour")


@query(
    f"""WITH RECURSIVE {POINTS}, o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, id) AS k FROM pt),
r AS (SELECT DISTINCT frame, 0::BIGINT AS k, NULL::BIGINT AS id, []::STRUCT(a DOUBLE, b DOUBLE)[] AS taken, false AS kept FROM pt
  UNION ALL SELECT frame, k, id, CASE WHEN free THEN list_append(taken, struct_pack(a := x, b := y)) ELSE taken END, free FROM (
    SELECT o.frame, o.k, o.id, o.x, o.y, r.taken, len(list_filter(r.taken, lambda p: pow((o.x - p.a) / 48, 2) + pow((o.y - p.b) / 82, 2) < 1)) = 0 AS free
    FROM r JOIN o ON o.frame = r.frame AND o.k = r.k + 1))
SELECT frame, id, kept FROM r WHERE k > 0"""
)
def nms_kept(spark, d):
    return detections.greedy(points(spark, d), 48.0, 82.0)


@query(
    f"""WITH RECURSIVE {POINTS}, o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY id) AS k FROM pt WHERE score <= 0.1),
r AS (SELECT frame, 0::BIGINT AS k, NULL::BIGINT AS id, list(struct_pack(a := x, b := y)) FILTER (score > 0.1) AS taken, false AS added FROM pt GROUP BY frame
  UNION ALL SELECT frame, k, id, CASE WHEN free THEN list_append(taken, struct_pack(a := x, b := y)) ELSE taken END, free FROM (
    SELECT o.frame, o.k, o.id, o.x, o.y, r.taken, coalesce(len(list_filter(r.taken, lambda p: abs(o.x - p.a) < 65 AND abs(o.y - p.b) < 100)), 0) = 0 AS free
    FROM r JOIN o ON o.frame = r.frame AND o.k = r.k + 1))
SELECT frame, id FROM r WHERE added"""
)
def supplement_blobs(spark, d):
    p = points(spark, d)
    return detections.supplement(p.where("score > 0.1"), p.where("score <= 0.1"))


@query(
    f"""WITH {LINES} SELECT frame, l_linenumber, l_partkey, l_extendedprice, CASE WHEN distance <= 50 AND y < 1180 THEN 'plant' WHEN y >= 1120 THEN 'bottom' ELSE 'other' END AS of_component,
  CASE WHEN y >= 1200 THEN 'reflection_or_bottom' WHEN distance <= 55 AND y < 1180 THEN 'plant' WHEN y >= 1120 THEN 'bottom' ELSE 'other' END AS of_window FROM p"""
)
def zone_variants(spark, d):
    zones = {n: detections.zone(F.col("distance"), F.col("y"), F.lit(1200.0), reach, r) for n, reach, r in (("of_component", 50, False), ("of_window", 55, True))}
    return lines(spark, d).select("frame", "id.*", *[z.alias(n) for n, z in zones.items()])


@query("SELECT l_orderkey AS frame_id, l_linenumber AS k, round(l_partkey * (4416.0::DOUBLE / (1000 + l_linenumber)), 6) AS x, round(l_suppkey * (4416.0::DOUBLE / (1000 + l_linenumber)), 6) AS y FROM lineitem")
def rescaled_points(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.array("l_partkey", "l_suppkey")).alias("p"))
    full = F.get(detections.rescale(F.col("p"), 1000 + F.col("l_linenumber")), F.lit(0))
    return li.select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("k"), F.round(F.get(full, F.lit(0)), 6).alias("x"), F.round(F.get(full, F.lit(1)), 6).alias("y"))


@query(
    f"""WITH {LINES} SELECT frame::VARCHAR AS frame_id, CASE WHEN frame % 2 = 0 THEN 'A' ELSE 'B' END AS "group", 'f' || frame AS source_path, l_linenumber AS detection_id, x, y, l_linenumber * 2 AS bbox_x, 3 AS bbox_y,
  l_linenumber + 20 AS bbox_width, 40 AS bbox_height, side, zone, score, CASE WHEN suspect THEN 'suspect; returned' ELSE '' END AS review_reasons, suspect FROM d"""
)
def coordinates(spark, d):
    box = F.array(F.col("id.l_linenumber") * 2, F.lit(3), F.col("id.l_linenumber") + 20, F.lit(40))
    why = F.when(F.col("suspect"), F.array(F.lit("suspect"), F.lit("returned"))).otherwise(F.array().cast("array<string>"))
    entry = F.struct(F.col("id.l_linenumber").alias("detection_id"), "x", "y", box.alias("bbox"), "side", "zone", "score", F.lit("gradients").alias("origin"), "suspect", why.alias("review_reasons"))
    rows = lines(spark, d).groupBy("frame").agg(F.collect_list(entry).alias("detections"))  # an order's lines
    rows = rows.select(F.col("frame").cast("string").alias("frame_id"), F.when(F.col("frame") % 2 == 0, "A").otherwise("B").alias("group"), F.concat(F.lit("f"), "frame").alias("source_path"), "detections")
    return detections.coordinates(rows).drop("origin")


@query(
    f"""WITH {POINTS} SELECT frame, id FROM pt WHERE score <= 0.1 AND abs(x) >= 10 AND NOT EXISTS (SELECT 1 FROM pt q WHERE q.frame = pt.frame AND q.score > 0.1 AND sqrt((q.x - pt.x) * (q.x - pt.x) + (q.y - pt.y) * (q.y - pt.y)) < 100)"""
)
def top_edge(spark, d):
    p = points(spark, d)
    candidates = p.where("score <= 0.1").select("frame", "id", "x", "y", F.lit(0).alias("box_y"), F.lit(500).alias("area"), F.when(F.abs("x") >= 10, 20).otherwise(0).alias("width"), F.lit(0.2).alias("peak"), F.lit(0.0).alias("chroma_median"), F.lit(1.0).alias("plant_distance"))
    return detections.top_edge(candidates, p.where("score > 0.1")).select("frame", "id")


# --- integrity -------------------------------------------------------------------------------------------------------


@query("WITH h AS (SELECT doc_id AS id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL) SELECT * FROM (SELECT sha256, count(*) OVER w AS n, min(id) OVER w AS first_id, id FROM h WINDOW w AS (PARTITION BY sha256)) WHERE n > 1")
def exact_duplicates(spark, d):
    return integrity.exact_duplicates(table(spark, d, "documents"), "doc_id", F.col("text"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume_anti(spark, d):
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return integrity.remaining(table(spark, d, "orders"), done, "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    """SELECT count(*) FILTER (d.doc_id IS NOT NULL) AS compared, count(*) FILTER (l.quality = d.n_chars % 2 AND l.toxic = d.n_chars // 1000 % 2) AS matched, count(*) FILTER (d.doc_id IS NULL) AS missing
FROM labels l LEFT JOIN documents d USING (doc_id)"""
)
def sample_agreement(spark, d):
    full = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).alias("quality"), (F.floor(F.col("n_chars") / 1000) % 2).alias("toxic"))
    return integrity.agreement(table(spark, d, "labels"), full, "doc_id", ["quality", "toxic"])


@query("SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 100")
def first_rows(spark, d):
    """The first hundred events: the limit is what the operator does."""
    return readers.first_rows(table(spark, d, "events"), 100, "ts", "event_id").select("event_id", "event_type")


@query("SELECT p_partkey::VARCHAR AS number, CASE WHEN p_size = 1 THEN 'one' WHEN p_size = 2 THEN 'two' ELSE p_size::VARCHAR END AS size, p_brand AS brand FROM part")
def labelled_table(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("p_size"), "p_brand")
    return writers.labelled(parts, {"p_partkey": "number", "p_size": "size", "p_brand": "brand", "p_none": "none"}, {"p_size": {"1": "one", "2": "two"}}, ("p_partkey",))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def sample_semi(spark, d):
    return integrity.sampled(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query(
    """WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT count(*) FILTER (b.k IS NULL) AS missing, count(*) FILTER (a.k IS NULL) AS extra, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS common, count(*) FILTER (b.k IS NULL OR a.k IS NULL) = 0 AS complete
FROM a FULL JOIN b ON a.k = b.k"""
)
def set_completeness(spark, d):
    return integrity.completeness(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("(SELECT 'left' AS side, nation.n_regionkey AS k FROM nation EXCEPT ALL SELECT 'left', r_regionkey FROM region) UNION ALL (SELECT 'right', r_regionkey FROM region EXCEPT ALL SELECT 'right', n_regionkey FROM nation)")
def set_difference(spark, d):
    return integrity.differences(table(spark, d, "nation").select(F.col("n_regionkey").alias("k")), table(spark, d, "region").select(F.col("r_regionkey").alias("k")))


@query(
    """WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS status, o_custkey AS c, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS p FROM orders),
b AS (SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_custkey END AS c, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END AS p FROM orders),
j AS (SELECT a.id, a.status AS s1, b.status AS s2, a.c AS c1, b.c AS c2, a.p AS p1, b.p AS p2 FROM a JOIN b USING (id))
SELECT id, 'status' AS reason, s1 AS actual, s2 AS expected FROM j WHERE s1 IS DISTINCT FROM s2
UNION ALL SELECT id, 'c', c1::VARCHAR, c2::VARCHAR FROM j WHERE s1 IS NOT DISTINCT FROM s2 AND c1 IS DISTINCT FROM c2
UNION ALL SELECT id, 'p', p1, p2 FROM j WHERE s1 IS NOT DISTINCT FROM s2 AND p1 IS DISTINCT FROM p2"""
)
def baseline_mismatch(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    a = o.select(key.alias("id"), F.when(key % 11 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_custkey").alias("c"), F.when(key % 5 != 0, F.col("o_orderpriority")).alias("p"))
    b = o.select(key.alias("id"), F.col("o_orderstatus").alias("status"), F.when(key % 7 == 0, -1).otherwise(F.col("o_custkey")).alias("c"), F.when(key % 10 != 0, F.col("o_orderpriority")).alias("p"))
    return integrity.mismatches(a, b, "id", ["status"], ["c", "p"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness(spark, d):
    return integrity.not_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT substr(sha256('{' || string_agg('"' || n_name || '": "' || sha256(n_name) || '"', ', ' ORDER BY n_name) || '}'), 1, 16) AS fingerprint FROM nation""")
def fingerprint(spark, d):
    return integrity.fingerprint(table(spark, d, "nation").select(F.col("n_name").alias("path"), F.sha2(F.col("n_name").cast("binary"), 256).alias("sha256")))


@query(
    """SELECT n_name AS path, CASE WHEN n_nationkey % 5 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 7 = 0"""
)
def manifest_check(spark, d):
    n = table(spark, d, "nation")
    recorded = n.select(F.col("n_name").alias("path"), F.sha2(F.col("n_name").cast("binary"), 256).alias("sha256"))
    actual = n.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("path"), F.sha2(F.when(F.col("n_nationkey") % 7 == 0, F.lit("x")).otherwise(F.col("n_name")).cast("binary"), 256).alias("sha256"))
    return integrity.manifest_check(recorded, actual)


@query("SELECT c_custkey, 'c_acctbal' AS columns FROM customer WHERE c_custkey % 9 = 0")
def table_comparison(spark, d):
    c = table(spark, d, "customer")
    other = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 9 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal") + 1e-10))
    return integrity.table_differences(c, other, ["c_custkey"]).select("c_custkey", F.array_join("columns", ",").alias("columns"))


# --- review ----------------------------------------------------------------------------------------------------------


@query(f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY sharpness, t, frame_id)::INTEGER AS rank FROM frames WHERE sharpness IS NOT NULL) SELECT grp, frame_id, sharpness, rank FROM r WHERE rank <= 3")
def priority_topk(spark, d):
    return review.top(frames(spark, d), F.col("sharpness"), 3).select("grp", "frame_id", "sharpness", "rank")


CHANGES = """ch AS (SELECT grp, frame_id, t, (t - lag(t) OVER w) AS dt, greatest(abs(left_count - lag(left_count) OVER w), abs(right_count - lag(right_count) OVER w)) AS change FROM frames WINDOW w AS (PARTITION BY grp ORDER BY t, frame_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY -change, t, frame_id)::INTEGER AS rank FROM ch WHERE dt > 0 AND dt <= 1800000000 AND change IS NOT NULL)"""


@query(f"WITH {TIED}, {CHANGES} SELECT grp, frame_id, change AS count_change, rank FROM top WHERE rank <= 3")
def count_change_top3(spark, d):
    return review.largest_changes(tied_frames(spark, d), SETTINGS).select("grp", "frame_id", "count_change", "rank")


BESIDE = "beside AS (SELECT grp, frame_id FROM (SELECT grp, frame_id, t - lag(t) OVER w AS b, lead(t) OVER w - t AS a FROM frames WINDOW w AS (PARTITION BY grp ORDER BY t, frame_id)) WHERE a > 1800000000 OR b > 1800000000)"


@query(f"WITH {FRAMES}, {BESIDE} SELECT grp, frame_id FROM beside")
def gap_neighbours(spark, d):
    return review.gap_neighbours(frames(spark, d), SETTINGS)


@query(
    f"""WITH {FRAMES}, {CHANGES}, {BESIDE}, f AS (SELECT *, frame_id % 50 AS suspect_count FROM frames),
u AS (SELECT frame_id, 'least sharp of its group' AS reason FROM (SELECT frame_id, row_number() OVER (PARTITION BY grp ORDER BY sharpness, t, frame_id) AS k FROM f WHERE sharpness IS NOT NULL) WHERE k <= 3
  UNION SELECT frame_id, 'most suspect detections of its group' FROM (SELECT frame_id, row_number() OVER (PARTITION BY grp ORDER BY -suspect_count, t, frame_id) AS k FROM f) WHERE k <= 3
  UNION SELECT frame_id, 'large change between adjacent frames' FROM top WHERE rank <= 3 UNION SELECT frame_id, 'beside an acquisition gap' FROM beside)
SELECT frame_id, string_agg(reason, '; ' ORDER BY reason) AS reason FROM u GROUP BY frame_id"""
)
def reason_union(spark, d):
    return review.priority(frames(spark, d).withColumn("suspect_count", F.col("frame_id") % 50), SETTINGS)


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k FROM conversations) WHERE k = 1")
def latest_review(spark, d):
    return review.latest(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")


@query(
    f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY t, frame_id) - 1 AS place, count(*) OVER (PARTITION BY grp) AS total FROM frames),
w AS (SELECT DISTINCT grp, i, greatest(0, least(total - 1, i)) AS place FROM r, (VALUES (-5), (0), (41), (150), (10000000)) v(i))
SELECT grp, i::INTEGER AS i, frame_id, t, place, total FROM w JOIN r USING (grp, place) WHERE grp IN ('view', 'error')"""
)
def page_lookup(spark, d):
    """Pages of a stored index: before the first place, the first, two inside, and past the last."""
    path = f"{shared_dir(spark)}/framewright-pages-{uuid.uuid4().hex}"
    review.write_pages(frames(spark, d), path)
    pages = [review.page(spark, path, g, i).select("grp", F.lit(i).alias("i"), "frame_id", "t", "place", "total") for g in ("view", "error") for i in (-5, 0, 41, 150, 10_000_000)]
    return reduce(DataFrame.unionByName, pages)


@query(
    f"""WITH RECURSIVE {FRAMES}, {INTERVALS}, sm AS (SELECT grp, segment, min(eff_start) / 1e6 / 3600 AS hour FROM iv GROUP BY ALL),
lim AS (SELECT grp, greatest(max(eff_end) / 1e6 / 3600 * 0.035, 0.3) AS least FROM iv GROUP BY grp),
o AS (SELECT sm.grp, hour, least, row_number() OVER (PARTITION BY sm.grp ORDER BY hour) AS k FROM sm JOIN lim USING (grp) WHERE segment > 1),
f AS (SELECT grp, hour, k, true AS labelled, hour AS last FROM o WHERE k = 1
  UNION ALL SELECT o.grp, o.hour, o.k, o.hour - f.last > o.least, CASE WHEN o.hour - f.last > o.least THEN o.hour ELSE f.last END FROM f JOIN o ON o.grp = f.grp AND o.k = f.k + 1)
SELECT grp, round(hour, 6) AS hour, labelled FROM f"""
)
def splice_labels(spark, d):
    f = frames(spark, d)
    iv = occupancy.intervals(f, SETTINGS)
    spans = iv.groupBy("grp").agg((F.max("eff_end") / 1e6 / 3600).alias("hours"))
    return rounded(review.splice_labels(occupancy.splice_map(iv, f), spans))


# --- small filters and aggregates ------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE NOT (l_partkey >= 0 AND l_partkey < 4416 AND l_extendedprice / 20 >= 0 AND l_extendedprice / 20 < 2488 AND l_quantity > 0 AND l_partkey + l_quantity <= 4416 AND l_extendedprice / 20 + l_quantity <= 2488)")
def box_outside(spark, d):
    li = table(spark, d, "lineitem")
    ok = detections.inside(F.col("l_partkey"), F.col("l_extendedprice") / 20, F.col("l_quantity"), F.col("l_quantity"))
    return li.where(~ok).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_discount * 10 >= 0.65 AND l_tax >= 0.07 AND l_quantity / 100 - 0.3 >= -0.055")
def candidate_acceptance(spark, d):
    ok = detections.accepted(F.col("l_discount") * 10, F.col("l_tax"), F.col("l_quantity") / 100 - 0.3)
    return table(spark, d, "lineitem").where(ok).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_extendedprice <= 12000 AND greatest(l_quantity, l_partkey % 60) >= 35 AND least(l_quantity, l_partkey % 60) >= 16 AND l_tax * 100 <= 5 AND l_discount * 10 >= 0.22 AS component,
  l_quantity >= 20 AND l_quantity <= 135 AND l_partkey % 60 >= 35 AND l_partkey % 60 <= 230 AND l_extendedprice >= 700 AND l_extendedprice <= 7500 AND l_discount * 10 >= 0.22 AS supplement FROM lineitem"""
)
def component_filters(spark, d):
    li = table(spark, d, "lineitem")
    w, h = F.col("l_quantity"), F.col("l_partkey") % 60
    first = detections.component_ok(F.col("l_extendedprice"), w, h, F.col("l_tax") * 100, F.col("l_discount") * 10)
    second = detections.supplement_ok(F.col("l_extendedprice"), w, h, F.col("l_discount") * 10)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", first.alias("component"), second.alias("supplement"))


@query("SELECT n_name, n_nationkey FROM nation WHERE n_nationkey % 4 = 0")
def hash_format(spark, d):
    n = table(spark, d, "nation").withColumn("sha256", F.when(F.col("n_nationkey") % 4 == 0, F.upper("n_name")).otherwise(F.sha2(F.col("n_name").cast("binary"), 256)))
    return integrity.bad_hashes(n).select("n_name", "n_nationkey")


@query('SELECT event_type AS "group", count(*) AS records, count(*) FILTER (value < 3) AS errors, round(sum(value), 6) AS seconds, round(count(*) / sum(value), 6) AS images_per_second FROM events GROUP BY event_type')
def batch_metrics(spark, d):
    from framewright.operators.counting import batch_metrics as metrics

    e = table(spark, d, "events")
    return rounded(metrics(e.select(F.col("event_type").alias("group"), F.when(F.col("value") < 3, "error").otherwise("processed").alias("status"), F.col("value").alias("processing_seconds"))))
