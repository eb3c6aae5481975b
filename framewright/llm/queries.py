"""The registered queries of this subpackage, with production parameters, and SQL for those that SQL expresses."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import filteraudit, licenses, mixing, neardup, neighbours, packing, quality, secretscan, toolcalls, toxicity, turnrepair, urlfilter, wordpiece

# The rules of the URL query.
URL_RULES = [
    urlfilter.Rule("allow", "com", "/"),
    urlfilter.Rule("block", "example.com", "/en/"),
    urlfilter.Rule("allow", "www.example.com", "/en/"),
    urlfilter.Rule("block", "net", "/es/"),
    urlfilter.Rule("block", "net", "/fr/"),
]
# The host labels whose pages make up the URL list.
LISTED_HOSTS = r"(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# What the arguments of a turn's call must be.
TURN_SCHEMAS = {
    "reply": [toolcalls.Argument("text", "string", True, 1, 400), toolcalls.Argument("turn", "integer", True, 0, 99)],
    "system": [toolcalls.Argument("text", "string", True, 1, 400), toolcalls.Argument("turn", "integer", True, 0, 0)],
}


def turn_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as calls and results: a user's or system's turn calls for a reply, an assistant's turn gives it.

    The identifier of a call is its conversation and turn; a turn of the assistant has the identifier of the turn before it,
    and a call needs the call two turns earlier.
    """
    of = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    calls = turns.where(F.col("role").isin("user", "system")).select(
        "conv_id",
        F.col("turn").alias("place"),
        F.when(known, of(F.col("turn"))).alias("call_id"),
        F.when(F.col("role") == "user", "reply").otherwise("system").alias("tool"),
        F.map_filter(F.create_map(F.lit("text"), F.col("text"), F.lit("turn"), F.col("turn").cast("string")), lambda _, v: v.isNotNull()).alias("arguments"),
        F.array(F.when(known, of(F.col("turn") - 2))).alias("after"),
    )
    results = turns.where(F.col("role") == "assistant").select("conv_id", F.col("turn").alias("place"), F.when(known, of(F.col("turn") - 1)).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def format_turns(turns: DataFrame) -> DataFrame:
    """link() over all turns; a turn whose role is neither a call's nor a result's has a row of status other.

    Its call_id, depth, errors and json are NULL.
    """
    linked = toolcalls.link(*turn_calls(turns), TURN_SCHEMAS, copies=True)
    empty = {"call_id": "string", "depth": "long", "status": "string", "errors": "string", "json": "string"}
    rest = turns.where(~F.coalesce(F.col("role").isin("user", "system", "assistant"), F.lit(False)))
    return linked.unionByName(rest.select("conv_id", F.col("turn").alias("place"), *[F.lit("other" if c == "status" else None).cast(t).alias(c) for c, t in empty.items()]))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of all conversations as linked, ordered, validated calls in canonical JSON."""
    return format_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of every document."""
    return wordpiece.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth one."""
    return neighbours.search(table(spark, sf_dir, "embeddings"))


# The share of tokens that each domain is to have.
MIX_TARGETS = {"de": 0.2, "en": 0.5, "es": 0.12, "fr": 0.18}


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of every document at which the domains, as predicted from its text, have their target shares."""
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX_TARGETS, public_tokenizers.path("byte_bpe_50k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the fixed rules and, where none fits, by the list of the known bad hosts' pages."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(urlfilter.host_of(F.col("url")).rlike(LISTED_HOSTS)).select("url")
    return urlfilter.judge(pages.select("page_id", "url"), listed, URL_RULES).drop("listed")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and learnt quality of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge(docs, quality.model_for(docs, labels))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents: 3-word shingles, 85 percent of the union in common."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled rows that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.model_for(docs, labels))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the five filters removes in every order, by source, over all documents."""
    return filteraudit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: the fixed patterns' and the models'."""
    docs = table(spark, sf_dir, "documents")
    return secretscan.scan(docs, secretscan.model_for(docs))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after the damage of the query."""
    return turnrepair.repair(turnrepair.damaged(table(spark, sf_dir, "conversations")))


OP1_SQL = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn AS place, conv_id::VARCHAR || ':' || turn::VARCHAR AS call_id, conv_id::VARCHAR || ':' || (turn - 2)::VARCHAR AS after,
    CASE role WHEN 'user' THEN 'reply' ELSE 'system' END AS tool, text, turn
  FROM conversations WHERE role IN ('user', 'system')),
results AS (
  SELECT conv_id, turn AS place, conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
depths AS (
  SELECT call_id, 0::BIGINT AS depth FROM calls WHERE after NOT IN (SELECT call_id FROM calls)
  UNION ALL SELECT c.call_id, d.depth + 1 FROM calls c JOIN depths d ON c.after = d.call_id),
checked AS (
  SELECT *, array_to_string(list_sort(list_filter([
    CASE WHEN text IS NULL THEN 'text: missing' END, CASE WHEN length(text) < 1 THEN 'text: below 1' END, CASE WHEN length(text) > 400 THEN 'text: above 400' END,
    CASE WHEN turn < 0 THEN 'turn: below 0' END,
    CASE WHEN tool = 'reply' AND turn > 99 THEN 'turn: above 99' WHEN tool = 'system' AND turn > 0 THEN 'turn: above 0' END], lambda x: x IS NOT NULL)), '; ') AS errors,
    '{"arguments":{' || CASE WHEN text IS NOT NULL THEN '"text":' || to_json(text)::VARCHAR || ',' ELSE '' END || '"turn":' || turn || '},"id":' || to_json(call_id)::VARCHAR || ',"name":"' || tool || '","result":' AS head
  FROM calls)
SELECT c.conv_id, c.place, c.call_id, d.depth, CASE WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, c.errors,
  c.head || CASE WHEN r.content IS NULL THEN 'null' ELSE to_json(r.content)::VARCHAR END || '}' AS json
FROM checked c LEFT JOIN depths d USING (call_id) LEFT JOIN results r USING (call_id)
UNION ALL
SELECT conv_id, place, call_id, NULL, 'orphan', NULL, NULL FROM results WHERE call_id NOT IN (SELECT call_id FROM calls)
"""
OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(regexp_replace(coalesce(regexp_extract(url, '^(?s:.*?)://[^?#]*\?([^#]*)', 1), ''), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS query
  FROM pages),
c AS (
  SELECT *, CASE WHEN regexp_replace(host, '^(www|m)\.', '') <> '' THEN regexp_replace(host, '^(www|m)\.', '')
    || regexp_replace(path, '(\.html|/+)$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM p),
listed AS (
  SELECT DISTINCT canonical FROM c
  WHERE regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.') AND canonical IS NOT NULL),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT c.page_id, c.url, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM (SELECT DISTINCT page_id, url, host, path FROM c) c JOIN r ON (c.host = r.rhost OR ends_with(c.host, '.' || r.rhost)) AND starts_with(c.path, r.rpath)
  GROUP BY c.page_id, c.url)
SELECT c.page_id, c.host, c.path, b.rule,
  coalesce(b.verdict, CASE WHEN c.canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best b ON c.page_id IS NOT DISTINCT FROM b.page_id AND c.url IS NOT DISTINCT FROM b.url
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    doc_id > min(doc_id) OVER (PARTITION BY text) AS e FROM d),
l AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, {
    'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(e, false)} AS f
  FROM w LEFT JOIN l USING (doc_id)),
p AS (
  SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (
  SELECT filter_order, step::INT AS step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM orders, range(1, 6) r(step)),
t AS (
  SELECT *, CASE own WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END AS fails,
    (f.A AND contains(before, 'A')) OR (f.B AND contains(before, 'B')) OR (f.C AND contains(before, 'C')) OR (f.D AND contains(before, 'D')) OR (f.E AND contains(before, 'E')) AS gone,
    f.A::INT + f.B::INT + f.C::INT + f.D::INT + f.E::INT AS failed
  FROM p, steps),
c AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND failed = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM t GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM c
"""


def queries() -> dict:
    named = [op1_chat_format, op2_token_counts, op3_nearest_neighbours, op4_source_mixing, op5_packing, op6_url_filter, op7_quality_rules, op8_near_duplicates, op9_toxicity, op10_license_scan]
    named += [op11_filter_audit, op12_secret_scan, op13_turn_repair]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op6_url_filter": OP6_SQL, "op11_filter_audit": OP11_SQL}
