import logging

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from framewright.llm import mixing, wordpiece
from framewright.llm.queries import MIX_TARGETS

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_rates_meet_targets_and_equal_brute_force(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.01")
    domains = mixing.fit_domains(docs, labels, sorted(MIX_TARGETS))
    m = mixing.with_posteriors(docs.select("doc_id", "text"), domains, PATH)
    m.table = m.table.drop("text").cache()
    targets = [MIX_TARGETS[d] for d in domains.names]
    rate, gaps = mixing.fit_rates(m, targets)
    rows = m.table.withColumn("rate", rate).collect()
    tokens = np.array([r[m.tokens] for r in rows], float)
    counted = {r.doc_id: r.n_tokens for r in wordpiece.count(docs, PATH).collect()}
    assert all(r[m.tokens] == counted[r.doc_id] for r in rows)
    p = np.array([[r[c] for c in m.posteriors] for r in rows])
    gram = (p * tokens[:, None]).T @ p
    weight = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    r = np.ones(len(rows))
    for _ in range(len(gaps) - 1):
        gap = (tokens * r) @ p - np.array(targets) * tokens.sum()
        r = np.maximum(0, r - p @ (weight @ gap))
    assert np.allclose(r, [x.rate for x in rows], rtol=1e-9, atol=1e-9) and (r >= 0).all()
    share = (tokens * r) @ p / tokens.sum()
    assert np.abs(share - targets).max() < 1e-3 and gaps[-1] < gaps[0]


def test_classifier_is_right_on_rows_it_has_not_seen(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.01")
    got = mixing.rates(docs, labels, MIX_TARGETS, PATH).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").join(labels, "doc_id", "left_anti")
    rows = got.where("n_chars > 100").collect()
    assert sum(r.domain == r.lang for r in rows) >= 0.97 * len(rows)


def test_mixed_rows_follow_rates_and_keep_every_document(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.01")
    out = mixing.mixed(docs, labels, MIX_TARGETS, PATH)
    assert out.columns == docs.columns
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    tokens = {r.lang: r.n for r in out.groupBy("lang").agg(F.sum("n_chars").alias("n")).collect()}
    before = {r.lang: r.n for r in docs.groupBy("lang").agg(F.sum("n_chars").alias("n")).collect()}
    off = lambda x: sum(abs(x[d] / sum(x.values()) - t) for d, t in MIX_TARGETS.items())
    assert off(tokens) < 0.5 * off(before) + 0.05


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "en", 5), (2, "", None, 6), (2, "", None, 6), (None, "the x", "en", 7)], "doc_id long, text string, lang string, rate int")
    labels = spark.createDataFrame([], "doc_id long")
    got = mixing.rates(docs, labels, MIX_TARGETS, PATH)
    assert got.count() == 4 and got.where("rate is null or rate < 0").count() == 0
    assert mixing.rates(docs.limit(0), labels, MIX_TARGETS, PATH).count() == 0
    assert mixing.mixed(docs.limit(0), labels, MIX_TARGETS, PATH).count() == 0
    assert mixing.mixed(docs, labels, MIX_TARGETS, PATH).columns == docs.columns


def test_mixed_keeps_every_document_of_a_domain_at_five_times_its_target(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.01")
    tokens = {r.lang: r.n for r in docs.groupBy("lang").agg(F.sum("n_chars").alias("n")).collect()}
    times = round((sum(tokens.values()) - tokens["es"]) / tokens["es"])
    more = docs.where("lang = 'es'").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times - 1))))
    more = more.withColumn("doc_id", F.col("doc_id") * 1000 + F.col("k") + 10**9).select(*docs.columns)
    skewed = docs.unionByName(more)
    targets = {"de": 0.15, "en": 0.6, "es": 0.1, "fr": 0.15}
    out = mixing.mixed(skewed, labels, targets, PATH).select("doc_id", "lang", "n_chars").cache()
    assert out.select("doc_id").distinct().count() == skewed.count()
    got = {r.lang: r.n for r in out.groupBy("lang").agg(F.sum("n_chars").alias("n")).collect()}
    share = {d: got[d] / sum(got.values()) for d in targets}
    assert all(abs(share[d] - t) < 0.05 for d, t in targets.items()), share


def test_rates_step_until_targets_are_met_and_report_the_gap(spark):
    # posteriors of two domains overlap, so that the steps of one direction are short
    rows = [(i, 100, 0.5 + (0.06 if i % 2 else -0.06)) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, n long, p double").withColumn("q", 1 - F.col("p"))
    table = mixing.Membership(table.cache(), "n", ["p", "q"])
    rate, gaps = mixing.fit_rates(table, [0.54, 0.46])
    table = table.table
    got = table.select((F.col("n") * rate * F.col("p")).alias("a"), (F.col("n") * rate).alias("b")).agg(F.sum("a"), F.sum("b")).first()
    assert abs(got[0] / 4000 - 0.54) + abs((got[1] - got[0]) / 4000 - 0.46) < 2 * mixing.TOLERANCE and gaps[-1] < mixing.TOLERANCE
    out, unmet = mixing.fit_rates(mixing.Membership(table, "n", ["p", "q"]), [0.99, 0.01])  # can't be met: the nearest is reached
    assert unmet[-1] > mixing.TOLERANCE and table.select(out.alias("r")).where("r is null or r < 0").count() == 0
    docs, labels = tables(spark, "/root/testdata/sf0.001")
    found = mixing.rates(docs, labels, MIX_TARGETS, PATH).select("gap").distinct().collect()
    assert len(found) == 1 and 0 <= found[0].gap < 0.01


def test_columns_of_any_name_pass_through(spark):
    names = ["n_tokens", "n_tokens__", "p0__", "posterior_0", "Posterior_1", "copy", "copy__", "rate", "t", "col"]
    docs = spark.createDataFrame([(i, f"the words of {i}", "en", *range(len(names))) for i in range(5)], "doc_id long, text string, lang string, " + ", ".join(f"{n} int" for n in names))
    labels = spark.createDataFrame([(1,), (2,)], "doc_id long")
    out = mixing.mixed(docs, labels, MIX_TARGETS, PATH)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} == {tuple(r) for r in docs.collect()}
    assert {r.n_tokens for r in mixing.rates(docs, labels, MIX_TARGETS, PATH).collect()} == {4}


def test_targets_out_of_reach_are_reported(spark, caplog):
    docs, labels = tables(spark, "/root/testdata/sf0.001")
    german = docs.where("lang = 'de'")
    with caplog.at_level(logging.WARNING):
        out = mixing.mixed(german, labels, {"de": 0.01, "en": 0.99}, PATH)
    assert "off target" in caplog.text and out.select("doc_id").distinct().count() == german.select("doc_id").distinct().count()


@pytest.mark.parametrize("tokens", [1, 2, 3, 7, 13, 50])
def test_rates_end_where_posteriors_leave_no_choice(spark, tokens):
    kinds = {"equal": [[0.25] * 4], "collinear": [[0.7, 0.1, 0.1, 0.1]] * 3, "two": [[0.5, 0.5, 0.0, 0.0], [0.0, 0.0, 0.5, 0.5]], "nan": [[float("nan")] * 4, [0.25] * 4]}
    for name, posteriors in kinds.items():
        table = spark.createDataFrame([(tokens, *p) for p in posteriors], "t long, a double, b double, c double, d double")
        _, gaps = mixing.fit_rates(mixing.Membership(table, "t", ["a", "b", "c", "d"]), [0.4, 0.3, 0.2, 0.1])
        assert 1 <= len(gaps) <= 5, (name, gaps)
