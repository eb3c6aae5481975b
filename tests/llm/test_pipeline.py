import public_tokenizers

import corpus_pipeline
from framewright.llm import mixing, neardup, quality, toxicity
from tests.llm.test_neardup import brute


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_follow_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(None, "no id, but twelve words of text stand in this one, all told", "en", "s", 1), (10**6, None, None, None, None)], docs.schema)
    docs = docs.unionByName(odd)
    one = corpus_pipeline.quality_rules(spark, docs, sf)
    model = quality.model_for(docs, labels)
    kept = {r.doc_id for r in quality.judge(docs, model).where("kept").collect()}
    assert rows(one) == [x for x in rows(docs) if x[0] in kept]
    two = corpus_pipeline.toxic_documents(spark, one, sf)
    toxic = {r.doc_id for r in toxicity.score(one, toxicity.model_for(one, labels)).where("predicted = 1").collect()}
    assert rows(two) == [x for x in rows(one) if x[0] not in toxic]
    three = corpus_pipeline.near_duplicates(spark, two.unionByName(two.limit(5)), sf)
    texts = [(r.doc_id, r.text) for r in two.collect() if r.doc_id is not None]
    stay = {d for d, _, _, k in brute(texts, 5, 80) if k}
    assert [x for x in rows(three) if x[0] is not None] == [x for x in rows(two) if x[0] in stay]
    four = corpus_pipeline.target_mix(spark, three, sf)
    assert four.columns == docs.columns and set(rows(four)) == set(rows(three))
    assert rows(four) == rows(mixing.mixed(three, labels, corpus_pipeline.TARGETS, public_tokenizers.path("byte_bpe_50k.json")))
    five = corpus_pipeline.packed(spark, four, sf)
    assert sorted(r.doc_id or 0 for r in five.where("start + length > 0 and piece = 0").collect()) == sorted(r.doc_id or 0 for r in four.collect())


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
    assert neardup.BANDS * neardup.ROWS <= neardup.REGISTERS


def test_odd_rows_and_clashing_columns_pass_every_stage(spark, sf):
    names = ["text__", "n_tokens", "p0__", "posterior_0", "copy", "copy__", "rep", "score", "quality", "kept", "same_text", "length", "part"]
    some = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").collect()
    long = " ".join(f"word{i}" for i in range(60_000)) + " " * 30_000 + "end"
    rows = [tuple(r) for r in some] + [(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, long, "en", "s", len(long)), (None, "without an id this text of more than ten words stays as it is", "en", None, 1)]
    rows += rows[:2]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], kind)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        kept = [tuple(r) for r in out.collect()]
        assert set(kept) <= set(map(tuple, docs.collect())) and {10**6 + 2, None} <= {r[0] for r in kept}, name
        docs = spark.createDataFrame(kept, kind)
    pieces = corpus_pipeline.packed(spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in kept} and sum(r.piece == 0 for r in pieces) == len(kept)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf)
        assert out.count() == 0 and (name == "packing" or out.columns == columns), name
