import math

import numpy as np

from framewright.llm import neighbours


def brute(rows, every=100, count=10):
    good = {i: np.array(v, float) for i, v in rows if v is not None and i is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    ids = np.array(sorted(good))
    m = np.stack([good[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        d = np.sqrt(((m - good[q]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:count]
        out[int(q)] = [(int(ids[k]), float(d[k])) for k in order]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def test_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want, got = brute(rows), result(neighbours.search(table))
    assert set(want) == set(got)
    hit = sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.9
    vectors = dict(rows)
    for q, own in got.items():
        for v, d in own:
            assert math.isclose(d, np.sqrt(((np.array(vectors[q], float) - np.array(vectors[v], float)) ** 2).sum()), rel_tol=1e-12)


def test_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(200 + i, rng.normal(size=3).tolist()) for i in range(50)]
    rows += [(1000, None), (1100, [0.0, 0.0, 0.0]), (1200, [1.0, None, 2.0]), (1300, [float("nan"), 1.0, 1.0]), (1400, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (1500, [5.0]), (1600, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 rank", "2 score", "3 v")
    want = brute([r for r in rows if r[0] not in (1500, 1600)])
    got = result(neighbours.search(table))
    assert set(got) == set(want) == {0, 100, 200}  # 1500 is the only one of its dimension
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]


def test_few_rows_and_far_queries(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [500.0, 1e6]), (7, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {q: [v for v, _ in own] for q, own in result(neighbours.search(table)).items()} == {0: [7, 1, 100], 100: [1, 0, 7]}
    assert neighbours.search(table.limit(0)).count() == 0


def test_probes_are_complete_and_rising():
    x = np.array([0.1, 0.6, 0.45])
    found = neighbours.probes(x, 27)
    score = [sum((x[f] if s < 0 else 1 - x[f]) ** 2 for f, s in enumerate(moves) if s) for moves in found]
    assert len(found) == len({tuple(m) for m in found.tolist()}) == 27 and np.allclose(score, sorted(score)) and not found[0].any()
    rng = np.random.default_rng(1)
    for _ in range(20):  # of eight functions the chosen ones are nearly the best of all
        x = rng.random(8)
        moves = np.array(np.meshgrid(*[[-1, 0, 1]] * 8)).reshape(8, -1).T
        best = np.sort(np.where(moves < 0, x**2, np.where(moves > 0, (1 - x) ** 2, 0)).sum(axis=1))[:30]
        own = neighbours.probes(x, 30)
        got = np.where(own < 0, x**2, np.where(own > 0, (1 - x) ** 2, 0)).sum(axis=1)
        assert len(own) == 30 and (got <= best[-1] + 1e-9).sum() >= 27


def test_dimensions_keep_apart_and_crowded_buckets_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 20)
    monkeypatch.setattr(neighbours, "HUBS", 10)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 0.01 + 1).tolist()) for i in range(500)] + [(1000 + i, rng.normal(size=6).tolist()) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = result(neighbours.search(table))
    kept = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute([r for r in kept if len(r[1]) == 4]) | brute([r for r in kept if len(r[1]) == 6])
    assert set(got) == set(want) and all(len(own) == 10 for own in got.values())
    assert sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert all(v >= 1000 for v, _ in got[1000])


def test_repeated_rows_count_once_before_they_are_dealt(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(40, 8)).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)]
    schema = "vec_id long, embedding array<double>"
    hot = spark.createDataFrame(rows, schema).unionByName(spark.createDataFrame(rows[7:8], schema).join(spark.range(3000), how="cross").drop("id"))
    twice = hot.unionByName(spark.createDataFrame([(0, vectors[39])], schema))  # a query with two vectors
    got = neighbours.search(hot, every=10).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, neighbours.search(spark.createDataFrame(rows, schema), every=10).collect()))
    once = [sorted(map(tuple, neighbours.search(twice.repartition(n), every=10).collect())) for n in (1, 7)]
    assert once[0] == once[1]


def test_settings_measured_on_structured_vectors(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(100, 32))
    vectors = centres[rng.integers(0, 100, 6000)] + 0.2 * rng.normal(size=(6000, 32))
    rows = list(enumerate(vectors.tolist()))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).selectExpr("*", "1 v", "2 h")
    chosen = neighbours.settings(table)
    assert chosen == neighbours.settings(table.repartition(3))
    want, got = brute(rows), result(neighbours.search(table, **chosen))
    assert set(want) == set(got)
    assert sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want) >= 0.9 * 10 * len(want)
    order = np.concatenate((np.arange(0, 6000, 100), np.flatnonzero(np.arange(6000) % 100)))  # the queries first
    ((share, recall, _),) = neighbours.measured(vectors[order], choices=[tuple(chosen.values())])
    assert share < 0.1 and recall >= 0.9  # among all rows


def test_settings_of_odd_tables(spark):
    rng = np.random.default_rng(13)
    schema = "vec_id long, embedding array<float>"
    first = dict(zip(("functions", "width", "number"), neighbours.CHOICES[0], strict=True))
    for rows in ([], [(1, None), (None, [1.0]), (3, [0.0]), (4, [float("nan")])], [(1, [1.0, 2.0])] * 50):
        assert neighbours.settings(spark.createDataFrame(rows, schema)) == first
    mixed = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(i, rng.normal(size=3).tolist()) for i in range(300, 340)]
    chosen = neighbours.settings(spark.createDataFrame(mixed, schema), recall=0.9)
    assert tuple(chosen.values()) in neighbours.CHOICES
    hopeless = neighbours.settings(spark.createDataFrame(mixed, schema), recall=1.1)
    assert tuple(hopeless.values()) in neighbours.CHOICES
