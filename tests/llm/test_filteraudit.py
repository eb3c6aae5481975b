import itertools
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from framewright.llm import filteraudit, queries


def brute(docs, labels):
    """Every order applied to the documents one by one."""
    least = {}
    for d, _, t in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    rows = defaultdict(list)
    for d, source, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and d > least[text]}
        rows[source or ""].append(({f for f, x in failed.items() if x}, d in good and d is not None, d in toxic and d is not None))
    out, shapley = [], Counter()
    for part, own in rows.items():
        for order in itertools.permutations("ABCDE"):
            left = own
            for i, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                failing = sum(f in x[0] for x in own)
                shapley[part, f] += len(gone)
                out.append((part, "".join(order), i + 1, len(left), len(gone), failing - len(gone), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)))
    return sorted((*x, shapley[x[0], x[1][x[2] - 1]]) for x in out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def got(spark, docs, labels):
    docs = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 part", "2 fails", "'x' digest", "3 least")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'y' marks")
    return sorted(tuple(r) for r in filteraudit.audit_documents(docs.repartition(3), labels).select(*COLUMNS).collect())


def test_equals_brute_force_on_odd_rows(spark):
    many = " ".join(f"w{i}" for i in range(60))
    docs = [(1, "a", many), (2, "a", many), (2, "a", many), (3, None, None), (4, None, ""), (None, "b", ""), (None, None, many), (5, "b", "A B # " * 40), (6, "b", "é " * 70), (7, "b", "x " * 200000 + "X"), (8, "a", many.upper() + " |"), (8, "c", many)]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 1), (3, None, 1), (None, 1, 1), (5, 1, None), (8, 0, 0), (99, 1, 1), (6, 2, 1)]
    assert got(spark, docs, labels) == brute(docs, labels)
    assert len({r[0] for r in got(spark, docs, labels)}) == 4


def test_random_masks_equal_brute_force():
    rng = np.random.default_rng(3)
    codes = np.concatenate((np.arange(40), rng.integers(0, 3, 2000)))
    fails, marks = rng.integers(0, 32, len(codes)), rng.integers(0, 4, len(codes))
    found = filteraudit.subset_counts(codes, 40, fails, marks, 5)
    for part, subset, f in ((0, 0, 0), (1, 0b10010, 2), (2, 0b1111, 4), (17, 0b101, 1), (39, 0b11110, 0)):
        here = codes == part
        left = here & (fails & subset == 0)
        gone = left & (fails >> f & 1 == 1)
        assert found[part, subset, f].tolist() == [(left & ~gone).sum(), gone.sum(), (gone & (marks & 1 > 0)).sum(), (gone & (marks & 2 > 0)).sum()]


def test_many_parts_and_empty_tables(spark):
    docs = [(i, f"s{i % 5000}", "w" * (i % 7)) for i in range(6000)]
    rows = got(spark, docs, [])
    assert len(rows) == 5000 * 600 and sum(r[3] + r[4] for r in rows if r[2] == 1) == 120 * 6000
    assert got(spark, [], [(1, 1, 1)]) == []


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = sorted(con.sql(queries.OP11_SQL).select(*COLUMNS).fetchall())
    assert sorted(tuple(r) for r in queries.op11_filter_audit(spark, sf).select(*COLUMNS).collect()) == want
