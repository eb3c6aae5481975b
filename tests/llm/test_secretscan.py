import hashlib
import re

import numpy as np

from framewright.llm import linear, queries, secretscan

KEYWORD = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)


def brute(text):
    """The fixed patterns, position by position."""
    text, out = text or "", []
    for kind, pattern, enough in (
        ("assign", KEYWORD, lambda m: len(m.group(2)) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 24),
    ):
        at = 0
        while at <= len(text):
            m = pattern.match(text, at)
            if m and m.group().isascii():
                if enough(m):
                    out.append((m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}"))
                at = m.end()
            else:
                at += 1
    return [x for _, _, x in sorted(out)]


ODD = [
    None, "", " ", "token=ab", "token=token=abcdef", 'token:token ="abcdefgh"', "API_KEY : 'a.b-c+d/e_f' apikey=123456", "é\U0001f600 password = \"hunter2hunter2\"", "paſsword=abcdefgh toKen=abcdefgh",
    "AKIA" + "A" * 15, "AKIA" + "Z9" * 8, "xAKIAAKIA" + "Q" * 40, "a" * 23, "0" * 24 + "g" + "f" * 30, "A1" * 15, "secret=" + "0a" * 20, "password\n=abcdefg", "passwd=" + "x" * 300000, "token=\t123456", "secret  :  =====" + "AKIA" * 6,
    "The_quick_brown_fox_jumps_over_the_lazy_dog", "plain words only", "SECRET" + " " * 9 + "=" + " " * 9 + "abcdef,secret=abcdef",
]


def test_base_spans_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(ODD, 10**6)) + [(None, "token=abcdef"), (None, "token=abcdef")], "doc_id long, text string"))
    model = secretscan.model_for(docs)
    rows = secretscan.scan(docs.selectExpr("*", "1 spans", "2 n_hex", "'z' base_sha256"), model).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = []
    for d, text in texts:
        base = brute(text)
        want.append((str(d), *[sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")], hashlib.sha256(",".join(base).encode()).hexdigest(), tuple(base)))
    got = [(str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, tuple(x for x in r.spans.split(",") if x and not x.startswith("random"))) for r in rows]
    assert sorted(got) == sorted(want)
    for r in rows:  # what the models add is judged by every character's own ratio, and overlaps nothing
        text = next((t for d, t in texts if d == r.doc_id), None) or ""
        spans = [x.split(":") for x in r.spans.split(",") if x]
        covered = [(int(a), int(b)) for k, a, b in spans if k != "random"]
        expected = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
            if len(m.group()) >= 20 and all(b <= m.start() or a >= m.end() for a, b in covered):
                codes = [secretscan.ALPHABET.index(c) for c in m.group()]
                mean = sum(model.ratio[p, c] for p, c in zip([len(secretscan.ALPHABET), *codes], codes, strict=False)) / len(codes)
                if mean > secretscan.THRESHOLD:
                    expected.append([str(m.start()), str(m.end())])
        assert [x[1:] for x in spans if x[0] == "random"] == expected


def test_held_out_strings_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = secretscan.model_for(docs)
    rng = np.random.default_rng(99)
    words = [w for r in docs.where("doc_id % 50 = 7").collect() for w in re.findall("[A-Za-z]{3,12}", r.text)]
    ordinary = [rng.choice(["_", "-", "/", "+", ""]).join(rng.choice(words, 6)) for _ in range(500)]
    ordinary += ["".join(w.capitalize() for w in rng.choice(words, 6)) for _ in range(500)]
    ordinary = [x for x in ordinary if len(x) >= 20]
    false = np.mean([model.score(x) > secretscan.THRESHOLD for x in ordinary])
    assert false <= 0.02
    for alphabet in secretscan.KEY_ALPHABETS:
        strings = ["".join(rng.choice(list(alphabet), rng.integers(24, 41))) for _ in range(300)]
        assert np.mean([model.score(x) > secretscan.THRESHOLD for x in strings]) >= 0.97, alphabet


def test_sample_is_bounded_and_tables_may_be_empty(spark):
    same = spark.range(20000).selectExpr("7L doc_id", "concat('word ', id % 3) text")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(linear.bounded_texts(same.unionByName(spark.createDataFrame([(8, "other"), (None, "none")], "doc_id long, text string")), 10)) == [(7, "word 0"), (8, "other")]
    labels = spark.range(20000).selectExpr("7L doc_id", "1 quality")
    assert rows(linear.labelled_sample(same, labels, "quality", 10)) == [(7, 1, "word 0")]
    assert rows(linear.domain_sample(same.selectExpr("*", "'en' lang"), labels, ["de", "en"], "lang", 500)) == [(7, "en", "word 0")]
    empty = same.limit(0)
    model = secretscan.model_for(empty)
    assert not model.ratio.any() and secretscan.scan(empty, model).count() == 0
    assert [r.spans for r in secretscan.scan(spark.createDataFrame([(1, "Q7" * 30)], "doc_id long, text string"), model).collect()] == [""]


def test_query(spark, sf):
    assert queries.op12_secret_scan(spark, sf).count() == 200
