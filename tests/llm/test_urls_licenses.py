import math
import random
import re

import pytest

from pyspark.sql import functions as F

from framewright.llm import licenses, queries, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_url_rules_and_list(spark):
    urls = {
        1: "https://WWW.Example.com/en/1",
        2: "http://example.com/en/2",
        3: "http://blog.example.com/en/3",
        4: "http://example.com",
        5: None,
        6: "no scheme",
        7: "https://spam-farm.example.org/en/7.html#top",
        8: "https://www.spam-farm.example.org/en/7?utm_source=feed",
        9: "https://good.example.org/en/7",
        10: "",
        11: "http://x.net/es/1",
    }
    pages = spark.createDataFrame([(k, v, "x") for k, v in urls.items()] + [(9, urls[9], "x")], "page_id long, url string, html string")
    listed = spark.createDataFrame([("https://spam-farm.example.org/en/7",), (None,)], "url string")
    out = urlfilter.judge(pages, listed, queries.URL_RULES)
    assert out.count() == len(urls) + 1
    got = rows(out, "page_id")
    assert {k: (v["rule"], v["verdict"]) for k, v in got.items()} == {
        1: ("www.example.com/en/", "allow"),
        2: ("example.com/en/", "block"),
        3: ("example.com/en/", "block"),
        4: (None, "allow"),
        5: (None, "allow"),
        6: (None, "allow"),
        7: (None, "block"),
        8: (None, "block"),
        9: (None, "allow"),
        10: (None, "allow"),
        11: ("net/es/", "block"),
    }
    assert (got[1]["host"], got[1]["path"], got[4]["path"], got[5]["host"]) == ("www.example.com", "/en/1", "", "")


def test_url_empty_tables_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "r", "b")], "page_id long, url string, rule string, block string")
    none = pages.limit(0)
    assert urlfilter.judge(none, none.select("url"), queries.URL_RULES).count() == 0
    assert [r.verdict for r in urlfilter.judge(pages, none.select("url"), queries.URL_RULES).collect()] == ["allow"]
    assert [r.verdict for r in urlfilter.judge(pages, pages.select("url"), queries.URL_RULES).collect()] == ["block"]


@pytest.mark.parametrize("blocks", [1, 1 << 17])
def test_bloom_has_no_false_negative(spark, monkeypatch, blocks):
    monkeypatch.setattr(urlfilter, "BROADCAST_BLOCKS", blocks)
    listed = spark.range(3000).selectExpr("concat('http://h', id, '.org/p') url")
    pages = spark.range(6000).selectExpr("id page_id", "concat('http://h', id, '.org/p') url")
    got = urlfilter.judge(pages, listed, [])
    assert urlfilter.bloom(listed)[1] == 256 and got.count() == 6000
    assert got.where("verdict = 'block'").count() == 3000 == got.where("verdict = 'block' and page_id < 3000").count()


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    base = []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(sorted({x for _, x in base})), words


def brute_idf(texts):
    holders = [set(brute(t)[5]) for t in texts]
    return {w: math.log((len(texts) + 1) / (sum(w in h for h in holders) + 0.5)) for w in licenses.vocabulary()}


def brute_labels(text, idf):
    """(labels, score) by trying every template at every offset of the file."""
    *_, base, words = brute(text)
    labels, scores = set(filter(None, base.split(","))), []
    for label, notice, key in licenses.TEMPLATES:
        parts, key = notice.split(), key.split()
        at = next(i for i in range(len(parts)) if parts[i : i + len(key)] == key)
        weight = [max(idf[w], 1e-6) for w in parts]
        for i in [i for i in range(len(words)) if words[i : i + len(key)] == key]:
            off = i - at
            share = sum(g for p, (w, g) in enumerate(zip(parts, weight, strict=True)) if 0 <= off + p < len(words) and words[off + p] == w) / sum(weight)
            if share >= licenses.LEAST_SCORE:
                labels.add(label)
                scores.append(min(1.0, round(share, 9)))
    return ",".join(sorted(labels)), max(scores, default=1.0 if base else 0.0)


def same_as_brute(docs):
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    idf = brute_idf([t for _, t in texts])
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 6)) for r in licenses.scan(docs).collect()), key=repr)
    want = [(d, *brute(t)[:5], *brute_labels(t, idf)) for d, t in texts]
    assert got == sorted(((*w[:-1], round(w[-1], 6)) for w in want), key=repr)
    return got


def test_license_scan_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "CC\nBY cc-by; All rights reserved. all RIGHTS-reserved"), (10**6 + 3, "cc by " * 5000), (10**6 + 4, "Released under the MIT License."), (10**6 + 4, "mit license only"), (None, "MIT License")]
    same_as_brute(docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).selectExpr("*", "1 words", "2 terms", "'x' found"))


def test_license_scan_equals_brute_force_on_mixed_notices(spark):
    rng = random.Random(6)
    notices = [text for _, text, _ in licenses.TEMPLATES]
    parts = notices + [key for _, _, key in licenses.TEMPLATES] + ["and so on", "source forms use 2 0", "cc by", "all rights reserved", "license version 3 mit", "license"]
    texts = []
    for _ in range(300):
        own = [rng.choice(parts) for _ in range(rng.randrange(1, 12))]
        words = " ".join(own).split()
        for _ in range(rng.randrange(3)):  # some words are lost, doubled or others
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([[], [words[i]] * 2, ["other"]])
            words = words or ["x"]
        texts.append(" ".join(words))
    got = same_as_brute(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sum(r[6].count(",") >= 2 for r in got) > 50


def test_license_finds_partial_notice_and_needs_key_phrase(spark):
    docs = spark.createDataFrame([(1, "This is licensed under the GNU General Public License, version 3."), (2, "released under the license of mit"), (3, "x")], "doc_id long, text string")
    got = rows(licenses.scan(docs.selectExpr("*", "1 words", "2 terms")))
    assert got[1]["labels"] == "gpl,gpl-3.0" and 0.6 <= got[1]["score"] < 1
    assert got[2]["labels"] == "" and got[3]["score"] == 0
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_finds_every_notice_of_a_file(spark):
    notices = [text for _, text, _ in licenses.TEMPLATES]
    names = [label for label, _, _ in licenses.TEMPLATES]
    pairs = [(i, j) for i in range(len(names)) for j in range(len(names)) if i != j]
    docs = [(0, " here ".join(notices))] + [(1 + k, f"{notices[i]} and so on {notices[j]}") for k, (i, j) in enumerate(pairs)]
    docs += [(1000 + k, "source terms use forms binary nc sa 2 0 " + text) for k, text in enumerate(notices)]
    got = {k: set(v["labels"].split(",")) for k, v in rows(licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"))).items()}
    assert set(names) <= got[0]
    assert all({names[i], names[j]} <= got[1 + k] for k, (i, j) in enumerate(pairs))
    assert all(names[k] in got[1000 + k] for k in range(len(names)))


def test_canonical_urls_of_many_slashes(spark):
    urls = {"http://www.a.com/x.html": "a.com/x", "http://m.a.com/x///": "a.com/x", "http://a.com/x.html/": "a.com/x.html", "http://a.com/.html": "a.com/", "http://a.com": "a.com", "http://a.com" + "/" * 200000 + "b": "a.com" + "/" * 200000 + "b", "http://a.com/" + "/" * 200000: "a.com"}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", urlfilter.canonical(F.col("url")).alias("c")).collect()
    assert {r.url: r.c for r in rows} == urls
