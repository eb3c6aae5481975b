"""Licence scan by a positional rare-token index, in DataFrame expressions only.

Templates of licence notices are cut into words, which are ranked by their inverse document frequency over all files.
The index maps the ANCHORS rarest words of each template's key phrase to their postings (template, position). A file's
places of such words are looked up, and the postings of each anchor are intersected by relative position: a template is
a candidate at an offset only where all its anchors stand at their distance from it. A candidate is verified by the key
phrase, which must stand there in full, and by the share of the template's IDF weight that stands at its place. As all
anchors are words of the key phrase, the intersection loses no notice, however many a file holds.

Texts are read and cut once: what the scan needs of a file (its number of words, the template words in it, and all its
words if some phrase may stand in it) goes to the shared folder. Everything about a file happens within its row; the
only shuffle counts template words over all files.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import Workspace

# The phrases whose places are counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices (label, words, first and last word of the key phrase within them).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2 0"),
]
LEAST_SCORE = 0.6
ANCHORS = 3  # words of a key phrase that the index holds; a shorter phrase has as many as it has words
WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between lower-cased words


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; an empty array for NULL."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), WORDS), lambda w: w != "")


def vocabulary() -> list[str]:
    return sorted({w for text in (*PHRASES, *(text for _, text, _ in TEMPLATES)) for w in text.split()})


def word_idf(files: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every template word over all files; files has terms, the template words of each."""
    found = files.select(F.explode(F.array_append("terms", F.lit(""))).alias("word"))
    counts = {r.word: r.n for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}  # one row a template word
    n = counts.get("", 0)
    return {w: log((n + 1) / (counts.get(w, 0) + 0.5)) for w in vocabulary()}


def base_places(words: Column) -> Column:
    """Array of (start, label) of the places of the base phrases, by start."""
    found = F.lit(None).cast("struct<at:int,label:string>")

    def here(w: Column, i: Column) -> Column:
        out = found
        for phrase, label in PHRASES.items():
            first, *rest = phrase.split()
            fits = w == first
            for k, word in enumerate(rest, 1):
                fits = fits & F.coalesce(F.get(words, i + k) == word, F.lit(False))
            out = F.when(fits, F.struct(i.cast("int").alias("at"), F.lit(label).alias("label"))).otherwise(out)
        return out

    return F.filter(F.transform(words, here), lambda x: x.isNotNull())


def key_start(text: str, key: str) -> int:
    """The place of the key phrase's first word in the template."""
    parts, own = text.split(), key.split()
    return next(i for i in range(len(parts)) if parts[i : i + len(own)] == own)


def anchors(idf: dict[str, float]) -> list[list[tuple[str, int]]]:
    """For each template the (word, position) of its anchors, the rarest first; the last one again where there are fewer."""
    out = []
    for _, text, key in TEMPLATES:
        own, at = key.split(), key_start(text, key)
        rare = sorted(range(len(own)), key=lambda k: (-idf[own[k]], k))[:ANCHORS]
        found = [(own[k], at + k) for k in rare]
        out.append(found + found[-1:] * (ANCHORS - len(found)))
    return out


def candidates(words: Column, idf: dict[str, float]) -> Column:
    """Array of (t, off): the templates all of whose anchors stand at their places from an offset of the file."""
    by_rank = list(zip(*anchors(idf), strict=True))
    indexed = sorted({w for own in by_rank for w, _ in own})
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*indexed), F.struct(w.alias("word"), i.alias("i")))), lambda x: x.isNotNull())

    def votes(own: tuple[tuple[str, int], ...]) -> Column:
        index: dict[str, list[tuple[int, int]]] = {}
        for t, (word, p) in enumerate(own):
            index.setdefault(word, []).append((t, p))
        none = F.array().cast("array<struct<t:int,off:int>>")

        def looked_up(x: Column) -> Column:
            out = none
            for word, postings in index.items():
                out = F.when(x["word"] == word, F.array(*[F.struct(F.lit(t).alias("t"), (x["i"] - p).alias("off")) for t, p in postings])).otherwise(out)
            return out

        return F.flatten(F.transform(places, looked_up))

    first, *others = [votes(own) for own in by_rank]
    for more in others:
        first = F.array_intersect(first, more)
    return first


def method_hits(words: Column, found: Column, idf: dict[str, float]) -> Column:
    """Array of (label, score) of the candidates that are verified in the file."""

    def verified(v: Column) -> Column:
        out = F.lit(None).cast("struct<label:string,score:double>")
        for t, (label, text, key) in enumerate(TEMPLATES):
            parts = text.split()
            total = sum(max(idf[w], 1e-6) for w in parts)
            at = key_start(text, key)
            stands = [F.when(v["off"] + p >= 0, F.coalesce(F.get(words, F.greatest(v["off"] + p, F.lit(0))) == w, F.lit(False))).otherwise(False) for p, w in enumerate(parts)]
            score = sum((F.when(s, max(idf[w], 1e-6) / total).otherwise(0.0) for s, w in zip(stands, parts, strict=True)), F.lit(0.0))
            whole = F.lit(True)
            for s in stands[at : at + len(key.split())]:
                whole = whole & s
            out = F.when((v["t"] == t) & whole, F.struct(F.lit(label).alias("label"), F.least(F.lit(1.0), F.round(score, 9)).alias("score"))).otherwise(out)
        return out

    return F.filter(F.transform(found, verified), lambda x: x.isNotNull() & (x["score"] >= LEAST_SCORE))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    docs has doc_id and text. A NULL or empty text has no words and no labels, score 0; texts of any length are read
    whole; a NULL doc_id is as good as another; repeated rows are scanned one by one; an empty table gives an empty
    result; other columns are not read, whatever their names. score is the best verified template's share of IDF
    weight (of equal ones it is the same), 1 where only base phrases stand and 0 where nothing does.
    """
    terms = F.array(*[F.lit(x) for x in vocabulary()])

    def holds_all(text: str) -> Column:
        found = F.lit(True)
        for word in sorted(set(text.split())):
            found = found & F.array_contains(F.col("terms"), word)
        return found

    has_base = has_key = F.lit(False)
    for phrase in PHRASES:
        has_base = has_base | holds_all(phrase)
    for _, _, key in TEMPLATES:
        has_key = has_key | holds_all(key)
    cut = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    cut = cut.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", terms).alias("terms"))
    words = F.when(has_base | has_key, F.col("words")).otherwise(F.array().cast("array<string>"))
    files = Workspace(docs.sparkSession, "licenses").keep(cut.select("doc_id", "n_words", "terms", words.alias("words")))
    idf = word_idf(files)
    none_base = F.array().cast("array<struct<at:int,label:string>>")
    none_found = F.array().cast("array<struct<t:int,off:int>>")
    out = files.select(
        "doc_id",
        "n_words",
        "words",
        F.when(has_base, base_places(F.col("words"))).otherwise(none_base).alias("base"),
        F.when(has_key, candidates(F.col("words"), idf)).otherwise(none_found).alias("found"),
    )
    out = out.select("doc_id", "n_words", "base", method_hits(F.col("words"), F.col("found"), idf).alias("hits"))
    base_labels = F.array_distinct(F.transform("base", lambda x: x["label"]))
    labels = F.array_union(base_labels, F.transform("hits", lambda x: x["label"]))
    best = F.array_max(F.transform("hits", lambda x: x["score"]))
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["at"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.coalesce(best, F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )
