import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import wordpiece


def greedy(word, pieces):
    n = 0
    while word:
        size = next((k for k in range(min(len(word), 64), 0, -1) if word[:k] in pieces), 0)
        if not size:
            return -1
        word, n = word[size:], n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12), st.lists(st.text("abcd", max_size=12), max_size=8))
def test_automaton_equals_greedy(pieces, words):
    pieces, words = {p.encode() for p in pieces}, [w.encode() for w in words]
    machine = wordpiece.build(sorted(pieces))
    ends = np.cumsum([len(w) for w in words]).astype(int)
    starts = ends - [len(w) for w in words]
    got = machine.counts(np.frombuffer(b"".join(words), np.uint8), starts, ends)
    assert got.tolist() == [greedy(w, pieces) for w in words] == [machine.word(w) for w in words]


def test_counts_equal_brute_force(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = set(wordpiece.byte_vocabulary(path))
    assert {bytes([b]) for b in range(256)} <= pieces
    random.seed(3)
    odd = [None, "", " ", "日本語 テキスト", "x" * 3000, "".join(random.choice("abé$9") for _ in range(2000)), "a\x0bb\tc\nd\re\x0cf g"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").withColumnRenamed("lang", "n_tokens")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t, "x") for i, t in enumerate(odd)] + [(1, "again", "x")], "doc_id long, text string, n_tokens string"))
    got = [(r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in wordpiece.count(docs, path).collect()]
    memo = {}

    def tokens(w):
        if w not in memo:
            memo[w] = greedy(b" " + w.encode(), pieces)
        return memo[w]

    want = []
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        want.append((r.doc_id, len(words), sum(map(tokens, words)), 0))
    assert sorted(got) == sorted(want)
    assert wordpiece.count(docs.limit(0), path).count() == 0


def test_unknown_words():
    machine = wordpiece.build([b"ab", b"c"])
    assert machine.word(b"abc") == 2 and machine.word(b"a") == -1 and machine.word(b"") == 0
    with pytest.raises(FileNotFoundError):
        wordpiece.byte_vocabulary("/nowhere")


def test_long_words_are_linear():
    import time

    machine = wordpiece.automaton(public_tokenizers.path("byte_bpe_50k.json"))
    random.seed(4)
    text = "".join(random.choice("abcdeé") for _ in range(400_000)).encode()
    data, ends = np.frombuffer(text * 2, np.uint8), np.array([len(text), 2 * len(text)])
    began = time.monotonic()
    got = machine.counts(data, ends - len(text), ends)
    assert time.monotonic() - began < 5 and got[0] == got[1]
    pieces = set(wordpiece.byte_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    assert machine.counts(data, np.array([0]), np.array([5000])).tolist() == [greedy(text[:5000], pieces)]
