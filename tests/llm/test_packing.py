import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from framewright.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_gapless_and_tight(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    filled = defaultdict(list)
    runs = defaultdict(list)
    for length, rank, first, offset in packing.plan(histogram, 20):
        runs[length].append((rank, first, offset))
    for length, number in histogram.items():
        for r in range(number):
            rank, first, offset = [x for x in runs[length] if x[0] <= r][-1]
            filled[first + r - rank].append((offset, length))
    for own in filled.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 20
    assert sorted(filled) == list(range(len(filled)))
    # best fit by falling length, one piece at a time
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = min((b for b in bins if b >= n), default=None)
        if fit is None:
            bins.append(20 - n)
        else:
            bins[bins.index(fit)] -= n
    assert len(filled) <= len(bins)


def test_encoder_equals_the_file_library():
    random.seed(5)
    exact, enc = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    texts = ["", " ", "a b", "<|endoftext|> x", "naïve Ünï ²³¼ ½x", "日本語 ١٢٣", "x" * 5000, " " * 5000 + "a", "I'll 'LL ʼn ǅ", "\r\n\t\x0b\x1c\x85 a"]
    texts += ["".join(random.choice("ab é'1²_ \n\t.!ß\x00\x1f ǲ") for _ in range(300)) for _ in range(200)]
    for t in texts:
        assert enc.ids(t).tolist() == exact.encode(t, add_special_tokens=False).ids


def test_pack_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").withColumnRenamed("x", "x")
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "é" * 40000), (10**6 + 3, "again"), (10**6 + 3, "again")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "1 length", "'a' rank")
    exact = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for r in docs.collect():
        ids = [*exact.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())].append(1)
    got, sequences = defaultdict(list), defaultdict(list)
    total = 0
    for r in packing.pack(docs, PATH).collect():
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32].append(1)
        sequences[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert got == want
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[-1][0] + own[-1][1] <= 1024
    assert len(sequences) <= 1.02 * -(-total // 1024) + 1
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_very_long_runs_through_spark(spark):
    texts = [" " * 2_000_000 + "x", "\n" * 2_000_000, "x" * 2_000_000, "a" + "\t " * 600_000 + "b", "short", None, " " * 9_999 + "x", "x" + " " * 10_001]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    exact = Tokenizer.from_file(PATH)
    n = [len(exact.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
    got = defaultdict(int)
    for r in packing.pack(docs, PATH).collect():
        got[r.doc_id] += r.length
    assert [got[i] for i in range(len(texts))] == n
