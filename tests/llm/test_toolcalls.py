import json
import random

from framewright.llm import queries, toolcalls
from framewright.llm.common import Workspace
from framewright.llm.toolcalls import Argument

SCHEMAS = {"find": [Argument("q", "string", True, 1, 5), Argument("n", "integer", False, 0, 9)], "stop": []}
CALL = "conv_id long, place long, call_id string, tool string, arguments map<string,string>, after array<string>"
RESULT = "conv_id long, place long, call_id string, content string"


def listed(calls):
    return [(*c[:-1], [c[-1]] if isinstance(c[-1], str) else c[-1]) for c in calls]


def linked(spark, calls, results):
    calls = listed(calls)
    return {(r.conv_id, r.place): r for r in toolcalls.link(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), SCHEMAS).collect()}


def test_links_problems_and_json(spark):
    odd = 'a"\\\n é\x01'
    got = linked(
        spark,
        [
            (1, 0, "a", "find", {"q": "x", "n": "3"}, None),
            (1, 2, "b", "find", {"n": "12", "z": odd}, "a"),
            (1, 4, "c", "find", {"q": "toolong", "n": "x"}, "b"),
            (1, 6, "d", "other", {"q": ""}, "missing"),
            (1, 8, None, "stop", {}, "a"),
            (1, 10, "e", None, None, "e"),
            (1, 12, "f", "stop", None, "g"),
            (1, 14, "g", "stop", {}, "f"),
        ],
        [(1, 1, "a", odd), (1, 3, "b", None), (1, 5, "zz", "x"), (1, 7, None, "x")],
    )
    assert [got[1, p].depth for p in (0, 2, 4, 6, 8, 10, 12, 14)] == [0, 1, 2, 0, None, None, None, None]
    assert {p: got[1, p].status for p in (0, 2, 4, 8, 5, 7)} == {0: "linked", 2: "linked", 4: "unanswered", 8: "unnamed", 5: "orphan", 7: "orphan"}
    assert got[1, 0].errors == "" and got[1, 2].errors == "n: above 9; q: missing; z: unexpected" and got[1, 4].errors == "n: not an integer; q: above 5"
    assert got[1, 6].errors == "unknown tool" and got[1, 10].errors == "no arguments" and got[1, 14].errors == ""
    assert got[1, 0].json == '{"arguments":{"n":3,"q":"x"},"id":"a","name":"find","result":%s}' % json.dumps(odd, ensure_ascii=False).replace("\x01", "\\u0001")
    for row in got.values():
        if row.json is not None:
            assert json.dumps(json.loads(row.json), ensure_ascii=False, sort_keys=True, separators=(",", ":")) == row.json
    assert json.loads(got[1, 2].json)["arguments"]["z"] == odd and json.loads(got[1, 2].json)["result"] is None


def test_depths_of_long_chains_and_trees(spark):
    rng = random.Random(1)
    up = {i: i - 1 for i in range(1, 300)} | {1000 + i: 1000 + rng.randrange(i) for i in range(1, 300)}
    calls = [(str(k), str(v)) for k, v in up.items()] + [("0", None), ("1000", "nowhere")]
    rng.shuffle(calls)
    got = dict(toolcalls.depths(spark.createDataFrame(listed(calls), "call_id string, after array<string>"), Workspace(spark, "test")).collect())

    def depth(i):
        n = 0
        while i in up:
            i, n = up[i], n + 1
        return n

    assert got == {k: depth(int(k)) for k, _ in calls}


def test_calls_that_need_several(spark):
    rng = random.Random(2)
    needs = {i: sorted(rng.sample(range(i), min(i, rng.choice([0, 1, 1, 1, 2, 3])))) for i in range(120)}
    needs |= {200: [5, 200], 201: [200], 202: [203, 7], 203: [202], 204: [203, 3], 205: [9, 9, 999]}  # cycles, and what follows them
    calls = [(str(k), [str(u) for u in v] + [None]) for k, v in needs.items()]
    rng.shuffle(calls)
    got = dict(toolcalls.depths(spark.createDataFrame(calls, "call_id string, after array<string>"), Workspace(spark, "test")).collect())
    depth = {}
    for i in range(120):
        depth[i] = max((depth[u] + 1 for u in needs[i]), default=0)
    assert got == {str(k): d for k, d in depth.items()} | {"200": None, "201": None, "202": None, "203": None, "204": None, "205": depth[9] + 1}


def test_shared_identifiers_repeated_rows_and_empty_tables(spark):
    got = toolcalls.link(
        spark.createDataFrame(listed([(1, 0, "a", "stop", {}, None), (1, 0, "a", "stop", {}, None), (2, 0, "b", "stop", {}, "a")]), CALL).selectExpr("*", "1 status", "2 depth", "3 n"),
        spark.createDataFrame([(1, 3, "a", "y"), (1, 1, "a", "x"), (1, 1, "a", "x")], RESULT).selectExpr("*", "1 json"),
        SCHEMAS,
    ).collect()
    assert sorted((r.call_id, r.depth, r.status) for r in got if r.call_id == "a") == [("a", None, "linked")] * 2 + [("a", None, "repeated")]
    assert all('"result":"x"' in r.json for r in got if r.status == "linked")
    assert [(r.depth, r.status) for r in got if r.call_id == "b"] == [(0, "unanswered")]
    assert linked(spark, [], []) == {}
    assert [r.status for r in linked(spark, [], [(1, 1, "a", "x")]).values()] == ["orphan"]
    long = linked(spark, [(1, 0, "a", "find", {"q": "é" * 100000}, None)], [(1, 1, "a", "z" * 100000)])
    assert len(json.loads(long[1, 0].json)["result"]) == 100000 and long[1, 0].errors == "q: above 5"


def test_every_turn_has_a_row(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 1, "assistant", None)]
    turns += [(1, 2, "tool", "t"), (1, 3, None, "n"), (1, 3, None, "n"), (None, None, None, None), (2, 5, "assistant", "o"), (2, 5, "assistant", "o"), (None, 1, "assistant", "u")]
    got = queries.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    found = sorted(((r.conv_id, r.place, r.status) for r in got), key=repr)
    want = [(1, 0, "linked")] + [(1, 1, "repeated")] * 3 + [(1, 2, "other")] + [(1, 3, "other")] * 2 + [(None, None, "other")] + [(2, 5, "orphan")] * 2 + [(None, 1, "orphan")]
    assert found == sorted(want, key=repr)
    assert all(r.call_id is None and r.json is None for r in got if r.status == "other")
