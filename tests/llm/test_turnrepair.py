import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from framewright.llm import queries, turnrepair
from framewright.llm.turnrepair import Fold, Run

SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        kept = text.strip(SPACE)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows):
    """The cheapest edits by a plain shortest path over (row, role before), a letter at a time, by cost and then audit."""
    fault = faults(rows)
    grammar = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {(0, ""): (0, "", ())}
    queue = [(0, "", 0, "", ())]
    done = set()
    while queue:
        queue.sort()
        cost, audit, at, before, lines = queue.pop(0)
        if (at, before) in done:
            continue
        done.add((at, before))
        best[at, before] = (cost, audit, lines)
        nxt = []
        if at < len(rows):
            role, text = rows[at]
            nxt.append((4, "D", at + 1, before, lines))
            if fault[at] not in ("blank", "duplicate"):
                extra = 3 if fault[at] == "truncated" else 0
                if role[:1] and role[:1] in grammar[before]:
                    nxt.append((extra, "K", at + 1, role[:1], (*lines, f"{role}:{text}")))
                nxt += [(3 + extra, "R", at + 1, r[0], (*lines, f"{r}:{text}")) for r in ("user", "assistant") if r[0] in grammar[before] and r[0] != role[:1]]
        nxt += [(3, "I", at, r[0], (*lines, f"{r}:")) for r in ("user", "assistant") if r[0] in grammar[before]]
        queue += [(cost + c, audit + x, a, b, t) for c, x, a, b, t in nxt]
    cost, audit, lines = min(best[len(rows), b] for b in ("", "a") if (len(rows), b) in best)
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def exhaustive(rows):
    """All sequences of edits of a short conversation."""
    fault, found = faults(rows), []
    inserts = [()] + [x for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    letters = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in fault]
    for edits in itertools.product(*letters):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            audit, roles, cost = "", "", 0
            for i, gap in enumerate(gaps):
                for r in gap:
                    audit, roles, cost = audit + "I", roles + r, cost + 3
                if i < len(rows):
                    e = edits[i]
                    audit += e[0]
                    roles += "" if e == "D" else rows[i][0][:1] if e == "K" else e[1]
                    cost += {"D": 4, "K": 0, "R": 3}[e[0]] + (3 if e != "D" and fault[i] == "truncated" else 0)
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, audit))
    return min(found)


def random_rows(rng, n):
    return [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", " ", "Why?", f"{rng.random()}."])) for _ in range(n)]


def folded(rows, size):
    fold, fault = Fold(), faults(rows)
    for lo in range(0, max(len(rows), 1), size):
        run = Run(lo == 0)
        for i in range(lo, min(lo + size, len(rows))):
            run.add(i, *rows[i], fault[i])
        fold.add(run)
    r = fold.result()
    return r["cost"], r["audit"], r["repaired_sha256"]


def test_programme_equals_search_and_all_edits():
    rng = random.Random(5)
    for n in [0, 1, 1, 2, 2, 2] * 20:
        rows = random_rows(rng, n)
        assert folded(rows, 2)[:2] == exhaustive(rows)
    for _ in range(300):
        rows = random_rows(rng, rng.randint(0, 14))
        want = search(rows)
        for size in (1, 3, 100):
            assert folded(rows, size) == want


def expected(table):
    """The query's rows from (conv_id, turn, role, text), one conversation after the other."""
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        convs[conv] += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        pairs = [r[1:] for r in rows]
        fault, turns = faults(pairs), [r[0] for r in rows if r[0] is not None]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((str(conv), gaps, *[fault.count(f) for f in ("blank", "duplicate", "truncated")], illegal, *search(pairs)))
    return sorted(out)


def result(spark, table):
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").selectExpr("*", "1 code", "2 digest", "3 fault", "4 place")
    rows = turnrepair.repair(turnrepair.damaged(df.repartition(3))).collect()
    return sorted((str(r.conv_id), r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows)


def test_odd_tables(spark):
    table = [(None, None, None, None), (None, 3, "user", "Hi."), (5, None, "user", None), (5, None, "assistant", "A."), (6, 4, None, "x" * 3000000), (6, 9, "user", "y."), (6, 9, "user", "y."), (6, 9, "user", "z."), (6, 9, "", "q.")]
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table += [(dropped, 0, "user", "Hello.")] + [(2000 + i, t, r, f"{i}{t}.") for i in range(60) for t, r in enumerate(["system", "user", "assistant", "user"][: 1 + i % 4])]
    got = result(spark, table)
    assert got == expected(table)
    assert next(r for r in got if r[0] == str(dropped))[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert result(spark, []) == []


def test_one_long_conversation_is_cut_into_runs(spark):
    rng = random.Random(8)
    table = [(1, t, *row) for t, row in enumerate(random_rows(rng, 6000))] + [(2, t, *row) for t, row in enumerate(random_rows(rng, 700))] + [(c, 0, "user", "Hi.") for c in range(3, 40)]
    got = result(spark, table)
    small = [r for r in table if r[0] != 1]
    assert [r for r in got if r[0] != "1"] == expected(small)
    damaged = []
    for conv, turn, role, text in table[:6000]:
        code = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        damaged += [("user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)] * (0 if code == 0 else 2 if code == 3 else 1)
    assert next(r for r in got if r[0] == "1")[6:] == folded(damaged, 10**6)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query_equals_search(spark, folder):
    table = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = queries.op13_turn_repair(spark, folder).collect()
    got = sorted((str(r.conv_id), r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows)
    assert got == expected(table)
