"""Repair of conversation structure: the cheapest edits that give a role sequence `(s?(ua)+)?`.

A programme over the turns chooses which to retain, as they are or with another role. Between two retained turns all are
deleted, which a prefix sum of deletion costs prices, and the pair of their roles says what is inserted. So for each role
only a running minimum is kept: the cheapest way whose last retained turn has that role, less the deletions up to it.
Ways of equal cost are told apart by their audits, the letters of their edits.

A conversation of any length is cut into runs of rows. A run's ways from each role before it to each role after it are a
small table, and tables of consecutive runs compose like those of single turns, so that the rows of one conversation are
worked on by many tasks. Only the composition and the hash of the repaired text, which is sequential by its nature, go
through a conversation in order, a run at a time, with one state a role.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import Workspace

# Costs, and the letters of the audit, whose order breaks ties.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
SPACES = " \t\n\x0b\x0c\r"
#: What is inserted between a last retained role ('' is none) and the next; pairs that are missing can't be mended.
BETWEEN = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "a"): 0, ("u", "u"): 1, ("a", "u"): 0, ("a", "a"): 1}
CLOSING = {"": 0, "a": 0, "u": 1, "s": 2}  # inserted after the last retained role
LEGAL = ("su", "ua", "au")
RUN_ROWS, RUN_BYTES = 256, 1 << 20  # of a run; a longer single text is a run of its own
HELD = 8  # runs of a conversation that may still end within its task

Way = tuple[int, str]  # cost, audit


def damaged(turns: DataFrame) -> DataFrame:
    """The damage of the query: one row a turn after it, with dropped set in those that stand for a dropped turn."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("dropped"), F.explode(copies).alias("copy"))


def _fault(duplicate: Column) -> Column:
    kept = F.rtrim(F.col("text"), F.lit(SPACES))
    truncated = ~F.substring(kept, -1, 1).isin(".", "!", "?")
    return F.when(kept == "", "blank").when(duplicate, "duplicate").when(truncated, "truncated").otherwise("")


def step(ways: dict[str, Way], initial: str, fault: str) -> dict[str, Way]:
    """The ways after one more turn, from those before it; costs are less the deletion of every turn so far."""
    out = {role: (cost, audit + "D") for role, (cost, audit) in ways.items()}
    if fault in ("blank", "duplicate"):
        return out
    extra = TRUNCATED if fault == "truncated" else 0
    for role in ("s", "u", "a"):
        if role != initial and role == "s":
            continue
        letter, price = ("K", 0) if role == initial else ("R", REROLE)
        for before, (cost, audit) in ways.items():
            n = BETWEEN.get((before, role))
            if n is not None:
                own = (cost + n * INSERT + price + extra - DELETE, audit + "I" * n + letter)
                if role not in out or own < out[role]:
                    out[role] = own
    return out


def repaired(rows: list[tuple[str, str]], audit: str, before: str) -> bytes:
    """What a run gives of the repaired text after a turn of role before: `role:text`, each after a newline but the first."""
    out, at = [], 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        role, text = ("assistant" if before == "u" else "user"), ""
        if letter != "I":
            role, text = rows[at][0] if letter == "K" else role, rows[at][1]
            at += 1
        out.append(f"{role}:{text}" if not before and not out else f"\n{role}:{text}")
        before = role[:1]
    return "".join(out).encode()


@dataclass
class Run:
    """Consecutive rows of one conversation: its ways by (role before, role after), and what the counts need."""

    whole: bool  # begins the conversation: only the role before that is none
    rows: list[tuple[str, str]] = field(default_factory=list)
    size: int = 0
    counts: dict[str, int] = field(default_factory=lambda: {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0})
    initials: tuple[str, str] | None = None  # of the first and the last row
    turns: tuple[int, int, int] | None = None  # first and last that is not NULL, how many distinct

    def __post_init__(self) -> None:
        self.ways = {before: {before: (0, "")} for before in (("",) if self.whole else ("", "s", "u", "a"))}

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        self.ways = {before: step(ways, initial, fault) for before, ways in self.ways.items()}
        if fault:
            self.counts[fault] += 1
        if self.initials:
            self.counts["illegal"] += self.initials[1] + initial not in LEGAL
        self.initials = (self.initials[0] if self.initials else initial, initial)
        if turn is not None:
            first, last, n = self.turns or (turn, turn, 1)
            self.turns = (first, turn, n + (turn != last))
        self.rows.append((role, text))
        self.size += len(text)

    def full(self, size: int) -> bool:
        return bool(self.rows) and (len(self.rows) >= RUN_ROWS or self.size + size > RUN_BYTES)


class Fold:
    """Composes the runs of a conversation in order; one cost, audit and hash for each role that may stand last."""

    def __init__(self) -> None:
        # role: cost less deletions, audit as nested pairs, hash so far; in the order of their audits, which differ
        # before the end of the shorter, as a way's last letter is never an insertion
        self.states: list[tuple[str, int, tuple | None, object]] = [("", 0, None, hashlib.sha256())]
        self.n = 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.last, self.turns = None, None

    def add(self, run: Run) -> None:
        best: dict[str, tuple[int, int, str]] = {}
        for place, (before, cost, _, _) in enumerate(self.states):
            for after, (more, audit) in run.ways.get(before, {}).items():
                own = (cost + more, place, audit)
                if after not in best or own < best[after]:
                    best[after] = own
        states = []
        for after, (cost, place, audit) in sorted(best.items(), key=lambda x: x[1][1:]):
            before, _, path, digest = self.states[place]
            digest = digest.copy()
            digest.update(repaired(run.rows, audit, before))
            states.append((after, cost, (path, audit), digest))
        self.states = states
        self.n += len(run.rows)
        for c, n in run.counts.items():
            self.counts[c] += n
        if run.initials:
            if self.last is not None:
                self.counts["illegal"] += self.last + run.initials[0] not in LEGAL
            self.last = run.initials[1]
        if run.turns:
            first, last, n = self.turns or (run.turns[0], run.turns[0], 1)
            self.turns = (first, run.turns[1], n + run.turns[2] - (last == run.turns[0]))

    def result(self) -> dict:
        cost, _, state = min((s[1] + CLOSING[s[0]] * INSERT, place, s) for place, s in enumerate(self.states))
        closing = "I" * CLOSING[state[0]]
        audit, path = [closing], state[2]
        while path is not None:
            audit.append(path[1])
            path = path[0]
        digest = state[3].copy()
        digest.update(repaired([], closing, state[0]))
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return {"gaps": gaps, **self.counts, "cost": cost + DELETE * self.n, "audit": "".join(reversed(audit)), "repaired_sha256": digest.hexdigest()}


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PARTIAL = (
    "task int, place int, whole boolean, rows array<struct<role string, text string>>, initials array<string>, turns array<long>, "
    "ways array<struct<before string, after string, cost long, audit string>>"
)


def _partial(conv, task: int, place: int, run: Run) -> dict:
    ways = [{"before": b, "after": a, "cost": c, "audit": s} for b, own in run.ways.items() for a, (c, s) in own.items()]
    rows = [{"role": r, "text": t} for r, t in run.rows]
    return {"conv_id": conv, "task": task, "place": place, "whole": run.whole, "rows": rows, "initials": run.initials, "turns": run.turns, "ways": ways, **run.counts}


def _read(row: dict) -> Run:
    run = Run(row["whole"], [(r["role"], r["text"]) for r in row["rows"]], 0, {c: row[c] for c in ("blank", "duplicate", "truncated", "illegal")})
    run.initials, run.turns = row["initials"] and tuple(row["initials"]), row["turns"] and tuple(row["turns"])
    run.ways = {}
    for w in row["ways"]:
        run.ways.setdefault(w["before"], {})[w["after"]] = (w["cost"], w["audit"])
    return run


def _batches(rows: Iterator[dict], schema: Callable[[], pa.Schema], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some megabytes of text."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 500 + sum(len(r["text"]) for r in row.get("rows") or ()) + len(row.get("audit") or "")
        if size > most:
            yield pa.RecordBatch.from_pylist(out, schema())
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema())


def _runs(task: int, rows: Iterator[dict]) -> Iterator[dict]:
    """Results of the conversations that lie within these sorted rows, and runs of those that may not."""
    conv, runs, begun, place = None, [], False, 0
    first = True  # the rows' first conversation may have begun in an earlier task

    def finished() -> dict:
        fold = Fold()
        for run in runs:
            fold.add(run)
        return {"conv_id": conv, **fold.result()}

    def handed() -> Iterator[dict]:
        nonlocal place
        for run in runs:
            yield _partial(conv, task, place, run)
            place += 1

    for row in rows:
        if not begun or row["conv_id"] != conv:
            if begun:
                if first or place:
                    yield from handed()
                else:
                    yield finished()
                first = False
            conv, begun, place = row["conv_id"], True, 0
            runs = [Run(not first)]
        if row["dropped"]:
            continue
        if runs[-1].full(len(row["text"])):
            if len(runs) >= HELD:
                yield from handed()
                runs = []
            runs.append(Run(False))
        runs[-1].add(row["turn"], row["role"], row["text"], row["fault"])
    if begun:
        yield from handed()


def _folded(rows: Iterator[dict]) -> Iterator[dict]:
    """The results of conversations whose sorted rows these are; a row that is a result already stays."""
    conv, fold = None, None
    for row in rows:
        if row["task"] is None:
            yield {c: v for c, v in row.items() if c not in ("task", "place", "whole", "rows", "initials", "turns", "ways")}
            continue
        if fold is None or row["conv_id"] != conv:
            if fold is not None:
                yield {"conv_id": conv, **fold.result()}
            conv, fold = row["conv_id"], Fold()
        fold.add(_read(row))
    if fold is not None:
        yield {"conv_id": conv, **fold.result()}


def _schema(docs: DataFrame, kind: str) -> Callable[[], pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(f"conv_id {docs.schema['conv_id'].dataType.simpleString()}, {kind}")
    return lambda: to_arrow_schema(fields)


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    turns has conv_id, turn, role, text and dropped: rows of which dropped is true only make their conversation known.
    Rows go by turn, NULL first; those of one turn by role, then by a digest of their text. A NULL text or role is one
    space; a NULL conv_id is a conversation of its own. A turn whose role begins with another letter than s, u or a, or
    is empty, can't be kept as it is. Rows that repeat role and text are duplicates of the first. Texts of any length are
    read whole. A conversation without rows has zeros, an empty audit and the hash of an empty string; an empty table
    gives an empty result; other columns aren't read, whatever their names.
    """
    work = Workspace(turns.sparkSession, "turnrepair")
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.coalesce("dropped", F.lit(False)).alias("dropped"))
    rows = work.keep(rows.withColumns({"digest": F.sha2("text", 256), "row": F.monotonically_increasing_id()}))
    key = ["conv_id", "role", "digest"]
    first = rows.where("not dropped").groupBy(*key).agg(F.min(F.struct("turn", "row"))["row"].alias("first"), F.count("*").alias("n")).where("n > 1")
    # written, so that the join can split the rows of one text without a final aggregation in between
    first = work.keep(first.select(*[F.col(c).alias(f"{c}_") for c in key], "first"))
    same = F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_"))
    rows = rows.join(first, same, "left").withColumn("fault", _fault(F.coalesce(F.col("row") != F.col("first"), F.lit(False))))
    order = ["conv_id", "turn", "role", "digest", "row"]
    rows = work.keep(rows.select(*order, "text", "dropped", "fault"))  # a range shuffle reads its input twice
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    middle = _schema(turns, f"{RESULT}, {PARTIAL}")
    last = _schema(turns, RESULT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_runs(TaskContext.get().partitionId(), (r for b in batches for r in b.to_pylist())), middle)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_folded(r for b in batches for r in b.to_pylist()), last)

    kind = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, "
    runs = rows.select("conv_id", "turn", "role", "text", "dropped", "fault").mapInArrow(cut, kind + f"{RESULT}, {PARTIAL}")
    return runs.repartition("conv_id").sortWithinPartitions("conv_id", "task", "place").mapInArrow(fold, kind + RESULT)
