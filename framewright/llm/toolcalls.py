"""Chat records with tool calls: linked by identifier, topologically ordered, validated and serialised.

Only DataFrame expressions are used. Calls and results meet in a shuffled hash join on their identifier, split where
one is skewed. A call may name earlier calls that it needs (after); its depth is the longest way through them, found by
pointer doubling along chains and in rounds over the calls that need several. Depth, then place, is a topological
order. Arguments are validated against a table of
schemas, and each record becomes canonical JSON: keys in alphabetical order, no white space.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import Workspace


@dataclass(frozen=True)
class Argument:
    """What a call's argument must be: kind is string or integer; least and most bound its length or value."""

    name: str
    kind: str
    required: bool = True
    least: int | None = None
    most: int | None = None


def problems(arguments: Column, tool: Column, schemas: dict[str, list[Argument]]) -> Column:
    """Sorted array of what is wrong with the arguments (map<string,string>) of a call: empty if they are valid."""
    out = F.array(F.lit("unknown tool"))
    for name, expected in schemas.items():
        checks: list[Column] = []
        for a in expected:
            value = F.try_element_at(arguments, F.lit(a.name))
            size = F.char_length(value) if a.kind == "string" else F.expr("CAST(NULL AS BIGINT)")
            if a.kind == "integer":
                size = F.when(value.rlike(r"^-?[0-9]{1,18}$"), value.try_cast("long"))
                checks.append(F.when(value.isNotNull() & size.isNull(), F.lit(f"{a.name}: not an integer")))
            if a.required:
                checks.append(F.when(value.isNull(), F.lit(f"{a.name}: missing")))
            if a.least is not None:
                checks.append(F.when(size < a.least, F.lit(f"{a.name}: below {a.least}")))
            if a.most is not None:
                checks.append(F.when(size > a.most, F.lit(f"{a.name}: above {a.most}")))
        names = F.array(*[F.lit(a.name) for a in expected]).cast("array<string>")
        extra = F.transform(F.array_except(F.map_keys(arguments), names), lambda k: F.concat(k, F.lit(": unexpected")))
        found = F.array_sort(F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), extra))
        out = F.when(tool == name, found).otherwise(out)
    return F.when(arguments.isNull(), F.array(F.lit("no arguments"))).otherwise(out)


def _quoted(text: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, everything else as it is; null for NULL."""
    body = F.to_json(F.struct(text.alias("a")))  # {"a":"..."}, or {} for NULL
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substr(body, F.lit(6), F.length(body) - 6))


def canonical(arguments: Column, tool: Column, call_id: Column, result: Column, schemas: dict[str, list[Argument]]) -> Column:
    """Canonical JSON of a call: integers as numbers where the schema says so, all other arguments as strings."""
    integers = F.array(*[F.lit(f"{t}\n{a.name}") for t, own in schemas.items() for a in own if a.kind == "integer"] or [F.lit("")])

    def entry(k: Column) -> Column:
        value = F.try_element_at(arguments, k)
        number = F.array_contains(integers, F.concat(tool, F.lit("\n"), k)) & value.rlike(r"^-?(0|[1-9][0-9]{0,17})$")
        return F.concat(_quoted(k), F.lit(":"), F.when(number, value).otherwise(_quoted(value)))

    body = F.array_join(F.transform(F.array_sort(F.map_keys(arguments)), entry), ",")
    return F.concat(F.lit('{"arguments":{'), F.coalesce(body, F.lit("")), F.lit('},"id":'), _quoted(call_id), F.lit(',"name":'), _quoted(tool), F.lit(',"result":'), _quoted(result), F.lit("}"))


def depths(calls: DataFrame, work: Workspace) -> DataFrame:
    """(call_id, depth): 0 for a call that needs none, else one more than the deepest that it needs; NULL if that is a cycle.

    calls has call_id, not NULL and unique, and after, an array; what names no call doesn't count. Calls that need one
    other are pointers: each round every call takes over the pointer of the call that it points to, so a chain of n
    calls takes log2(n) joins, to the first call that needs none or several. Those that need several follow in rounds,
    as many as lie behind one another: each is placed once all that it needs are.
    """
    known = calls.select(F.col("call_id").alias("up"))
    needs = calls.select("call_id", F.explode("after").alias("up")).distinct().join(known, "up", "left_semi")
    needs = work.keep(needs)
    ups = needs.groupBy("call_id").agg(F.count("*").alias("n"), F.first("up").alias("up"))
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    start = calls.select("call_id").join(ups, "call_id", "left")
    now = work.keep(start.select("call_id", F.when(single, F.col("up")).otherwise(F.col("call_id")).alias("at"), F.when(single, 1).otherwise(0).cast("long").alias("far"), (~single).alias("ended"), F.coalesce("n", F.lit(0)).alias("n")))
    total, left, joints = now.agg(F.count("*"), F.count_if(~F.col("ended")), F.count_if(F.col("n") > 1)).first()
    rounds = 0
    while left and (1 << rounds) <= 2 * total:
        above = now.select(F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("far").alias("more"), F.col("ended").alias("end"))
        step = now.join(above, "at").select("call_id", F.col("next").alias("at"), (F.col("far") + F.col("more")).alias("far"), F.col("end").alias("ended"), "n")
        new = work.keep(step)
        work.drop(now)
        now, rounds = new, rounds + 1
        left = now.agg(F.count_if(~F.col("ended"))).first()[0]
    placed = now.where("ended and at = call_id and n = 0").select(F.col("call_id").alias("at"), F.lit(0).cast("long").alias("base"))
    if joints:
        ends = now.where("ended").select(F.col("call_id").alias("up"), "at", (F.col("far") + 1).alias("far"))
        joined = needs.join(now.where("n > 1").select("call_id"), "call_id", "left_semi").join(ends, "up", "left")
        waiting, placed = work.keep(joined.select("call_id", "at", "far")), work.keep(placed)
        while True:
            found = waiting.join(placed, "at", "left").groupBy("call_id").agg(F.count_if(F.col("base").isNull()).alias("open"), F.max(F.col("base") + F.col("far")).alias("base"))
            fresh = work.keep(found.where("open = 0").select(F.col("call_id").alias("at"), "base"))
            if not fresh.limit(1).count():
                break
            rest = work.keep(waiting.join(fresh.select(F.col("at").alias("call_id")), "call_id", "left_anti"))
            placed, waiting = work.keep(placed.unionByName(fresh)), rest
    return now.join(placed, "at", "left").select("call_id", F.when(F.col("ended"), F.col("base") + F.col("far")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, list[Argument]], copies: bool = False) -> DataFrame:
    """One row per call, and per result that is no call's first.

    calls: conv_id, place, call_id, tool, arguments (map<string,string>), after (array of call_ids). results: conv_id, place, call_id,
    content. Returns conv_id, place, call_id, depth, status, errors (joined by '; '), json:

    status is linked (to the first result by conv_id and place), unanswered (a call without result), orphan (a result
    without call, whose other columns are NULL), repeated (a result after the first one of its identifier, likewise)
    or unnamed (a call whose call_id is NULL, which links with nothing). First is by conv_id, place and content; rows
    equal to the first in all of them count as one with it, unless copies is set: then each but one is repeated. A
    call_id that several calls share is ambiguous: such calls link all the same, their depth is NULL. A result is later
    than its call in a topological order by (depth, conv_id, place). NULLs in after count for nothing; NULL arguments
    are an error of the call, NULL contents a null in its JSON; texts of any length are kept whole. Empty tables give
    what the other one has; other columns are not read, whatever their names.
    """
    work = Workspace(calls.sparkSession, "toolcalls")
    calls = calls.select("conv_id", "place", "call_id", "tool", "arguments", "after")
    named = calls.where("call_id is not null")
    counted = named.groupBy("call_id").agg(F.count("*").alias("n"), F.first("after").alias("after"))
    depth = depths(counted.where("n = 1").select("call_id", "after"), work)
    # one result for each identifier, the first, so that a shared identifier doesn't multiply its calls by its results
    firsts = results.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("conv_id", "place", "content")).alias("one"), F.count("*").alias("answers"))
    answered = firsts.select(F.col("call_id").alias("result_id"), F.col("one.content").alias("content"), F.lit(True).alias("answered"))
    joined = named.join(answered.hint("shuffle_hash"), F.col("call_id") == F.col("result_id"), "left").join(depth.hint("shuffle_hash"), "call_id", "left")
    wrong = problems(F.col("arguments"), F.col("tool"), schemas)
    json = canonical(F.col("arguments"), F.col("tool"), F.col("call_id"), F.col("content"), schemas)
    errors = F.array_join(wrong, "; ")
    out = joined.select("conv_id", "place", "call_id", "depth", F.when(F.col("answered"), "linked").otherwise("unanswered").alias("status"), errors.alias("errors"), json.alias("json"))
    unnamed = calls.where("call_id is null").withColumn("content", F.lit(None).cast("string"))
    unnamed = unnamed.select("conv_id", "place", "call_id", F.lit(None).cast("long").alias("depth"), F.lit("unnamed").alias("status"), errors.alias("errors"), json.alias("json"))
    none = F.lit(None).cast("string")
    orphans = results.join(named.select(F.col("call_id").alias("known")).distinct(), F.col("call_id") == F.col("known"), "left_anti")
    orphans = orphans.select("conv_id", "place", "call_id", F.lit(None).cast("long").alias("depth"), F.lit("orphan").alias("status"), none.alias("errors"), none.alias("json"))
    later = firsts.where("answers > 1").select(F.col("call_id").alias("id"), "one").join(counted.select(F.col("call_id").alias("known")), F.col("id") == F.col("known"), "left_semi")
    same = F.struct("conv_id", "place", "content").eqNullSafe(F.col("one"))
    both = results.join(later, F.col("call_id") == F.col("id")).select("conv_id", "place", "call_id", same.alias("same"))
    later = both.where("not same").drop("same")
    if copies:  # the rows equal to the first, less one
        equal = both.where("same").groupBy("conv_id", "place", "call_id").agg(F.count("*").alias("n")).where("n > 1")
        later = later.unionByName(equal.select("conv_id", "place", "call_id", F.explode(F.sequence(F.lit(2), "n"))).drop("col"))
    later = later.select("conv_id", "place", "call_id", F.lit(None).cast("long").alias("depth"), F.lit("repeated").alias("status"), none.alias("errors"), none.alias("json"))
    return out.unionByName(unnamed).unionByName(orphans).unionByName(later)
