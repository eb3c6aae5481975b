"""Connected components of a distributed edge list by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import Workspace


HUBS = 1000  # keys that are too crowded to be dealt by hash: at most as many as this, whatever the number of rows


def matched(rows: DataFrame, table: DataFrame, key: str, crowded: Column) -> DataFrame:
    """rows joined with table, in which key is unique. What crowded says of table's rows must hold for HUBS of them at most.

    These are broadcast, so that their rows stay where they are; all others meet in a shuffled join.
    """
    columns = [c for c in table.columns if c != key]
    marked = rows.join(F.broadcast(table.where(crowded).withColumn("stays", F.lit(True))), key, "left")
    stay = marked.where("stays").drop("stays")
    rest = marked.where("stays is null").drop("stays", *columns).join(table.where(~crowded), key)
    return stay.unionByName(rest)


def _least(edges: DataFrame, number: int) -> DataFrame:
    """Edges (a, b) with the least of a's neighbours and a itself: (a, b, least); number is how many edges there are.

    A node is crowded if it has more than one in HUBS of the edges.
    """
    low = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"), F.count("*").alias("own"))
    return matched(edges, low, "a", F.col("own") > number / HUBS).select("a", "b", "least")


def _state(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether every node that hangs to another hangs to one only, to which only such nodes hang."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    found = nodes.agg(F.sum("up").alias("n"), F.count_if(F.expr("up > 1 or (up = 1 and root = 1)")).alias("mixed")).first()
    return found.n or 0, not found.mixed


def connected(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the least node that is reachable.

    Each round is a large star (neighbours above a node are hung to its least neighbour) and a small star (those below
    are); rounds end once all edges form stars, after about the logarithm of the longest path. A node with very many
    edges only has its least neighbour joined to them, without a shuffle of its edges.
    """
    now = work.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        number, finished = _state(now)
        if finished:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = work.keep(_least(both, 2 * number).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b"))
        hung = _least(large, number)  # a > b on every edge, so least is below both
        small = hung.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(hung.select("a", F.col("least").alias("b")))
        new = work.keep(small.where("a <> b").distinct())
        work.drop(now, large)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
