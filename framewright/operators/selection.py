"""Greedy selection of points as rounds of joins: an independent set in the order of a priority.

Taken one by one in their order, a point is kept unless one that was kept before is near it. That is a point's fate once
the fates of all earlier points near it are known. So in each round, over all frames at once, every point that has no
undecided earlier one near it is kept, and what is near the kept ones goes. Points are dealt to cells so small that two of
one cell are always near each other: of a cell only its earliest undecided point can be kept, and it meets the points of
the cells around, so that no frame or crowded place is compared with itself as a whole. There are as many rounds as the
longest row of points of rising priority, each near the next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.staging import discard, stage

Near = Callable[[Column, Column], Column]  # from the differences in x and y
REACH = 2  # cells that nearness may span


def ellipse(rx: float, ry: float) -> tuple[Near, tuple[float, float]]:
    """Nearness within an ellipse, and cells of which any two places are near: below 1 / sqrt(2) of the radii."""
    return lambda dx, dy: F.pow(dx / rx, 2) + F.pow(dy / ry, 2) < 1, (rx / 1.42, ry / 1.42)


def box(dx: float, dy: float) -> tuple[Near, tuple[float, float]]:
    """Nearness by both differences, and cells of which any two places are near."""
    return lambda x, y: (F.abs(x) < dx) & (F.abs(y) < dy), (dx / 1.01, dy / 1.01)


def _celled(points: DataFrame, cell: tuple[float, float]) -> DataFrame:
    return points.withColumns({"i": F.floor(F.col("x") / cell[0]), "j": F.floor(F.col("y") / cell[1])})


def _around(points: DataFrame, *more: str) -> DataFrame:
    """frame2, x2, y2 and more of each celled point, once for each cell around it (i2, j2)."""
    steps = range(-REACH, REACH + 1)
    cells = F.explode(F.array(*[F.struct((F.col("i") + a).alias("i2"), (F.col("j") + b).alias("j2")) for a in steps for b in steps]))
    return points.select(F.col("frame").alias("frame2"), F.col("x").alias("x2"), F.col("y").alias("y2"), *[F.col(c).alias(f"{c}2") for c in more], cells.alias("c")).select("*", "c.*").drop("c")


def _meets(near: Near) -> Column:
    """Whether a celled point and one of _around() share a cell and are near."""
    same = (F.col("frame") == F.col("frame2")) & (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2"))
    return same & near(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))


def beside(points: DataFrame, others: DataFrame, near: Near, cell: tuple[float, float], how: str) -> DataFrame:
    """The points (frame, x, y) that have (left_semi) or haven't (left_anti) one of others near them."""
    return _celled(points, cell).join(_around(_celled(others, cell)), _meets(near), how).drop("i", "j")


def independent(points: DataFrame, order: list[Column], near: Near, cell: tuple[float, float]) -> DataFrame:
    """frame, id of the points (frame, id, x, y) that greedy selection in the given order keeps.

    order must tell all points of a frame apart. Points without a place are kept, as nothing is near them.
    """
    left = stage(_celled(points.select("frame", "id", "x", "y", F.struct(*order).alias("rank")), cell))
    placed = "i is not null and j is not null"
    rounds = [stage(left.where(f"not ({placed})").select("frame", "id"))]
    while not left.isEmpty():
        leaders = left.where(placed).groupBy("frame", "i", "j").agg(F.min(F.struct("rank", "id", "x", "y")).alias("p")).select("frame", "i", "j", "p.*")
        earlier = left.join(_around(leaders, "id", "rank"), _meets(near) & (F.col("rank") < F.col("rank2")))
        blocked = earlier.select("frame", F.col("id2").alias("id")).distinct()
        kept = stage(leaders.join(blocked, ["frame", "id"], "left_anti").select("frame", "id", "i", "j", "x", "y"))
        rest = stage(left.where(placed).join(_around(kept), _meets(near), "left_anti"))
        discard(left)
        left = rest
        rounds.append(kept)
    done = stage(reduce(DataFrame.unionByName, [df.select("frame", "id") for df in rounds]))
    discard(left, *rounds)
    return done
