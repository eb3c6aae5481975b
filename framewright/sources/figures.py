"""Figures as SVG, one document a figure and group, made by Spark and read back by its XML source.

However many bins a curve has, a drawing shows no more than its pixel columns do: one aggregation keeps the first, last,
lowest and highest point of each column, which draws the same line. Marks and cells are reduced to columns, too. So a
document's size depends on the drawing's width alone, and it is put together within its group's row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT = 960, 240  # of the plotted area, in pixels; a column is one pixel wide
LEFT, TOP, BOTTOM = 60, 50, 50
# What each side and the marks are drawn with, and the ramp of shares.
COLOURS = {"left": "#2677a8", "right": "#d86c32"}
MARK, MISSING = "#6b667b", "#e6e6e6"
RAMP = ("#fff8cc", "#ffd77a", "#f4a34f", "#c96730", "#7b381e")
TITLES = {"curve_effective": "Counts over observed time", "curve_actual": "Counts over elapsed time", "heatmap": "Share of occupancy by hour"}
LEAST_TOP, HEADROOM, LEAST_SPAN = 5.0, 1.15, 0.1  # of a curve's scales
LABELLED_HOURS = 0.3  # width from which on a cell has its number
SVG = (
    "`_data-figure` string, `_data-group` string, text array<struct<_VALUE: string, _class: string>>, line array<struct<_class: string, _x1: double>>, "
    "path array<struct<_class: string, _d: string, _stroke: string>>, rect array<struct<_class: string, _fill: string>>"
)


def column_of(hour: Column, span: Column) -> Column:
    """The pixel column of an hour on a scale from 0 to span."""
    return F.least(F.floor(hour / span * WIDTH), F.lit(WIDTH - 1)).cast("int")


def scales(bins: DataFrame) -> DataFrame:
    """grp, span, highest: the ends of a curve's scales, from bins of one axis and step."""
    top = F.greatest(F.max("left_mean"), F.max("right_mean"))
    return bins.groupBy("grp").agg(F.greatest(F.max("end_hour"), F.lit(LEAST_SPAN)).alias("span"), F.greatest(top * HEADROOM, F.lit(LEAST_TOP)).alias("highest"))


def level_of_detail(bins: DataFrame, ends: DataFrame) -> DataFrame:
    """grp, side, segment, col, hour, value: the points of each line that its drawing needs, four a pixel column at most.

    bins has grp, segment, start_hour, end_hour and a mean a side; a line is a side's points of one segment. Bins without
    a mean are left out.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_mean").alias("value")) for s in COLOURS]))
    own = bins.select("grp", "segment", ((F.col("start_hour") + F.col("end_hour")) / 2).alias("hour"), sides.alias("s")).select("grp", "segment", "hour", "s.*").where("value is not null")
    own = own.join(ends.select("grp", "span"), "grp").withColumn("col", column_of(F.col("hour"), F.col("span")))
    point, height = F.struct("hour", "value"), F.struct("value", "hour")
    kept = own.groupBy("grp", "side", "segment", "col").agg(F.min(point).alias("a"), F.max(point).alias("z"), F.min(height).alias("low"), F.max(height).alias("high"))
    turned = [F.struct(F.col(c)["hour"].alias("hour"), F.col(c)["value"].alias("value")) for c in ("low", "high")]
    return kept.select("grp", "side", "segment", "col", F.explode(F.array_distinct(F.array("a", "z", *turned))).alias("p")).select("grp", "side", "segment", "col", "p.*")


def _number(c: Column) -> Column:
    return F.format_string("%.2f", c)


def _text(c: Column) -> Column:
    """Escaped for XML."""
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def _x(hour: Column) -> Column:
    return F.lit(LEFT) + hour / F.col("span") * WIDTH


def _label(kind: str, x: Column, y: float, text: Column) -> Column:
    return F.concat(F.lit(f'<text class="{kind}" x="'), _number(x), F.lit(f'" y="{y:.2f}">'), _text(text), F.lit("</text>"))


def _line_paths(points: DataFrame) -> DataFrame:
    """grp, place, element: a path for each line. Lines within one column share an upright stroke of that column."""
    own = Window.partitionBy("grp", "side", "segment")
    p = points.withColumn("narrow", F.min("col").over(own) == F.max("col").over(own))
    p = p.withColumns({"line": F.when(F.col("narrow"), F.col("col")).otherwise(F.col("segment")), "y": F.lit(TOP + HEIGHT) - F.col("value") / F.col("highest") * HEIGHT, "x": _x(F.col("hour"))})
    wide = p.where("not narrow").groupBy("grp", "side", "line").agg(F.array_sort(F.collect_list(F.struct("hour", "x", "y"))).alias("ps"))  # four a column at most
    middle = F.lit(LEFT + 0.5) + F.col("line")
    narrow = p.where("narrow").groupBy("grp", "side", "line").agg(F.min("y").alias("upper"), F.max("y").alias("lower"))
    ends = [F.struct(F.lit(0.0).alias("hour"), middle.alias("x"), F.col(c).alias("y")) for c in ("lower", "upper")]
    paths = wide.withColumn("kind", F.lit("")).unionByName(narrow.select("grp", "side", "line", F.array(*ends).alias("ps"), F.lit(" narrow").alias("kind")))
    d = F.array_join(F.transform("ps", lambda q: F.concat_ws(" ", _number(q["x"]), _number(q["y"]))), " L ")
    colour = F.when(F.col("side") == "left", COLOURS["left"]).otherwise(COLOURS["right"])
    element = F.concat(F.lit('<path class="'), "side", "kind", F.lit('" fill="none" stroke="'), colour, F.lit('" d="M '), d, F.lit('"></path>'))
    return paths.select("grp", F.struct(F.lit(2).alias("layer"), F.col("line").cast("double").alias("at"), element.alias("element")).alias("e"))


def _marks(labels: DataFrame, ends: DataFrame) -> DataFrame:
    """A tick for each column that a segment begins in, and a word at the labelled ones."""
    own = labels.join(ends, "grp").withColumn("x", _x(F.col("hour")))
    ticks = own.groupBy("grp", column_of(F.col("hour"), F.col("span")).alias("col")).agg(F.min("x").alias("x"))
    y = TOP + HEIGHT
    tick = F.concat(F.lit('<line class="splice" x1="'), _number(F.col("x")), F.lit(f'" y1="{y - 6}" x2="'), _number(F.col("x")), F.lit(f'" y2="{y + 6}" stroke="{MARK}"></line>'))
    words = own.where("labelled").select("grp", F.struct(F.lit(4).alias("layer"), F.col("x").alias("at"), _label("splice", F.col("x"), y + 20, F.lit("splice")).alias("element")).alias("e"))
    return ticks.select("grp", F.struct(F.lit(3).alias("layer"), F.col("x").alias("at"), tick.alias("element")).alias("e")).unionByName(words)


def _documents(figure: str, elements: DataFrame, groups: DataFrame, note: str) -> DataFrame:
    """figure, grp, svg: one document for each of groups, those without elements, too."""
    drawn = elements.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["element"]), "\n").alias("body"))  # bounded by the width
    w, h = LEFT + WIDTH + 20, TOP + HEIGHT + BOTTOM
    head = F.concat(
        F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" viewBox="0 0 {w} {h}" font-family="sans-serif" font-size="11" data-figure="{figure}" data-group="'),
        _text(F.col("grp")), F.lit('">\n'), _label("title", F.lit(float(LEFT)), 18, F.concat(F.lit(TITLES[figure] + ", "), "grp")), F.lit("\n"), _label("note", F.lit(float(LEFT)), 34, F.lit(note)),
        F.lit(f'\n<line class="axis" x1="{LEFT}" y1="{TOP + HEIGHT}" x2="{LEFT + WIDTH}" y2="{TOP + HEIGHT}" stroke="#000000"></line>\n'),
    )
    none = _label("empty", F.lit(LEFT + WIDTH / 2), TOP + HEIGHT / 2, F.lit("no accepted counts"))
    axis = _label("axis", F.lit(LEFT + WIDTH / 2), TOP + HEIGHT + 40, F.lit("hours"))
    return groups.join(drawn, "grp", "left").select(F.lit(figure).alias("figure"), "grp", F.concat(head, F.coalesce("body", none), F.lit("\n"), axis, F.lit("\n</svg>")).alias("svg"))


def curves(bins: DataFrame, groups: DataFrame, note: str, axis: str, labels: DataFrame | None = None) -> DataFrame:
    """figure, grp, svg: both sides' means over an axis. bins is of one axis and step.

    On the effective axis segments are joined, and labels (grp, hour, labelled) says where one begins; on the actual one
    bins have their segment, and each is a line of its own.
    """
    ends = scales(bins)
    own = bins if axis == "actual" else bins.withColumn("segment", F.lit(0))
    drawn = _line_paths(level_of_detail(own, ends).join(ends, "grp"))
    if labels is not None:
        drawn = drawn.unionByName(_marks(labels, ends))
    return _documents(f"curve_{axis}", drawn, groups, note)


def heatmap(bins: DataFrame, groups: DataFrame, note: str, labels: DataFrame | None = None) -> DataFrame:
    """figure, grp, svg: each side's share of every hour on the effective axis, grey where there is none.

    Where hours are narrower than a pixel column, a column shows the mean share of its hours.
    """
    ends = scales(bins)
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("row"), (F.col(f"{s}_share") * 100).alias("percent")) for i, s in enumerate(COLOURS)]))
    cells = bins.select("grp", "start_hour", "end_hour", sides.alias("s")).select("grp", "start_hour", "end_hour", "s.*").join(ends, "grp")
    cells = cells.groupBy("grp", "row", "span", column_of(F.col("start_hour"), F.col("span")).alias("col")).agg(F.min("start_hour").alias("lo"), F.max("end_hour").alias("hi"), F.avg("percent").alias("percent"))
    step = F.least(F.floor(F.col("percent") / (100 / len(RAMP))), F.lit(len(RAMP) - 1)).cast("int")
    fill = F.coalesce(F.get(F.array(*[F.lit(c) for c in RAMP]), step), F.lit(MISSING))
    y, half = F.lit(TOP) + F.col("row") * (HEIGHT / 2), HEIGHT / 2
    x0, x1 = _x(F.col("lo")), _x(F.col("hi"))
    rect = F.concat(F.lit('<rect class="cell" x="'), _number(x0), F.lit('" y="'), _number(y), F.lit('" width="'), _number(x1 - x0), F.lit(f'" height="{half:.2f}" fill="'), fill, F.lit('"></rect>'))
    number = F.concat(F.lit('<text class="share" x="'), _number((x0 + x1) / 2), F.lit('" y="'), _number(y + half / 2), F.lit('">'), F.format_string("%.0f", "percent"), F.lit("</text>"))
    cells = cells.withColumn("element", F.when((F.col("hi") - F.col("lo") > LABELLED_HOURS) & F.col("percent").isNotNull(), F.concat(rect, number)).otherwise(rect))
    drawn = cells.select("grp", F.struct(F.lit(1).alias("layer"), (F.col("col") * 2 + F.col("row")).cast("double").alias("at"), "element").alias("e"))
    if labels is not None:
        drawn = drawn.unionByName(_marks(labels, ends))
    return _documents("heatmap", drawn, groups, note)


def write_figures(figures: DataFrame, folder: str) -> None:
    """Each document as folder/<figure>_<group>.svg, written by the tasks that made them, then moved to its name."""
    spark = figures.sparkSession
    figures.select("figure", F.col("grp").alias("g"), "svg").write.mode("overwrite").partitionBy("figure", "g").text(f"{folder}/_parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    parts = path(f"{folder}/_parts")
    files = parts.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for found in files.globStatus(path(f"{folder}/_parts/figure=*/g=*/part-*")) or []:  # one a figure and group
        at = found.getPath()
        figure, group = at.getParent().getParent().getName().removeprefix("figure="), at.getParent().getName().removeprefix("g=")
        name = path(f"{folder}/{figure}_{group}.svg")
        files.delete(name, False)
        files.rename(at, name)
    files.delete(parts, True)


def read_figures(spark: SparkSession, folder: str) -> DataFrame:
    """figure, grp and the elements of every SVG document of a folder: text, line, path and rect."""
    found = spark.read.format("xml").option("rowTag", "svg").schema(SVG).load(f"{folder}/*.svg")
    return found.select(F.col("`_data-figure`").alias("figure"), F.col("`_data-group`").alias("grp"), *[F.coalesce(c, F.array()).alias(c) for c in ("text", "line", "path", "rect")])


def _of_side(side: str, colour: str) -> Callable[[Column], Column]:
    return lambda p: (F.split_part(p["_class"], F.lit(" "), F.lit(1)) == side) & (p["_stroke"] == colour)


def inspected(found: DataFrame) -> DataFrame:
    """What each document holds: texts, titles and splice words, ticks, cells, and each side's lines, moves and points."""
    of = lambda c, test: F.size(F.filter(c, test))
    counts = {
        "texts": F.size("text"),
        "titles": of("text", lambda t: t["_class"] == "title"),
        "words": of("text", lambda t: t["_class"] == "splice"),
        "shares": of("text", lambda t: t["_class"] == "share"),
        "empty": of("text", lambda t: t["_class"] == "empty"),
        "ticks": of("line", lambda x: x["_class"] == "splice"),
        "cells": F.size("rect"),
    }
    note = F.get(F.filter("text", lambda t: t["_class"] == "note"), F.lit(0))["_VALUE"]
    for side, colour in COLOURS.items():
        own = F.filter("path", _of_side(side, colour))
        d = F.array_join(F.transform(own, lambda p: p["_d"]), " ")
        letters = lambda x, letter: F.length(x) - F.length(F.replace(x, F.lit(letter), F.lit("")))
        counts |= {f"{side}_paths": F.size(own), f"{side}_moves": letters(d, "M"), f"{side}_points": letters(d, "M") + letters(d, "L")}
    return found.select("figure", "grp", note.alias("note"), *[c.alias(n) for n, c in counts.items()])


def problems(checks: DataFrame) -> DataFrame:
    """figure, grp, problem of documents that lack a title, a line, or have a line of several moves where it must be one."""
    no_line = (F.col("left_paths") == 0) | (F.col("right_paths") == 0)
    problem = (
        F.when(F.col("titles") != 1, "no title")
        .when(F.col("figure").startswith("curve") & (F.col("empty") == 0) & no_line, "no line of a side")
        .when(F.col("figure").startswith("curve") & ((F.col("left_paths") != F.col("left_moves")) | (F.col("right_paths") != F.col("right_moves"))), "a line in several pieces")
        .when((F.col("figure") == "curve_effective") & ((F.col("left_paths") > 1) | (F.col("right_paths") > 1)), "the joined line is broken")
        .when((F.col("figure") == "heatmap") & (F.col("empty") == 0) & (F.col("cells") == 0), "no cell")
        .when((F.col("ticks") > 0) & (F.col("words") == 0), "no splice is named")
    )
    return checks.withColumn("problem", problem).where("problem is not null").select("figure", "grp", "problem")
