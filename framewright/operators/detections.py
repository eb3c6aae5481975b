"""Detections inside frames: zones, sides, reasons, neighbours, numbering, counts, greedy selection and coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators import selection


def zone(distance: Column, y: Column, floor: Column, reach: float, reflections: bool) -> Column:
    """plant, bottom or other, by distance to the plant and height over the floor line.

    Components reach 50, windowed detections 55; only the latter know reflections, which go first.
    """
    out = F.when((distance <= reach) & (y < floor - 20), "plant").when(y >= floor - 80, "bottom").otherwise("other")
    return F.when(y >= floor, "reflection_or_bottom").otherwise(out) if reflections else out


def side(zone_: Column, x: Column, divider: Column) -> Column:
    """left or right of the divider for what sits on the plant, else empty."""
    return F.when(zone_ == "plant", F.when(x < divider, "left").otherwise("right")).otherwise("")


def review_reasons(zone_: Column, distance: Column, y: Column, floor: Column, score: Column) -> Column:
    """Why a windowed detection should be looked at, in this order."""
    checks = [
        ("below the surface or a reflection, not counted", zone_ == "reflection_or_bottom"),
        ("edge of the plant", (distance > 25) & (zone_ == "plant")),
        ("near the base or the surface", y > floor - 120),
        ("low shape score", score < 1.1),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(text)) for text, c in checks]))


def accepted(score: Column, gray_q95: Column, chroma_median: Column, least: tuple[float, float, float] = (0.65, 0.07, -0.055)) -> Column:
    return F.coalesce((score >= least[0]) & (gray_q95 >= least[1]) & (chroma_median >= least[2]), F.lit(False))


def component_ok(area: Column, width: Column, height: Column, elongation: Column, extent: Column) -> Column:
    """The geometry that a component must have: 35 long, 16 wide, not too long for its width, well filled."""
    return (area <= 12000) & (F.greatest(width, height) >= 35) & (F.least(width, height) >= 16) & (elongation <= 5) & (extent >= 0.22)


def supplement_ok(area: Column, width: Column, height: Column, peak: Column) -> Column:
    return width.between(20, 135) & height.between(35, 230) & area.between(700, 7500) & (peak >= 0.22)


def component_suspect(divided: Column, peak: Column, distance: Column, width: Column, height: Column, top: Column, y: Column, floor: Column) -> Column:
    """Whether a contrast component is doubtful: part of a large one, faint, off the plant, thin, cut off or low."""
    return divided | (peak < 0.12) | (distance > 25) | (F.least(width, height) < 15) | (top < 5) | (y > floor - 100)


def within(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Whether a box lies within an image of some width and height."""
    return (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= width) & (y + h <= height)


def inside(x: Column, y: Column, w: Column, h: Column, image: tuple[int, int] = (4416, 2488)) -> Column:
    """Whether a box lies within an image of the usual size."""
    return within(x, y, w, h, F.lit(image[0]), F.lit(image[1]))


def with_neighbours(points: DataFrame, dx: float, dy: float) -> DataFrame:
    """frame, id, x, y and has_neighbour: whether another point of the frame is nearer than dx across and dy down.

    Points are dealt to cells of dx by dy; a point only meets those of its own and the eight cells around, so a crowded
    frame isn't compared with itself as a whole.
    """
    p = points.select("frame", "id", "x", "y", F.floor(F.col("x") / dx).alias("cx"), F.floor(F.col("y") / dy).alias("cy"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = p.select("frame", F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.explode(around).alias("o"))
    spread = spread.select(F.col("frame").alias("f2"), "id2", "x2", "y2", (F.col("ox") + F.col("o.i")).alias("cx2"), (F.col("oy") + F.col("o.j")).alias("cy2"))
    near = (F.abs(F.col("x") - F.col("x2")) < dx) & (F.abs(F.col("y") - F.col("y2")) < dy) & (F.col("id") != F.col("id2"))
    on = [F.col(a) == F.col(b) for a, b in (("frame", "f2"), ("cx", "cx2"), ("cy", "cy2"))]
    found = p.join(spread, [*on, near], "left_semi").select("frame", "id", F.lit(True).alias("found"))
    return points.select("frame", "id", "x", "y").join(found, ["frame", "id"], "left").select("frame", "id", "x", "y", F.coalesce("found", F.lit(False)).alias("has_neighbour"))


def numbered(points: DataFrame) -> DataFrame:
    """points with detection_id: their number in the frame by x, then y, then id."""
    return points.withColumn("detection_id", F.row_number().over(Window.partitionBy("frame").orderBy("x", "y", "id")))


def side_counts(detections: DataFrame) -> DataFrame:
    """Per frame: how many detections are left, right, off the plant, reflections and suspect."""
    return detections.groupBy("frame").agg(
        F.count_if(F.col("side") == "left").alias("auto_left_count"),
        F.count_if(F.col("side") == "right").alias("auto_right_count"),
        F.count_if(F.col("zone").isin("other", "bottom")).alias("auto_other_count"),
        F.count_if(F.col("zone") == "reflection_or_bottom").alias("reflection_or_bottom_count"),
        F.count_if("suspect").alias("suspect_count"),
    )


def array_counts(column: str = "detections") -> dict[str, Column]:
    """The same counts from an array of detections within the frame's row."""
    of = lambda test: F.size(F.filter(column, test))
    return {
        "auto_left_count": of(lambda d: d["side"] == "left"),
        "auto_right_count": of(lambda d: d["side"] == "right"),
        "auto_other_count": of(lambda d: d["zone"].isin("other", "bottom")),
        "reflection_or_bottom_count": of(lambda d: d["zone"] == "reflection_or_bottom"),
        "suspect_count": of(lambda d: F.coalesce(d["suspect"], F.lit(False))),
    }


def count_mismatches(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Frames whose recorded side counts differ from their detections'."""
    got = side_counts(detections).select("frame", F.col("auto_left_count").alias("l"), F.col("auto_right_count").alias("r"))
    out = frames.join(got, "frame", "left").withColumns({"l": F.coalesce("l", F.lit(0)), "r": F.coalesce("r", F.lit(0))})
    return out.where((F.col("l") != F.col("auto_left_count")) | (F.col("r") != F.col("auto_right_count"))).select("frame", "auto_left_count", "auto_right_count", "l", "r")


def coordinates(frames: DataFrame) -> DataFrame:
    """One row per detection of the frames' arrays, with box parts and joined reasons."""
    d = frames.select("frame_id", "group", "source_path", F.explode("detections").alias("d"))
    box = {f"bbox_{n}": F.get(F.col("d.bbox"), F.lit(i)) for i, n in enumerate(("x", "y", "width", "height"))}
    return d.select(
        "frame_id", "group", "source_path", "d.detection_id", "d.x", "d.y", *[c.alias(n) for n, c in box.items()], "d.side", "d.zone", "d.score", "d.origin", "d.suspect",
        F.array_join("d.review_reasons", "; ").alias("review_reasons"),
    )


def rescale(points: Column, preview_width: Column, full_width: int | Column = 4416) -> Column:
    """Annotation points from preview to full resolution."""
    full = full_width.cast("double") if isinstance(full_width, Column) else F.lit(float(full_width))
    return F.transform(points, lambda p: F.transform(p, lambda v: v * (full / preview_width)))


def greedy(points: DataFrame, rx: float, ry: float) -> DataFrame:
    """frame, id, kept: points in falling score (ties by id), each kept unless a kept one lies within its ellipse rx, ry."""
    p = points.select("frame", "id", "x", "y", "score")
    chosen = selection.independent(p, [F.col("score").isNull(), -F.col("score"), F.col("id")], *selection.ellipse(rx, ry))
    chosen = chosen.withColumn("kept", F.lit(True))
    return p.join(chosen, ["frame", "id"], "left").select("frame", "id", F.coalesce("kept", F.lit(False)).alias("kept"))


def supplement(selected: DataFrame, blobs: DataFrame, dx: float = 65.0, dy: float = 100.0) -> DataFrame:
    """frame, id of the blobs that are added, in order of id: each unless a selected point or an earlier blob is near."""
    near, cell = selection.box(dx, dy)
    free = selection.beside(blobs.select("frame", "id", "x", "y"), selected.select("frame", "x", "y"), near, cell, "left_anti")
    return selection.independent(free, [F.col("id")], near, cell)


def top_edge(candidates: DataFrame, chosen: DataFrame, radius: float = 100.0) -> DataFrame:
    """Candidates at the image's top edge, large enough, dark and brown enough, without an accepted point within radius.

    Accepted points are dealt to squares of the radius; a candidate meets those of the nine squares around it.
    """
    ok = (F.col("box_y") == 0) & (F.col("area") >= 400) & F.col("width").between(16, 140) & (F.col("peak") >= 0.15) & (F.col("chroma_median") >= -0.025) & (F.col("plant_distance") <= 50)
    c = candidates.where(ok)
    square = lambda v: F.floor(v / F.lit(radius))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    p = chosen.select(F.col("frame").alias("f2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(around).alias("o"))
    p = p.select("f2", "x2", "y2", (square(F.col("x2")) + F.col("o.i")).alias("i2"), (square(F.col("y2")) + F.col("o.j")).alias("j2"))
    same = (F.col("frame") == F.col("f2")) & (square(F.col("x")) == F.col("i2")) & (square(F.col("y")) == F.col("j2"))
    near = same & (F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) < radius)
    return c.join(p, near, "left_anti")
