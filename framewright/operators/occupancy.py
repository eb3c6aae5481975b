"""Gap-aware intervals, their segments, exact integration into bins on two time axes, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.ordered import RANGE, ranged, segmented, with_neighbours, with_running_sums
from framewright.schemas import SECOND, Settings
from framewright.staging import discard, stage

SIDES = ("left", "right")


def finite(c: Column) -> Column:
    """The value, or NULL for NaN and infinities."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), None).otherwise(c)


def intervals(frames: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of adjacent frames, both valid and counted, whose step is positive and not over the longest one.

    Frames are ranged once and what is found in a range is staged once: later steps read it several times, with a small
    table of what crosses the ranges. Returns grp, start_t, end_t, start_frame, end_frame, left0, left1, right0, right1,
    segment (from 1), eff_start and eff_end. A missing validity counts as false; frames without group or time take no part.
    """
    series = frames.where("grp is not null and t is not null").select(
        "grp", "t", "frame_id", finite(F.col("left_count")).alias("l"), finite(F.col("right_count")).alias("r"), F.coalesce("valid", F.lit(False)).alias("valid")
    )
    rows = ranged(series, ["grp"], ["t", "frame_id"])
    near = with_neighbours(rows, ["grp"], ["t", "frame_id"], ["l", "r", "valid"])
    dt = F.col("next.t") - F.col("t")
    counted = F.col("l").isNotNull() & F.col("r").isNotNull() & F.col("next.l").isNotNull() & F.col("next.r").isNotNull()
    pairs = near.where(F.col("valid") & F.col("next.valid") & counted & (dt > 0) & (dt <= settings.max_gap)).select(
        "grp", RANGE, F.col("t").alias("start_t"), F.col("next.t").alias("end_t"), F.col("frame_id").alias("start_frame"), F.col("next.frame_id").alias("end_frame"),
        F.col("l").alias("left0"), F.col("next.l").alias("left1"), F.col("r").alias("right0"), F.col("next.r").alias("right1"),
    )
    done = segmented(pairs, ["grp"], "start_t", "end_t", "start_frame")
    discard(rows)
    return done


def integrals(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over pieces (lo, hi of an interval on some axis): seconds, number, and each side's integral in count seconds."""
    width = (F.col("hi") - F.col("lo")) / SECOND

    def at(side: str, u: str) -> Column:
        a, b = F.col(f"{side}0"), F.col(f"{side}1")
        return a + (b - a) * (F.col(u) - F.col("p")) / (F.col("q") - F.col("p"))

    sums = [F.sum((at(s, "lo") + at(s, "hi")) / 2 * width).alias(f"{s}_sum") for s in SIDES]
    return pieces.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias("observed"), F.count("*").alias("interval_pieces"), *sums)


def ratios(df: DataFrame) -> DataFrame:
    """Means, minutes and shares from observed (microseconds) and the sides' integrals; NULL where nothing was observed."""
    seconds, both = F.col("observed") / SECOND, F.col("left_sum") + F.col("right_sum")
    some = F.col("observed") > 0
    cols = {"observed_seconds": F.coalesce(seconds, F.lit(0.0))}
    for s in SIDES:
        cols[f"{s}_mean"] = F.when(some, F.try_divide(F.col(f"{s}_sum"), seconds))
        cols[f"{s}_insect_minutes"] = F.when(some, F.col(f"{s}_sum") / 60)
        cols[f"{s}_share"] = F.when(some, F.try_divide(F.col(f"{s}_sum"), both))
    return df.withColumns(cols)


def spans(frames: DataFrame) -> DataFrame:
    """grp, t0 and last: the time of a group's first frame and the elapsed time of its last one."""
    return frames.where("grp is not null and t is not null").groupBy("grp").agg(F.min("t").alias("t0"), (F.max("t") - F.min("t")).alias("last"))


def rebin(iv: DataFrame, frames: DataFrame, step_seconds: list[int], axes: tuple[str, ...] = ("effective", "actual"), keys: tuple[str, ...] = ()) -> DataFrame:
    """Bins of each group (and of further keys of iv), axis and step: exact integrals of the linearly joined counts.

    The effective axis holds the bins that observed time fills, the actual axis every bin up to the group's last frame.
    One pass: each interval is given to the bins that it touches on every axis and step, then summed by bin. The last bin may be short. A group
    without intervals has no bins. keys add grouping columns, for which empty bins aren't filled in.
    """
    wanted = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("window_seconds")) for a in axes for s in step_seconds]))
    placed = iv.join(spans(frames).select("grp", "t0"), "grp").select("*", wanted.alias("w")).select("*", "w.axis", "w.window_seconds")
    effective = F.col("axis") == "effective"
    placed = placed.withColumns(
        {
            "p": F.when(effective, F.col("eff_start")).otherwise(F.col("start_t") - F.col("t0")),
            "q": F.when(effective, F.col("eff_end")).otherwise(F.col("end_t") - F.col("t0")),
            "step": F.col("window_seconds").cast("long") * SECOND,
        }
    )
    bins = F.sequence(F.expr("p div step"), F.expr("(q - 1) div step"))
    pieces = placed.withColumn("bin", F.explode(bins)).withColumns({"lo": F.greatest("p", F.col("bin") * F.col("step")), "hi": F.least("q", (F.col("bin") + 1) * F.col("step"))})
    group = ["grp", *keys, "axis", "window_seconds", "step", "bin"]
    sums = integrals(pieces, group)
    total = iv.groupBy("grp").agg(F.max("eff_end").alias("effective_span"))
    ends = total.join(spans(frames).select("grp", "last"), "grp")
    span = F.when(F.col("axis") == "effective", F.col("effective_span")).otherwise(F.col("last"))
    if keys:
        out = sums.join(ends, "grp").withColumn("span", span)
    else:
        spine = ends.select("*", wanted.alias("w")).select("grp", "w.axis", "w.window_seconds", "effective_span", "last").withColumn("span", span)
        spine = spine.withColumn("step", F.col("window_seconds").cast("long") * SECOND)
        spine = spine.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(span - 1) div step"))))
        out = spine.join(sums.drop("step"), ["grp", "axis", "window_seconds", "bin"], "left")
    start, end = F.col("bin") * F.col("step"), F.least((F.col("bin") + 1) * F.col("step"), F.col("span"))
    out = ratios(out.withColumns({"start_us": start, "end_us": end}))
    return out.select(
        "grp", *keys, "window_seconds", "axis", "bin", (F.col("start_us") / SECOND).alias("start_s"), (F.col("end_us") / SECOND).alias("end_s"),
        (F.col("start_us") / SECOND / 3600).alias("start_hour"), (F.col("end_us") / SECOND / 3600).alias("end_hour"), "observed_seconds",
        (F.coalesce("observed", F.lit(0)) / (F.col("end_us") - F.col("start_us"))).alias("coverage"), F.coalesce("interval_pieces", F.lit(0)).cast("long").alias("interval_pieces"),
        "left_mean", "right_mean", "left_insect_minutes", "right_insect_minutes", "left_share", "right_share",
    )


def rebin_segments(iv: DataFrame, frames: DataFrame, step_seconds: int) -> DataFrame:
    """Observed bins of each segment on the actual axis, their ends moved to the segment's; coverage stays the bin's."""
    ends = iv.join(spans(frames), "grp").groupBy("grp", "segment").agg(((F.min(F.col("start_t") - F.col("t0"))) / SECOND).alias("from_s"), (F.max(F.col("end_t") - F.col("t0")) / SECOND).alias("to_s"))
    out = rebin(iv, frames, [step_seconds], ("actual",), ("segment",)).join(ends, ["grp", "segment"]).where("observed_seconds > 0")
    start, end = F.greatest("start_s", "from_s"), F.least("end_s", "to_s")
    return out.withColumns({"start_s": start, "end_s": end, "start_hour": start / 3600, "end_hour": end / 3600}).drop("from_s", "to_s")


def splice_map(iv: DataFrame, frames: DataFrame) -> DataFrame:
    """One row per segment: its ends on both axes and its first and last frame."""
    own = iv.join(spans(frames), "grp")
    return own.groupBy("grp", "segment").agg(
        (F.min(F.col("start_t") - F.col("t0")) / SECOND).alias("actual_start_s"),
        (F.max(F.col("end_t") - F.col("t0")) / SECOND).alias("actual_end_s"),
        (F.min("eff_start") / SECOND).alias("effective_start_s"),
        (F.max("eff_end") / SECOND).alias("effective_end_s"),
        F.min_by("start_frame", "start_t").alias("first_frame"),
        F.max_by("end_frame", "end_t").alias("last_frame"),
    )


def gaps(frames: DataFrame, settings: Settings) -> DataFrame:
    """Adjacent frames that are too far apart (acquisition_gap) or of which one isn't valid (quality_gap)."""
    series = frames.where("grp is not null and t is not null").select("grp", "t", "frame_id", F.coalesce("valid", F.lit(False)).alias("valid"))
    near = with_neighbours(ranged(series, ["grp"], ["t", "frame_id"]), ["grp"], ["t", "frame_id"], ["valid"]).where("prev is not null")
    far = F.col("t") - F.col("prev.t") > settings.max_gap
    near = near.where(far | ~F.col("valid") | ~F.col("prev.valid")).join(spans(frames), "grp")
    return near.select(
        "grp", F.col("prev.frame_id").alias("before"), F.col("frame_id").alias("after"), ((F.col("prev.t") - F.col("t0")) / SECOND).alias("start_s"),
        ((F.col("t") - F.col("t0")) / SECOND).alias("end_s"), ((F.col("t") - F.col("prev.t")) / SECOND).alias("seconds"),
        F.when(far, "acquisition_gap").otherwise("quality_gap").alias("reason"),
    )


def overall(frames: DataFrame, iv: DataFrame) -> DataFrame:
    """One row per group, also for groups without observed time: frames, hours, coverage, means, shares and minutes."""
    base = frames.where("grp is not null and t is not null").groupBy("grp").agg(
        F.count("*").alias("n_images"), F.count_if(F.coalesce("valid", F.lit(False))).alias("n_valid"), F.min("t").alias("first_t"), F.max("t").alias("last_t")
    )
    whole = integrals(iv.withColumns({"p": F.col("start_t"), "q": F.col("end_t"), "lo": F.col("start_t"), "hi": F.col("end_t")}), ["grp"])
    out = ratios(base.join(whole, "grp", "left"))
    actual = F.col("last_t") - F.col("first_t")
    return out.select(
        "grp", "n_images", "n_valid", (F.col("n_images") - F.col("n_valid")).alias("n_invalid"), "first_t", "last_t", (actual / SECOND / 3600).alias("actual_hours"),
        (F.coalesce("observed", F.lit(0)) / SECOND / 3600).alias("effective_hours"), F.try_divide(F.coalesce("observed", F.lit(0)).cast("double"), actual.cast("double")).alias("coverage"),
        "left_mean", "right_mean", "left_share", "right_share", "left_insect_minutes", "right_insect_minutes",
    )


def conservation(bins: DataFrame, totals: DataFrame) -> DataFrame:
    """Per group, axis and step: what bins hold against the overall integral, and whether they agree."""
    sums = bins.groupBy("grp", "axis", "window_seconds").agg(
        F.sum("observed_seconds").alias("bin_seconds"), F.sum("left_insect_minutes").alias("bin_left"), F.sum("right_insect_minutes").alias("bin_right")
    )
    out = sums.join(totals, "grp")

    def close(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= 1e-8 + 1e-9 * F.abs(b)

    same = close(F.col("bin_seconds"), F.col("effective_hours") * 3600) & close(F.col("bin_left"), F.col("left_insect_minutes")) & close(F.col("bin_right"), F.col("right_insect_minutes"))
    return out.select("grp", "axis", "window_seconds", "bin_seconds", "bin_left", "bin_right", same.alias("conserved"))


def valid_elapsed(frames: DataFrame, settings: Settings, flags: dict[str, str]) -> DataFrame:
    """grp, frame_id and, for each name, the seconds of steps up to the frame that are short enough between two frames of a true flag.

    Counts needn't be finite here, unlike in intervals().
    """
    series = frames.where("grp is not null and t is not null").select("grp", "t", "frame_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in flags.values()])
    rows = ranged(series, ["grp"], ["t", "frame_id"])
    near = with_neighbours(rows, ["grp"], ["t", "frame_id"], list(flags.values()))
    dt = F.col("t") - F.col("prev.t")
    steps = {n: F.when(F.col(c) & F.col(f"prev.{c}") & (dt > 0) & (dt <= settings.max_gap), dt).otherwise(0) for n, c in flags.items()}
    near = stage(near.select("grp", "t", "frame_id", RANGE, *[c.alias(f"{n}_step") for n, c in steps.items()]))
    discard(rows)
    out = with_running_sums(near, ["grp"], ["t", "frame_id"], {n: F.col(f"{n}_step") for n in flags})
    return out.select("grp", "frame_id", *[(F.col(n) / SECOND).alias(n) for n in flags])
