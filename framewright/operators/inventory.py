"""Inventory of frames: steps, elapsed time, duplicates, gaps, summaries and deterministic samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.ordered import ranged, with_neighbours, with_running_sums
from framewright.schemas import SECOND, Settings


def steps(frames: DataFrame) -> DataFrame:
    """grp, frame_id, t, interval_s: seconds since the frame before, NULL for a group's first frame."""
    near = with_neighbours(ranged(frames.select("grp", "t", "frame_id"), ["grp"], ["t", "frame_id"]), ["grp"], ["t", "frame_id"], [])
    return near.select("grp", "frame_id", "t", ((F.col("t") - F.col("prev.t")) / SECOND).alias("interval_s"))


def elapsed(frames: DataFrame) -> DataFrame:
    """grp, frame_id, elapsed_s since the group's first frame."""
    first = frames.groupBy("grp").agg(F.min("t").alias("t0"))
    return frames.join(first, "grp").select("grp", "frame_id", ((F.col("t") - F.col("t0")) / SECOND).alias("elapsed_s"))


def duplicate_times(frames: DataFrame) -> DataFrame:
    """grp, frame_id, timestamp_duplicate: whether another frame of the group has the same time; a NULL time never has."""
    many = frames.where("t is not null").groupBy("grp", "t").agg(F.count("*").alias("n")).where("n > 1")
    return frames.join(many, ["grp", "t"], "left").select("grp", "frame_id", F.col("n").isNotNull().alias("timestamp_duplicate"))


def acquisition_gaps(frames: DataFrame, settings: Settings) -> DataFrame:
    """The frames that come more than the longest step after the one before."""
    return steps(frames).where(F.col("interval_s") > settings.max_gap / SECOND)


def summary(frames: DataFrame, settings: Settings) -> DataFrame:
    """One row per group: frames, first and last time, elapsed and potentially observed hours, duplicates, missing times.

    Frames without a time count among n and metadata_errors only.
    """
    timed = frames.where("t is not null")
    gap = settings.max_gap / SECOND
    observed = steps(timed).groupBy("grp").agg(F.sum(F.when((F.col("interval_s") > 0) & (F.col("interval_s") <= gap), F.col("interval_s"))).alias("seconds"))
    twins = timed.groupBy("grp", "t").agg(F.count("*").alias("n")).groupBy("grp").agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("timestamp_duplicates"))
    base = frames.groupBy("grp").agg(
        F.count("*").alias("n"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        ((F.max("t") - F.min("t")) / (3600 * SECOND)).alias("elapsed_hours"),
        F.count_if(F.col("t").isNull()).alias("metadata_errors"),
    )
    out = base.join(observed, "grp", "left").join(twins, "grp", "left")
    return out.select(
        "grp", "n", "first_t", "last_t", "elapsed_hours", (F.coalesce("seconds", F.lit(0.0)) / 3600).alias("potentially_observed_hours"),
        F.coalesce("timestamp_duplicates", F.lit(0)).cast("long").alias("timestamp_duplicates"), "metadata_errors",
    )


def interval_histogram(frames: DataFrame) -> DataFrame:
    """grp, interval_s, n: how often each step in seconds occurs; a row each, as a group may have very many."""
    return steps(frames).where("interval_s is not null").groupBy("grp", "interval_s").agg(F.count("*").alias("n"))


def ranks(frames: DataFrame) -> DataFrame:
    """grp, frame_id, rank: the place in the group by time and id, from 0."""
    rows = ranged(frames.select("grp", "t", "frame_id"), ["grp"], ["t", "frame_id"])
    out = with_running_sums(rows, ["grp"], ["t", "frame_id"], {"place": F.lit(1)})
    return out.select("grp", "frame_id", (F.col("place") - 1).cast("long").alias("rank"))


def systematic_sample(frames: DataFrame, number: int = 20) -> DataFrame:
    """grp, frame_id, rank, j: number evenly spaced frames of each group, j from 1; a small group repeats frames."""
    sizes = frames.groupBy("grp").agg(F.count("*").alias("n"))
    wanted = sizes.select("grp", F.explode(F.sequence(F.lit(1), F.lit(number))).alias("j"), "n")
    wanted = wanted.select("grp", "j", F.rint((F.col("j") - 1) * (F.col("n") - 1) / F.lit(float(number - 1))).cast("long").alias("rank"))
    return ranks(frames).join(wanted, ["grp", "rank"]).select("grp", "frame_id", "rank", "j")


def holdout_ranks(n: int, calibration: list[int], number: int, away: int = 6, step: int = 7) -> list[int]:
    """One rank in each number-th of n, moved on by steps while it is near a calibration rank or an earlier holdout.

    Every rank that is taken rules out two tries of a search at most, so the first free one is among as many.
    """
    taken = np.array(calibration, np.int64)
    starts = np.floor((np.arange(number) + 0.43) * n / number).astype(np.int64)
    for start in starts:
        tries = start + step * np.arange(2 * len(taken) + 1)
        free = (np.abs(tries[:, None] - taken[None]) > away).all(axis=1)
        taken = np.append(taken, min(tries[free.argmax()], n - 1))
    return taken[len(calibration) :].tolist()


def samples(frames: DataFrame, settings: Settings, calibration: int = 20) -> DataFrame:
    """grp, frame_id, split, sample_id: calibration and holdout frames of each group.

    Only the groups' sizes go through Python; the frames are then joined by rank.
    """

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for grp, n in zip(pdf.grp, pdf.n, strict=True):
                cal = [round(i * (n - 1) / (calibration - 1)) for i in range(calibration)]
                for split, short, chosen in (("calibration", "cal", cal), ("holdout", "val", holdout_ranks(int(n), cal, settings.holdouts))):
                    rows += [(grp, split, f"{grp}_{short}_{j:02d}", k) for j, k in enumerate(chosen, 1)]
            yield pd.DataFrame(rows, columns=["grp", "split", "sample_id", "rank"])

    sizes = frames.groupBy("grp").agg(F.count("*").alias("n"))
    wanted = sizes.mapInPandas(choose, "grp string, split string, sample_id string, rank long")
    return ranks(frames).join(wanted, ["grp", "rank"]).select("grp", "frame_id", "split", "sample_id", "rank")
