"""Gap-aware segments of a stream of frames, as a stateful processor: what occupancy.splice_map gives, kept up to date.

The state of a group is its last frame and its open segment, whatever the group's length. Adjacent frames that are both
valid and counted, with a positive step of at most the longest one, lengthen the segment; anything else ends it. Frames
of a batch are put in order first; one that comes after a later one of its group was worked on is reported as late, not
dropped in silence. An event-time timer closes a segment once the watermark has passed all that could lengthen it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE = "t long, frame_id long, usable boolean, segment long, start_t long, end_t long, eff_start long, eff_end long, first_frame long, last_frame long, closed boolean"
RESULT = "grp string, segment long, start_t long, end_t long, eff_start long, eff_end long, first_frame long, last_frame long, closed boolean, late long"
SEGMENT = ("segment", "start_t", "end_t", "eff_start", "eff_end", "first_frame", "last_frame", "closed")


class Segments(StatefulProcessor):
    def __init__(self, max_gap: int):
        self.max_gap = max_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("group", STATE)

    def _result(self, grp: str, rows: list[dict], late: int = 0) -> pd.DataFrame:
        out = pd.DataFrame([{"grp": grp, **r, "late": 0} for r in rows] + ([{"grp": grp, "late": late}] if late else []), columns=["grp", *SEGMENT, "late"])
        return out.astype({c: "Int64" for c in SEGMENT[:-1]} | {"closed": "boolean", "late": "int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        kept = self.state.get() if self.state.exists() else None
        last = dict(zip(STATE.replace(" long", "").replace(" boolean", "").split(", "), kept, strict=True)) if kept is not None else None
        frames = pd.concat(list(rows)).sort_values(["t", "frame_id"], kind="stable")
        late = 0
        if last is not None:
            behind = (frames.t < last["t"]) | ((frames.t == last["t"]) & (frames.frame_id <= last["frame_id"]))
            late, frames = int(behind.sum()), frames[~behind]
        if not len(frames):
            if late:
                yield self._result(key[0], [], late)
            return
        head = last is not None
        t = np.concatenate(([last["t"]] if head else [], frames.t)).astype(np.int64)
        ids = np.concatenate(([last["frame_id"]] if head else [], frames.frame_id)).astype(np.int64)
        usable = np.concatenate(([last["usable"]] if head else [], frames.usable)).astype(bool)
        dt = np.diff(t)
        pair = np.flatnonzero(usable[:-1] & usable[1:] & (dt > 0) & (dt <= self.max_gap))
        open_ = {c: last[c] for c in SEGMENT} if head else dict.fromkeys(SEGMENT, 0) | {"end_t": None, "closed": True}
        changed: list[dict] = []
        if len(pair):
            start, end = t[pair], t[pair + 1]
            joins = start[1:] == end[:-1]
            first = np.flatnonzero(np.concatenate(([True], ~joins)))
            stops = np.append(first[1:], len(pair)) - 1
            for a, z in zip(first.tolist(), stops.tolist(), strict=True):
                length = int((end[a : z + 1] - start[a : z + 1]).sum())
                if a == 0 and not open_["closed"] and open_["end_t"] == int(start[0]):
                    open_ = open_ | {"end_t": int(end[z]), "eff_end": open_["eff_end"] + length, "last_frame": int(ids[pair[z] + 1])}
                else:
                    if not open_["closed"]:
                        changed.append(open_ | {"closed": True})
                    filled = open_["eff_end"]
                    open_ = {
                        "segment": open_["segment"] + 1, "start_t": int(start[a]), "end_t": int(end[z]), "eff_start": filled, "eff_end": filled + length,
                        "first_frame": int(ids[pair[a]]), "last_frame": int(ids[pair[z] + 1]), "closed": False,
                    }
            changed.append(open_)
        self.state.update((int(t[-1]), int(ids[-1]), bool(usable[-1]), *[open_[c] for c in SEGMENT]))
        if not open_["closed"]:
            self.handle.registerTimer((open_["end_t"] + self.max_gap) // 1000 + 1)
        yield self._result(key[0], changed, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.state.get() if self.state.exists() else None
        # a later frame may have lengthened or ended the segment and set another timer
        if kept is not None and not kept[10] and (kept[5] + self.max_gap) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            done = dict(zip(SEGMENT, kept[3:], strict=True)) | {"closed": True}
            self.state.update((*kept[:10], True))
            yield self._result(key[0], [done])
        else:
            yield self._result(key[0], [])

    def close(self) -> None:
        pass


def segments_of(frames: DataFrame, time: str, max_gap: int, lateness: str) -> DataFrame:
    """Updates of the segments of a stream of frames: grp, t, frame_id, left_count, right_count, valid, and time, a timestamp.

    For the update mode, with RocksDB as state store (STORE). Frames without group or time take no part.
    """
    usable = F.coalesce(F.col("valid") & F.col("left_count").isNotNull() & F.col("right_count").isNotNull(), F.lit(False))
    rows = frames.where(f"grp is not null and t is not null and {time} is not null").withWatermark(time, lateness).select("grp", time, "t", "frame_id", usable.alias("usable"))
    return rows.groupBy("grp").transformWithStateInPandas(Segments(max_gap), RESULT, "Update", "EventTime")


def latest_segments(updates: DataFrame) -> DataFrame:
    """The last state of each segment among written updates."""
    own = Window.partitionBy("grp", "segment").orderBy(F.desc("eff_end"), F.desc("closed"))
    return updates.where("segment is not null").withColumn("k", F.row_number().over(own)).where("k = 1").drop("k", "late", "batch")
