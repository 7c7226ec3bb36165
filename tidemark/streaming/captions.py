"""Captions as a stream: sightings merge into intervals by likeness, not by equal keys (W3, SURVEY 2.10).

A video's state is two lists: sightings that the watermark hasn't passed, for an earlier one may still come, and open
intervals. Event-time timers move the first into the second in order, exactly as the batch operator does, and close
what nothing can extend. Whatever the order in which sightings come within the watermark, the intervals are those of
the batch. After its last timer a video has no state. (Time to live is for processing time; here timers do its work.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import sequential as sq

#: The state store that transformWithState needs, to be set before a stream starts.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_SIGHTING = "t long, text string, confidence double, x0 double, y0 double, x1 double, y1 double"
_OPEN = "start long, end long, text string, best double, n long, x0 double, y0 double, x1 double, y1 double"
_NAMES = [[c.split()[0] for c in s.split(", ")] for s in (_SIGHTING, _OPEN)]


def like(a: dict, b: dict) -> bool:
    box = lambda r: (r["x0"], r["y0"], r["x1"], r["y1"])
    return sq.one_caption(a["text"], box(a), b["text"], box(b))


class _Intervals(StatefulProcessor):
    def __init__(self, max_gap_ms: int, alike: Callable[[dict, dict], bool], least_seen: int, sure: float):
        self.gap, self.alike, self.least_seen, self.sure = max_gap_ms, alike, least_seen, sure

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.open = handle.getListState("waiting", _SIGHTING), handle.getListState("open", _OPEN)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            new = [tuple(r) for r in pdf[_NAMES[0]].astype(object).itertuples(index=False)]
            self.waiting.appendList(new)
            for t in {r[0] for r in new}:
                self.handle.registerTimer(t + 1)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get())
        due, later = [r for r in held if r[0] < mark], [r for r in held if r[0] >= mark]
        open_ = [dict(zip(_NAMES[1], o, strict=True)) for o in self.open.get()]
        closed: list[dict] = []
        for r in due:
            closed += sq.past(open_, r[0], self.gap)
            sq.sighted(open_, dict(zip(_NAMES[0], r, strict=True)), self.alike)
        closed += sq.past(open_, mark, self.gap)
        for state, rows in ((self.waiting, later), (self.open, [tuple(o[c] for c in _NAMES[1]) for o in open_])):
            state.put(rows) if rows else state.clear()
        for o in open_:
            self.handle.registerTimer(o["end"] + self.gap + 1)
        done = list(sq.survivors(closed, self.least_seen, self.sure))
        if done:
            yield pd.DataFrame([{"video": key[0]} | {c: o[c] for c in ("start", "end", "text", "n", "best")} for o in done])

    def close(self) -> None: ...


def caption_intervals(rows: DataFrame, max_gap_ms: int, alike: Callable[[dict, dict], bool] = like, least_seen: int = 2, sure: float = 0.85) -> DataFrame:
    """video, start, end, text, n, best of each closed interval, times in milliseconds; see sequential.text_intervals.

    rows: a stream with a watermark on `at`, and video, text, confidence, x0, y0, x1, y1. The session must have STORE.
    """
    seen = rows.select("video", "at", F.unix_millis("at").alias("t"), "text", F.col("confidence").cast("double").alias("confidence"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    out = "video long, start long, end long, text string, n long, best double"
    return seen.groupBy("video").transformWithStateInPandas(_Intervals(max_gap_ms, alike, least_seen, sure), out, "append", "eventTime")
