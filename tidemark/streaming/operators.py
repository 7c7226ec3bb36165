"""Event-time windows, sessions, stateful intervals, deduplication and progress.

Sources are folders of Parquet files; `ts` is cast to TIMESTAMP, for watermarks don't take timestamp_ntz.
Results in append mode hold closed windows only; what is still open comes with complete mode.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1, late: str = "1 hour", only: str = "*") -> DataFrame:
    """Files of a folder (those whose names match `only`) as a stream with a watermark on `at`; files_per_trigger bounds each batch."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", only).parquet(folder)
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def tumbling_windows(rows: DataFrame, width: str = "1 hour") -> DataFrame:
    g = rows.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.unix_seconds("w.start").alias("w"), "event_type", "n")


def sliding_windows(rows: DataFrame, width: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    g = rows.groupBy(F.window("at", width, step).alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.unix_seconds("w.start").alias("w"), "n")


def session_windows(rows: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions by user; `ended` is the last event's time, not the window's end."""
    g = rows.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n"))
    return g.select("user_id", F.unix_seconds("a").alias("began"), F.unix_seconds("b").alias("ended"), "n")


def deduplicated(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """Each key once, with state bounded by the watermark: replays write nothing twice."""
    return rows.dropDuplicatesWithinWatermark([key])


def text_sessions(rows: DataFrame, gap_s: float) -> DataFrame:
    """Intervals of like (user, event type): closed when the watermark passes last + gap.

    The open intervals of a key are its state; a row extends the open one if the gap is small enough,
    else it opens the next. Late rows that the watermark lets through extend backwards.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list[list[float]] = json.loads(state.get[0]) if state.exists else []
        if not state.hasTimedOut:
            for pdf in batches:
                held += [[t, t, 1] for t in pdf["t"].tolist()]
        merged: list[list[float]] = []
        for a, b, n in sorted(held):
            if merged and a - merged[-1][1] <= gap_s:
                merged[-1][1] = max(merged[-1][1], b)
                merged[-1][2] += n
            else:
                merged.append([a, b, n])
        mark = state.getCurrentWatermarkMs() / 1000
        closed = [m for m in merged if m[1] + gap_s < mark]
        left = [m for m in merged if m[1] + gap_s >= mark]
        if left:
            state.update((json.dumps(left),))
            state.setTimeoutTimestamp(int(max(mark, left[0][1] + gap_s) * 1000) + 1)
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame({"user_id": key[0], "event_type": key[1], "began": [m[0] for m in closed], "ended": [m[1] for m in closed], "n": [int(m[2]) for m in closed]})

    out = "user_id long, event_type string, began double, ended double, n long"
    seconds = rows.select("user_id", "event_type", "at", (F.unix_micros("at") / 1e6).alias("t"))
    return seconds.groupBy("user_id", "event_type").applyInPandasWithState(step, out, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(rows: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Everything there now, into a memory table: batches of bounded size, then stop."""
    q = rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows.sparkSession.table(name)


def completed(rows: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Everything there now in complete mode: each micro-batch's whole result replaces the folder's Parquet files."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    q = rows.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def upserted(rows: DataFrame, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """foreachBatch into a Parquet folder of one subfolder a batch: each key once, of the first batch that has it.

    A batch that is run again replaces its own subfolder, and looks for known keys in those of earlier batches only.
    """

    def save(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(keys)
        if number:
            known = batch.sparkSession.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", target).parquet(target)
            new = new.join(known.filter(F.col("batch") < number).select(*keys), keys, "left_anti").select(*batch.columns)
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Rows and duration of each micro-batch."""

    def __init__(self) -> None:
        self.batches: list[dict[str, Any]] = []

    def onQueryStarted(self, event: Any) -> None: ...

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        self.batches.append({"batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration})

    def onQueryIdle(self, event: Any) -> None: ...

    def onQueryTerminated(self, event: Any) -> None: ...


def progress_of(spark: SparkSession) -> Progress:
    listener = Progress()
    spark.streams.addListener(listener)
    return listener
