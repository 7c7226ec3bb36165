"""The stream of captions closes the intervals that the batch operator finds, in whatever order sightings come."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sequential as sq
from tidemark.streaming import captions

SCHEMA = "video long, ms long, text string, confidence double, x0 double, y0 double, x1 double, y1 double"
GAP = 3000


def sightings() -> list[tuple]:
    r = random.Random(5)
    rows = []
    for video in range(4):
        for k in range(60):
            text = r.choice(["save", "save now", "save now 20", "save now 30", "s ave now", "other words"])
            x = r.choice([0, 0, 0, 200])
            rows.append((video, k * 700 + r.choice([0, 0, 0, 9000]) + r.randrange(300), text, r.choice([0.3, 0.9]), x, 0, x + 5 * len(text), 10))
    return sorted(set(rows), key=lambda x: x[1])


def batch(rows: list[tuple]) -> set[tuple]:
    names = ["t", "text", "confidence", "x0", "y0", "x1", "y1"]
    out = set()
    for video in {x[0] for x in rows}:
        own = [dict(zip(names, (x[1], x[2], x[3], *map(float, x[4:])), strict=True)) for x in sorted(x for x in rows if x[0] == video)]
        out |= {(video, o["start"], o["end"], o["text"], o["n"], o["best"]) for o in sq.text_intervals(own, GAP, captions.like)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_is_the_batch(spark, tmp_path, seed):
    rows, r = sightings(), random.Random(seed)
    files = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for i, part in enumerate(files):  # out of order within a file; a file is as late as the watermark allows
        r.shuffle(part)
        spark.createDataFrame([(*x[:4], *map(float, x[4:])) for x in part], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/f{i}")
    end = spark.createDataFrame([(99, 10_000_000 + i, "end", 0.1, 0.0, 0.0, 1.0, 1.0) for i in range(1)], SCHEMA)
    end.coalesce(1).write.parquet(f"{tmp_path}/in/f8")
    end.withColumn("ms", F.col("ms") + 1).coalesce(1).write.parquet(f"{tmp_path}/in/f9")
    for k, v in captions.STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{tmp_path}/in")
        stream = stream.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", "20 seconds")
        name = f"captions{seed}"
        q = captions.caption_intervals(stream, GAP).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(240)
        got = [tuple(x) for x in spark.table(name).collect()]
        left = q.lastProgress.stateOperators[0].numRowsTotal
    finally:
        for k in captions.STORE:
            spark.conf.unset(k)
    assert len(got) == len(set(got))
    assert {x for x in got if x[0] != 99} == batch(rows)
    assert left <= 8  # of the last video's sighting, its timers and columns only


def test_batch_of_intervals_is_unchanged():
    rows = [{"t": t, "text": x, "confidence": c} for t, x, c in [(0, "a", 0.5), (1, "b", 0.9), (2, "a", 0.4), (9, "a", 0.3), (10, "ab", 0.3)]]
    got = list(sq.text_intervals(rows, 3, lambda a, b: a["text"][0] == b["text"][0]))
    assert [(o["text"], o["start"], o["end"], o["n"]) for o in got] == [("a", 0, 2, 2), ("b", 1, 1, 1), ("ab", 9, 10, 2)]
