"""The rest of the inventory: P15, W13, K8, F3, F17, temporal phrases, JSON replies, budgets of frames and pixels, S6, S18, X32, X34."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import fuzzy, parsing, phrases
from tidemark.operators import ranking as rk
from tidemark.registry import query
from tidemark.tables import TIMELINE, UNITS, asks, load, per_text, timeline, units


@query("w13_ordinals", f"WITH {UNITS} SELECT video, id, q, row_number() OVER (PARTITION BY video ORDER BY id, q, polarity, dimension, flag) AS ordinal FROM un WHERE status <> 'NOT_APPLICABLE'")
def w13(spark: SparkSession, d: str) -> DataFrame:
    """Numbers 1 to n after the filter."""
    w = Window.partitionBy("video").orderBy("id", "q", "polarity", "dimension", "flag")
    return units(spark, d).filter("status <> 'NOT_APPLICABLE'").select("video", "id", "q", F.row_number().over(w).alias("ordinal"))


@query(
    "k8_preview_quotas",
    f"""WITH {TIMELINE}, r AS (SELECT *, row_number() OVER (PARTITION BY video, modality ORDER BY t0, event_id) AS rn FROM tl),
    q AS (SELECT *, CASE modality WHEN 'signup' THEN 9 WHEN 'purchase' THEN 8 WHEN 'click' THEN 4 WHEN 'view' THEN 9 ELSE 0 END AS quota FROM r),
    p AS (SELECT video, event_id, row_number() OVER (PARTITION BY video ORDER BY CASE WHEN rn <= quota THEN 0 ELSE 1 END, t0, event_id) AS pos FROM q)
    SELECT video, event_id FROM p WHERE pos <= 30""",
)
def k8(spark: SparkSession, d: str) -> DataFrame:
    """Fixed quotas by reason out of thirty, the rest filled in order of time."""
    from tidemark.tables import mapped

    r = timeline(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("video", "modality").orderBy("t0", "event_id")))
    over = F.when(F.col("rn") <= mapped("modality", {"signup": 9, "purchase": 8, "click": 4, "view": 9}, 0), 0).otherwise(1)
    return rk.first_per(r, ["video"], [over, F.col("t0"), F.col("event_id")], 30).select("video", "event_id")


@query("f3_phrase_variants")
def f3(spark: SparkSession, d: str) -> DataFrame:
    """Variants of each distinct ask: numbers as digits and as words, per cent as sign and as word."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(phrases.phrase_variants)

    return asks(spark, d).select("text").distinct().select("text", F.explode(run("text")).alias("variant"))


HINTS = ["heal", "20% off", "clinically proven", "dermatologist recommended", "score", "in"]


@query("f17_hint_score")
def f17(spark: SparkSession, d: str) -> DataFrame:
    """The best of a requirement's hints in a record, and which: a hint as words scores 100, one of several words or eight letters as far as it is like a part of the record."""
    return per_text(asks(spark, d), "text", lambda t: t.withColumn("best", fuzzy.hint_score(HINTS, F.lower("text")))).select("id", "text", "best.*")


@query(
    "f_temporal_phrases",
    """WITH x AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN 'in the first ' || p_size || ' seconds' WHEN 1 THEN 'last five s' WHEN 2 THEN 'between ' || p_size || ' and 7 seconds' ELSE 'any time' END AS t FROM part)
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN least(p_size, 7) END AS lo, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 5 WHEN 2 THEN greatest(p_size, 7) END AS hi, CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 4 = 1 END AS from_end FROM x""",
)
def temporal(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    m = F.col("p_partkey") % 4
    t = F.when(m == 0, F.concat(F.lit("in the first "), n, F.lit(" seconds"))).when(m == 1, F.lit("last five s")).when(m == 2, F.concat(F.lit("between "), n, F.lit(" and 7 seconds"))).otherwise("any time")
    return load(spark, d, "part").select("p_partkey", parsing.temporal_window(t).alias("w")).select("p_partkey", "w.lo", "w.hi", "w.from_end")


@query("f_json_replies", """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE '{"k":' || json_extract_string(props, '$.k') || '}' END AS json, CASE event_id % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'extracted' WHEN 2 THEN 'repaired' ELSE 'failed' END AS how FROM events""")
def json_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies that are JSON, hold it, nearly are, or aren't."""
    k = F.get_json_object("props", "$.k")
    m = F.col("event_id") % 4
    t = F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done}"))).when(m == 2, F.concat(F.lit("{'k': "), k, F.lit(",}"))).otherwise(F.concat(F.lit("no "), k))
    return load(spark, d, "events").select("event_id", parsing.parse_reply(t).alias("r")).select("event_id", "r.json", "r.how")


@query("x_frame_budget", "WITH n AS (SELECT p_partkey, greatest(12, least(48, greatest(CAST(ceil(p_size / 1.5) AS INTEGER), CAST(ceil(p_partkey % 40 * 1.2) AS INTEGER)))) AS frames FROM part) SELECT p_partkey, frames, CAST(floor(frames * 0.3) AS INTEGER) AS hook, CAST(floor(frames * 0.25) AS INTEGER) AS cta, CAST(floor(1920 * least(1.0::DOUBLE, sqrt(1000000.0::DOUBLE / frames / (1920 * 1080) * 12))) AS INTEGER) AS width FROM n")
def frame_budget(spark: SparkSession, d: str) -> DataFrame:
    """Frames by length and scenes within 12 to 48, the windows' floors, and the width that fits the pixels."""
    frames = F.greatest(F.lit(12), F.least(F.lit(48), F.greatest(F.ceil(F.col("p_size") / 1.5), F.ceil(F.col("p_partkey") % 40 * 1.2)))).cast("int")
    p = load(spark, d, "part").select("p_partkey", frames.alias("frames"))
    width = F.floor(1920 * F.least(F.lit(1.0), F.sqrt(F.lit(1000000.0) / F.col("frames") / (1920 * 1080) * 12))).cast("int")
    return p.select("p_partkey", "frames", F.floor(F.col("frames") * 0.3).cast("int").alias("hook"), F.floor(F.col("frames") * 0.25).cast("int").alias("cta"), width.alias("width"))


@query("x34_report_sections", f"WITH {UNITS} SELECT video, status, count(*) AS n, string_agg(DISTINCT dimension, ',' ORDER BY dimension) AS dimensions, min(id) AS first_id FROM un GROUP BY ALL")
def x34(spark: SparkSession, d: str) -> DataFrame:
    """What a report's sections show."""
    return units(spark, d).groupBy("video", "status").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("dimension")), ",").alias("dimensions"), F.min("id").alias("first_id"))


@query("x32_modalities_present", f"WITH {TIMELINE} SELECT video, string_agg(DISTINCT modality, ',' ORDER BY modality) AS present FROM tl WHERE k < 40 GROUP BY video")
def x32(spark: SparkSession, d: str) -> DataFrame:
    return timeline(spark, d).filter("k < 40").groupBy("video").agg(F.array_join(F.array_sort(F.collect_set("modality")), ",").alias("present"))


@query("s6_columnar_store", "SELECT label, count(*) AS n, CAST(sum(len(embedding)) AS BIGINT) AS cells FROM embeddings GROUP BY label")
def s6(spark: SparkSession, d: str) -> DataFrame:
    """Arrays as Parquet columns."""
    return load(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("embedding")).alias("cells"))
