"""Loaders, and the stand-ins of the domain's tables: timeline, utterances, scored units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Milliseconds that one unit of an event's value lasts on the timeline.
VALUE_MS = 360_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str | Column) -> DataFrame:
    """The rows dealt over as many tasks as a shuffle has, however few bytes they are: for much work a row."""
    # by a hash of the columns, as an exchange by the columns themselves may go for one that is there, which adaptive execution makes few tasks of
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*by))


def per_text(df: DataFrame, text: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that made(its distinct texts) adds to them: equal texts are worked on once, spread over all tasks."""
    kinds = made(spread(df.select(text).distinct(), text)).withColumnRenamed(text, "_text")
    return df.join(kinds, F.col(text).eqNullSafe(F.col("_text"))).drop("_text")


#: Requirement texts, a part's name in place of {}.
ASKS = [
    "Show the {} in the first three seconds.",
    "Say {} saves twenty-five % on day 1",
    "Never claim that {} cures eczema.",
    "Must show 20% off {}, it is visible",
    "Ideally hold the {} close up",
    "Make {} feel premium",
    "Use code SAVE30 for 27.5 percent off {}",
    "Do not say {} is better than other brands",
    'End with a call to action: "shop now"',
    "Speak to the camera about {}",
    "Speak to teens who like {}",
    "Keep it no longer than 30 seconds, {} first",
    "Captions mention {} and the price $ 5",
    "Explain how to use {} step by step, two hundred times",
    "{} lasts 3months or 12 weeks, guaranteed overnight results",
    "Clinically proven {}: 1,500 users, 90 percent agree",
    "Tag us, logo visible, {} packaging",
    "healthy hair with {}",
    "heals and healing, says {}",
    "Try to film {} with good energy and 100% fun",
    "A dermatolgist recommended hydrating serum, {}",
    "The score is 8 out of 10 for {}, a premium vibe with 3 monthly drops",
    "Serum and cleanser routine; {} in action, linkinbio",
    "{}",
]


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as requirements: id and text, a template of ASKS with the part's name."""
    templates = F.array(*map(F.lit, ASKS))
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return p.select("id", F.replace(F.get(templates, (F.col("id") % len(ASKS)).cast("int")), F.lit("{}"), F.col("p_name")).alias("text"))


#: The same as DuckDB text, to stand after WITH.
ASKS_SQL = "asks AS (SELECT p_partkey AS id, replace([" + ", ".join("'" + a.replace("'", "''") + "'" for a in ASKS) + f"][p_partkey % {len(ASKS)} + 1], '{{}}', p_name) AS text FROM part)"


#: Lines of a document of requirements, a part's name in place of {}.
BRIEF_LINES = [
    "The {} launch", "## Campaign Objectives", "Make people try {} at home", "KEY MESSAGES:", "- {} is made with care", "{} works overnight.", "Sample Hook Concepts",
    "1. Show the {} close up", '"{} changed my mornings"', "This creator begins her video with {}", "Reference: https://example.com/{}", "___", "Prohibited Claims",
    "Do not say {} cures anything", "use the hook from the {} list", "a small idea", "Requirements", "The creator must show {}", "Tag us in every post about {}", "What it is not, only",
]


def brief_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as documents of ten lines: doc, pos and line, a template of BRIEF_LINES with the part's name."""
    at = (F.col("p_partkey") % len(BRIEF_LINES)).cast("int")
    line = F.replace(F.get(F.array(*map(F.lit, BRIEF_LINES)), at), F.lit("{}"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return load(spark, sf_dir, "part").select(F.expr("p_partkey div 10").alias("doc"), (F.col("p_partkey") % 10).alias("pos"), line.alias("line"))


#: The same as DuckDB text, to stand after WITH.
BRIEF_LINES_SQL = "bl AS (SELECT p_partkey // 10 AS doc, p_partkey % 10 AS pos, replace([" + ", ".join("'" + a.replace("'", "''") + "'" for a in BRIEF_LINES) + f"][p_partkey % {len(BRIEF_LINES)} + 1], '{{}}', replace(p_name, ' ', '_')) AS line FROM part)"


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as records: event_id, video, modality, t0 and t1 (ms since the video's first event), value, k."""
    e = load(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    first = e.groupBy("user_id").agg(F.min("us").alias("first"))
    t0 = F.expr("(us - first) div 1000")
    return e.join(first, "user_id").select(
        "event_id",
        F.col("user_id").alias("video"),
        F.col("event_type").alias("modality"),
        t0.alias("t0"),
        (t0 + F.round(F.col("value") * VALUE_MS).cast("long")).alias("t1"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


#: The same as DuckDB text, to stand after WITH.
TIMELINE = """tl AS (
  SELECT event_id, user_id AS video, event_type AS modality,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000 AS t0,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000 + CAST(round(value * 360000) AS BIGINT) AS t1,
    value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""

PRIORITY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium"}
#: Weights by priority, doubled so that sums are whole numbers.
WEIGHT2 = {"critical": 6, "high": 4, "medium": 2, "low": 1}
STATUS = {"F": "FAIL", "O": "PASS", "P": "UNCERTAIN"}


def mapped(column: str, values: dict, other=None):
    """column through a fixed map."""
    out = F.lit(other)
    for k, v in reversed(values.items()):
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


#: Lines that a task of units() joins, on average: it sorts them for the join, and again for windows over an order.
LINES = 2_000_000


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with orders as verdicts: video (customer), grp (order), id, ordinal, status, priority, w2, alignment, dimension, polarity.

    The join has tasks by the number of lines (known from the files' footers), so that none grows with the input.
    """
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_partkey", "l_suppkey")
    tasks = -(-li.count() // LINES)
    if tasks > 1:  # by number, as adaptive execution makes few tasks of small bytes
        tasks = max(tasks, spark.sparkContext.defaultParallelism)
        li, o = li.repartition(tasks, "l_orderkey"), o.repartition(tasks, "o_orderkey")
    u = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    q = F.col("l_quantity").cast("long")
    status = F.when(q % 9 == 0, "PARTIAL").when(q % 10 == 0, "NOT_APPLICABLE").otherwise(mapped("o_orderstatus", STATUS))
    status = F.when((q % 4 == 1) & (F.col("o_orderstatus") == "F"), "PASS").otherwise(status)
    align = F.when(q % 6 == 0, "exact").when(q % 6 == 1, "strong").when(q % 6 == 2, "partial").when(q % 6 == 3, "weak").when(q % 6 == 4, "none")
    u = u.withColumn("priority", mapped("o_orderpriority", PRIORITY, "low"))
    return u.select(
        F.col("o_custkey").alias("video"),
        F.col("l_orderkey").alias("grp"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_linenumber").alias("ordinal"),
        status.alias("status"),
        "priority",
        mapped("priority", WEIGHT2).alias("w2"),
        align.alias("alignment"),
        F.col("l_returnflag").alias("flag"),
        F.concat(F.lit("d"), (F.col("l_suppkey") % 7).cast("string")).alias("dimension"),
        F.when(F.col("l_partkey") % 10 == 0, "forbidden").otherwise("required").alias("polarity"),
        q.alias("q"),
    )


UNITS = """un AS (
  SELECT o_custkey AS video, l_orderkey AS grp, l_orderkey * 10 + l_linenumber AS id, l_linenumber AS ordinal,
    CASE WHEN CAST(l_quantity AS BIGINT) % 4 = 1 AND o_orderstatus = 'F' THEN 'PASS'
      WHEN CAST(l_quantity AS BIGINT) % 9 = 0 THEN 'PARTIAL' WHEN CAST(l_quantity AS BIGINT) % 10 = 0 THEN 'NOT_APPLICABLE'
      WHEN o_orderstatus = 'F' THEN 'FAIL' WHEN o_orderstatus = 'O' THEN 'PASS' WHEN o_orderstatus = 'P' THEN 'UNCERTAIN' END AS status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
    CASE o_orderpriority WHEN '1-URGENT' THEN 6 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 2 ELSE 1 END AS w2,
    CASE CAST(l_quantity AS BIGINT) % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'strong' WHEN 2 THEN 'partial' WHEN 3 THEN 'weak' WHEN 4 THEN 'none' END AS alignment,
    l_returnflag AS flag, 'd' || CAST(l_suppkey % 7 AS VARCHAR) AS dimension,
    CASE WHEN l_partkey % 10 = 0 THEN 'forbidden' ELSE 'required' END AS polarity, CAST(l_quantity AS BIGINT) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
