"""Model replies in two rounds: what fails is asked once more, with what was wrong, and then degraded.

A reply is valid if it answers a row of its batch, with a verdict there is, and cites only what that row was offered. The
first round is written before the second one starts, so no row is asked a third time, whatever is computed again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import scratch

# Verdicts and levels of alignment that a reply may have.
STATUSES = ["PASS", "PARTIAL", "FAIL", "UNCERTAIN", "NOT_APPLICABLE"]
LEVELS = ["none", "weak", "partial", "strong", "exact"]
#: Calls to one model: rows of one key that are asked together.
BATCH = 12


def validated(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """asked with status, alignment, cited, reason, wrong and strange: a row's valid reply, or why it has none.

    asked: key, id (unique), offered (array of evidence ids). replies: key, id, status, alignment, cited, reason,
    seq. Of several valid replies to a row the last one counts. wrong: `missing`, `status:<said>` or `cited:<ids>` of the
    last invalid one. strange: replies of the key to ids that weren't asked. An unknown alignment is none.
    """
    said = F.upper(F.trim(F.coalesce("status", F.lit(""))))
    level = F.lower(F.trim(F.coalesce("alignment", F.lit(""))))
    r = replies.select("key", "id", said.alias("status"), F.when(level.isin(LEVELS), level).alias("alignment"), F.coalesce("cited", F.array().cast("array<string>")).alias("cited"), F.substring(F.coalesce("reason", F.lit("")), 1, 400).alias("reason"), "seq")
    both = r.join(asked.select("key", "id", "offered", F.lit(True).alias("known")), ["key", "id"], "left")
    made_up = F.array_except("cited", F.coalesce("offered", F.array().cast("array<string>")))
    wrong = F.when(F.size(made_up) > 0, F.concat(F.lit("cited:"), F.array_join(F.slice(made_up, 1, 3), ","))).when(~F.col("status").isin(STATUSES), F.concat(F.lit("status:"), F.col("status")))
    both = both.withColumn("wrong", wrong)
    strange = both.filter("known is null").groupBy("key").agg(F.count("*").alias("strange"))
    per = both.filter("known").groupBy("key", "id").agg(
        F.max(F.when(F.col("wrong").isNull(), F.struct("seq", "status", "alignment", "cited", "reason"))).alias("good"), F.max(F.when(F.col("wrong").isNotNull(), F.struct("seq", "wrong"))).alias("bad")
    )
    out = asked.join(per, ["key", "id"], "left").join(strange, "key", "left")
    why = F.when(F.col("good").isNull(), F.coalesce("bad.wrong", F.lit("missing")))
    return out.select(*asked.columns, "good.status", "good.alignment", "good.cited", "good.reason", why.alias("wrong"), F.coalesce("strange", F.lit(0)).alias("strange"))


def ask_twice(spark: SparkSession, rows: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with a valid reply each, or UNCERTAIN: status, alignment, cited, reason, rounds, health, flags.

    rows: key, id (unique), offered and what `ask` reads. ask(rows) gives replies (see validated) to rows that also have
    round (1 or 2), batch (their number in their key, BATCH rows each) and wrong (null, or what was wrong with the first
    reply). The second round asks only what failed. health: `ok`, `repaired` (valid at the second try) or `degraded`, which is
    UNCERTAIN with alignment null; flags say what was wrong.
    """
    nothing = F.lit(None).cast("string")
    first = _round(spark, rows.withColumn("wrong", nothing), 1, ask)
    again = first.filter("wrong is not null").select(*rows.columns, "wrong")
    second = _round(spark, again, 2, ask)
    good = first.filter("wrong is null").withColumn("before", nothing)
    out = good.withColumn("rounds", F.lit(1)).unionByName(second.withColumn("rounds", F.lit(2)))
    lost = F.col("wrong").isNotNull()
    health = F.when(lost, "degraded").when(F.col("rounds") == 2, "repaired").otherwise("ok")
    flags = F.array_compact(F.array(F.concat(F.lit("FIRST:"), F.col("before")), F.concat(F.lit("SECOND:"), F.col("wrong"))))
    return out.select(*rows.columns, F.when(lost, "UNCERTAIN").otherwise(F.col("status")).alias("status"), F.when(~lost, F.col("alignment")).alias("alignment"), F.when(~lost, F.col("cited")).otherwise(F.array().cast("array<string>")).alias("cited"),
                      F.when(lost, F.lit("")).otherwise(F.col("reason")).alias("reason"), "rounds", health.alias("health"), flags.alias("flags"))


def _round(spark: SparkSession, rows: DataFrame, number: int, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The validated replies of one round, written: `before` is what was wrong before it, `wrong` what is now."""
    batch = F.floor(_place(rows) / BATCH).alias("batch")
    asked = rows.select("*", F.lit(number).alias("round"), batch)
    replies = _written(spark, ask(asked), "replies")
    found = validated(rows.withColumnRenamed("wrong", "before"), replies)
    return _written(spark, found, "round")


def _place(rows: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("key").orderBy("id")) - 1


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batch_health(rows: DataFrame) -> DataFrame:
    """key, n, repaired, degraded and verdict of what ask_twice gave: `ok`, `degraded` or, from half on, `failed`."""
    g = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("health") == "repaired").alias("repaired"), F.count_if(F.col("health") == "degraded").alias("degraded"))
    return g.withColumn("verdict", F.when(F.col("degraded") * 2 >= F.col("n"), "failed").when(F.col("degraded") > 0, "degraded").otherwise("ok"))
