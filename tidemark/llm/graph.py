"""Connected components of a table of links, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _joined(spark: SparkSession, rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows with the least of their a: both sides come from written tables, so a crowded a can be split."""
    return rows.join(written(spark, least, "least"), "a")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """a, b: for each member of a link but the least of its component, that least member.

    `links` has long columns a and b. Every round halves distances at least; its tables are written to
    the shared folder, and no node's neighbours are ever gathered in one place.
    """
    edges = written(spark, links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = None
    while True:
        both = written(spark, edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _joined(spark, both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(spark, large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _joined(spark, large, least).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = written(spark, small.filter("a <> b").distinct(), "small")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == last:
            return edges
        last = now
