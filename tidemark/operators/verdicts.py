"""Rules on verdicts: ladders, gates, triage, alignment backfill, credit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ladder(rules: Sequence[Callable[[], Column]], otherwise: str) -> Column:
    """The answer of the first rule that has one (R8). A rule that can fail should return null instead."""
    return F.coalesce(*(r() for r in rules), F.lit(otherwise))


def fail_gate(df: DataFrame) -> DataFrame:
    """FAIL becomes UNCERTAIN where can_fail is false; `gated` marks it (R9). The only place that decides so."""
    gated = (F.col("status") == "FAIL") & ~F.col("can_fail")
    return df.withColumn("gated", gated).withColumn("status", F.when(F.col("gated"), "UNCERTAIN").otherwise(F.col("status")))


def triage(similarity: Column, can_fail: Column, high: float = 72, low: float = 35) -> Column:
    """PASS, gated FAIL or ESCALATE by similarity."""
    return F.when(similarity >= high, "PASS").when((similarity <= low) & can_fail, "FAIL").when(similarity <= low, "UNCERTAIN").otherwise("ESCALATE")


def backfilled(from_absence: Column) -> Column:
    """Alignment of unjudged rows from their status, but not for a pass from absence."""
    by_status = F.when(F.col("status") == "PASS", "exact").when(F.col("status") == "FAIL", "none").when(F.col("status") == "PARTIAL", "partial")
    return F.when(F.col("alignment").isNotNull(), F.col("alignment")).when(~from_absence, by_status)


def credited(df: DataFrame, distrust: Column) -> DataFrame:
    """Promotes a FAIL or PARTIAL that delivers the substance.

    `literal` says FAIL/<alignment> for every eligible row, even one that was PARTIAL.
    """
    good, some = F.col("alignment").isin("exact", "strong"), F.col("alignment").isin("exact", "strong", "partial")
    able = (F.col("polarity") != "forbidden") & (((F.col("status") == "FAIL") & some) | ((F.col("status") == "PARTIAL") & good))
    able = F.coalesce(able, F.lit(False))
    new = F.when(~able, F.col("status")).when(distrust, "UNCERTAIN").when(good, "PASS").otherwise("PARTIAL")
    return df.withColumns({"literal": F.when(able, F.concat(F.lit("FAIL/"), "alignment")), "status": new})
