"""Verdicts to scores: choice groups, weighted bands with abstention, dimensions, talking points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import mapped

# Fixed values of the scoring rules.
STATUS_RANK = {"PASS": 0, "PARTIAL": 1, "UNCERTAIN": 2, "FAIL": 3, "NOT_APPLICABLE": 4}
STATUS_POINTS2 = {"PASS": 2, "PARTIAL": 1, "FAIL": 0}
ALIGNMENT_RANK = {"none": 0, "weak": 1, "partial": 2, "strong": 3, "exact": 4}
ALIGNMENT_WEIGHT = {"exact": 1.0, "strong": 0.85, "partial": 0.55, "weak": 0.25, "none": 0.0}
BANDS = [(85, "APPROVED"), (70, "MINOR_REVISION"), (50, "NEEDS_MAJOR_REVISION"), (0, "REJECTED")]
COVERAGE_LEAD = 0.90
NO_ORDINAL = 1_000_000


def alignment_rank(column: str = "alignment") -> Column:
    """Ordinal of an alignment level; unjudged (null) ranks below 'none' (X26)."""
    return F.coalesce(mapped(column, ALIGNMENT_RANK), F.lit(-1))


def resolve_groups(df: DataFrame, keys: list[str], ties: tuple[str, ...] = ("q", "polarity", "dimension", "flag")) -> DataFrame:
    """One winner a choice group (W12); the others become NOT_APPLICABLE and `lost` is true.

    Order: status rank, higher alignment, ordinal (0 and null last), id, then the ties columns. Rows with a null group are their own.
    """
    ordinal = F.coalesce(F.when(F.col("ordinal") != 0, F.col("ordinal")), F.lit(NO_ORDINAL))
    own = [*keys, "grp", F.when(F.col("grp").isNull(), F.col("id"))]  # grp as it is: rows that lie by it already stay where they are
    w = Window.partitionBy(*own).orderBy(mapped("status", STATUS_RANK), -alignment_rank(), ordinal, "id", *ties)
    out = df.withColumn("lost", F.row_number().over(w) > 1)
    return out.withColumn("status", F.when(F.col("lost"), "NOT_APPLICABLE").otherwise(F.col("status")))


def sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """Partial sums of a weighted band: tot, dec (decided weight) and earned, all in whole half-weights."""
    decided = F.col("status").isin(*STATUS_POINTS2)
    on = F.col("status") != "NOT_APPLICABLE"
    return df.filter(on).groupBy(*keys).agg(
        F.sum("w2").cast("long").alias("tot"),
        F.sum(F.when(decided, F.col("w2")).otherwise(0)).cast("long").alias("dec"),
        F.sum(F.when(decided, F.col("w2") * mapped("status", STATUS_POINTS2)).otherwise(0)).cast("long").alias("earned"),
        F.count("*").alias("n_units"),
        F.max(((F.col("priority") == "critical") & (F.col("status") == "FAIL")).cast("int")).alias("critical_fail"),
    )


def bands(df: DataFrame) -> DataFrame:
    """pessimistic, optimistic (null if nothing is decided) and coverage of sums (A7); no weight: all null, coverage 0."""
    pess = F.bround(F.try_divide(F.col("earned") * 50.0, F.col("tot")), 0)
    opt = F.bround(F.try_divide(F.col("earned") * 50.0, F.col("dec")), 0)
    return df.withColumns({"pessimistic": pess, "optimistic": opt, "coverage": F.coalesce(F.bround(F.try_divide(F.col("dec") * 1.0, F.col("tot")), 4), F.lit(0.0))})


def band_of(score: Column) -> Column:
    """Band of a score, thresholds inclusive; null is 0."""
    out = F.lit(BANDS[-1][1])
    for least, name in reversed(BANDS[:-1]):
        out = F.when(F.coalesce(score, F.lit(0.0)) >= least, name).otherwise(out)
    return out


def verdict(df: DataFrame) -> DataFrame:
    """band, floored, lead_with_band of bands(): optimistic counts from a coverage of .90, a critical FAIL caps."""
    basis = F.when(F.col("coverage") >= COVERAGE_LEAD, F.col("optimistic")).otherwise(F.col("pessimistic"))
    raw = band_of(basis)
    capped = (F.col("critical_fail") == 1) & raw.isin("APPROVED", "MINOR_REVISION")
    lead = (F.col("coverage") < COVERAGE_LEAD) | ~F.col("pessimistic").eqNullSafe(F.col("optimistic"))
    return df.withColumns({"band": F.when(capped, "NEEDS_MAJOR_REVISION").otherwise(raw), "floored": capped, "lead_with_band": lead})


def collapse_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """Talking points of a key become one unit if there are two or more.

    df: rows with `status` and `w2`. target = max(1, min(n, max(3, ceil(.4 n)))); score is piecewise linear with
    its knee of .7 at the target.
    """
    points = F.sum(F.when(F.col("status").isin(*STATUS_POINTS2), mapped("status", STATUS_POINTS2)).otherwise(0))
    decided = F.sum(F.col("status").isin(*STATUS_POINTS2).cast("int"))
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), decided.alias("n_decided"), points.cast("long").alias("points2"), F.sum("w2").cast("long").alias("w2")).filter("n >= 2")
    target = F.greatest(F.lit(1), F.least(F.col("n"), F.greatest(F.lit(3), F.ceil(F.col("n") * 2 / 5))))
    r, t = F.col("points2") / (2.0 * F.col("n")), target / F.col("n")
    above = F.lit(0.7) + 0.3 * F.least(F.lit(1.0), (r - t) / F.when(t >= 1, 1.0).otherwise(1 - t))
    score = F.bround(F.when(r >= t, above).otherwise(0.7 * r / t), 6)
    g = g.withColumn("target", target.cast("long")).withColumn("score", score)
    status = F.when(F.col("n_decided") == 0, "UNCERTAIN").when(F.col("score") >= 0.7, "PASS").when(F.col("score") > 0, "PARTIAL").otherwise("FAIL")
    return g.withColumn("status", status)
