"""Closed intervals on a key's time line: union, coverage, gaps, overlap and nearest joins, sessions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """df with `island`: rows chain while a start is at most `gap` after the greatest end so far (A1).

    Intervals that touch (gap 0) chain. Rows without a start or end get a null island.
    """
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) - reach > gap), 1).otherwise(0)
    whole = F.col(start).isNotNull() & F.col(end).isNotNull()
    marked = df.filter(whole).withColumn("_new", new)
    return marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def union(df: DataFrame, keys: list[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """Disjoint intervals that cover the same time (A1): keys, island, start, end, n."""
    return islands(df, keys, start, end, gap).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def union_length(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Time covered at all, overlaps counted once (A2): keys, covered, n_islands."""
    return union(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"), F.count("*").alias("n_islands"))


def gaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """What lies between the islands of a key: keys, start, end."""
    u = union(df, keys, start, end)
    w = Window.partitionBy(*keys).orderBy("island")
    return u.withColumn("_next", F.lead(start).over(w)).filter("_next is not null").select(*keys, F.col(end).alias(start), F.col("_next").alias(end))


def coverage_bins(df: DataFrame, keys: list[str], start: str, end: str, duration: str, width: int) -> DataFrame:
    """Runs of uncovered bins of a key's time line (A4): keys, gap_start, gap_end.

    Bin b is covered if some interval has floor(start/width) <= b <= floor(end/width); the last run ends at
    the duration. `duration` is the key's length on every row.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col(duration) / width)).cast("long")
    per = df.groupBy(*keys).agg(F.max(duration).alias("_d")).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("_d") / width)).cast("long"))
    spans = df.select(*keys, F.expr(f"{start} div {width}").alias("_a"), F.least(F.expr(f"{end} div {width}"), n - 1).alias("_b")).filter("_a <= _b")
    runs = union(spans.withColumn("_b", F.col("_b") + 1), keys, "_a", "_b")  # touching bins join
    edge = per.select(*keys, F.lit(0).cast("long").alias("_a"), F.lit(0).cast("long").alias("_b")).unionByName(per.select(*keys, F.col("_n").alias("_a"), F.col("_n").alias("_b")))
    free = gaps(runs.select(*keys, "_a", "_b").unionByName(edge), keys, "_a", "_b").filter("_a < _b")
    return free.join(per, keys).select(*keys, (F.col("_a") * width).alias("gap_start"), F.when(F.col("_b") == F.col("_n"), F.col("_d")).otherwise(F.col("_b") * width).alias("gap_end"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], slack: int = 0, width: int = 3_600_000) -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals, widened by slack, overlap.

    Both sides are spread over bins of `width` and meet in equi-joins on (keys, bin); a pair is kept only
    in the first bin that both have, so none comes twice. Column names other than keys must differ.
    """
    a, b = (F.expr(f"{c[0]} div {width}") for c in (l, r))
    wide_l = left.withColumn("_bin", F.explode(F.sequence(F.expr(f"({l[0]} - {slack}) div {width}"), F.expr(f"({l[1]} + {slack}) div {width}"))))
    wide_r = right.withColumn("_bin", F.explode(F.sequence(b, F.expr(f"{r[1]} div {width}"))))
    first = F.greatest(F.expr(f"({l[0]} - {slack}) div {width}"), b)
    met = (F.col(l[0]) - slack <= F.col(r[1])) & (F.col(l[1]) + slack >= F.col(r[0]))
    return wide_l.join(wide_r, [*keys, "_bin"]).filter(met & (F.col("_bin") == first)).drop("_bin")


def nearest_join(points: DataFrame, grid: DataFrame, keys: list[str], t: str, g: str) -> DataFrame:
    """points with the nearest grid value `g` of their key, the earlier on a tie (J6); null without a grid.

    One sort of both sides together: the last grid value at or before and the first after a point.
    """
    both = points.withColumn("_t", F.col(t)).unionByName(grid.select(*keys, F.col(g).alias("_t"), F.col(g).alias("_g")), allowMissingColumns=True)
    # at equal times the grid row comes first
    w = Window.partitionBy(*keys).orderBy("_t", F.col("_g").isNull())
    before = F.last("_g", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_g", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumns({"_before": before, "_after": after}).filter("_g is null")
    near = F.when(F.col("_before").isNull() | (F.col("_after") - F.col(t) < F.col(t) - F.col("_before")), F.col("_after")).otherwise(F.col("_before"))
    return found.withColumn(g, near).drop("_t", "_g", "_before", "_after")


def within(start: Column, end: Column, lo: Column, hi: Column, tolerance: Column | int = 0, slack: Column | int = 0) -> Column:
    """Closed overlap with the window, both ends widened by tolerance and slack."""
    return (start - tolerance - slack <= hi) & (end + tolerance + slack >= lo)


def separated(df: DataFrame, keys: list[str], t: str, least: int) -> DataFrame:
    """Times kept greedily: each at least `least` after the last one kept (W5): keys, t.

    The rule depends on what was kept: a key's distinct times pass by in order, and only the last one kept is held.
    """
    from tidemark.operators.sequential import streamed

    def keep(rows: Iterator[dict]) -> Iterator[dict]:
        last = None
        for r in rows:
            if last is None or r[t] - last >= least:
                last = r[t]
                yield {t: last}

    times = df.select(*keys, t).filter(F.col(t).isNotNull()).distinct()
    return streamed(times, keys, [t], keep, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in times.schema))
