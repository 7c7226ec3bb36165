"""Scores: A7-A14, A26-A29, W12, R15-R20, X26."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import scoring as s
from tidemark.registry import query
from tidemark.tables import UNITS, load, mapped, units

RANK = "CASE status WHEN 'PASS' THEN 0 WHEN 'PARTIAL' THEN 1 WHEN 'UNCERTAIN' THEN 2 WHEN 'FAIL' THEN 3 ELSE 4 END"
ALIGN = "CASE alignment WHEN 'none' THEN 0 WHEN 'weak' THEN 1 WHEN 'partial' THEN 2 WHEN 'strong' THEN 3 WHEN 'exact' THEN 4 ELSE -1 END"
RESOLVED = f"""rs AS (
  SELECT * EXCLUDE (status, rn), rn > 1 AS lost, CASE WHEN rn > 1 THEN 'NOT_APPLICABLE' ELSE status END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY video, grp ORDER BY {RANK}, -({ALIGN}), CASE WHEN ordinal <> 0 THEN ordinal ELSE 1000000 END, id, q, polarity, dimension, flag) AS rn FROM un))"""
SUMS = """CAST(sum(w2) AS BIGINT) AS tot,
    CAST(sum(CASE WHEN status IN ('PASS', 'PARTIAL', 'FAIL') THEN w2 ELSE 0 END) AS BIGINT) AS dec,
    CAST(sum(CASE status WHEN 'PASS' THEN 2 * w2 WHEN 'PARTIAL' THEN w2 ELSE 0 END) AS BIGINT) AS earned,
    count(*) AS n_units, max(CASE WHEN priority = 'critical' AND status = 'FAIL' THEN 1 ELSE 0 END) AS critical_fail"""
BANDED = """*, round_even(CAST(earned * 50.0 AS DOUBLE) / nullif(tot, 0), 0) AS pessimistic, round_even(CAST(earned * 50.0 AS DOUBLE) / nullif(dec, 0), 0) AS optimistic,
    coalesce(round_even(CAST(dec AS DOUBLE) / nullif(tot, 0), 4), 0.0) AS coverage"""


def _band(x: str) -> str:
    return f"CASE WHEN coalesce({x}, 0) >= 85 THEN 'APPROVED' WHEN coalesce({x}, 0) >= 70 THEN 'MINOR_REVISION' WHEN coalesce({x}, 0) >= 50 THEN 'NEEDS_MAJOR_REVISION' ELSE 'REJECTED' END"


BASIS = "CASE WHEN coverage >= 0.9 THEN optimistic ELSE pessimistic END"
SCORED = f"""WITH {UNITS}, {RESOLVED}, sm AS (SELECT video, {SUMS} FROM rs WHERE status <> 'NOT_APPLICABLE' GROUP BY video),
bd AS (SELECT {BANDED} FROM sm),
sc AS (SELECT *, CASE WHEN critical_fail = 1 AND {_band(BASIS)} IN ('APPROVED', 'MINOR_REVISION') THEN 'NEEDS_MAJOR_REVISION' ELSE {_band(BASIS)} END AS band,
  critical_fail = 1 AND {_band(BASIS)} IN ('APPROVED', 'MINOR_REVISION') AS floored,
  coverage < 0.9 OR pessimistic IS DISTINCT FROM optimistic AS lead_with_band FROM bd)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    return s.verdict(s.bands(s.sums(s.resolve_groups(units(spark, d), ["video"]), ["video"])))


@query("r17_score_by_order", f"{SCORED} SELECT * FROM sc")
def r17(spark: SparkSession, d: str) -> DataFrame:
    """Units of every order to resolved groups to a band a customer."""
    return scored(spark, d)


@query("w12_group_resolution", f"WITH {UNITS}, {RESOLVED} SELECT video, grp, id, status, lost FROM rs")
def w12(spark: SparkSession, d: str) -> DataFrame:
    return s.resolve_groups(units(spark, d), ["video"]).select("video", "grp", "id", "status", "lost")


@query("a7_weighted_band", f"WITH {UNITS}, sm AS (SELECT grp, {SUMS} FROM un WHERE status <> 'NOT_APPLICABLE' GROUP BY grp) SELECT {BANDED} FROM sm")
def a7(spark: SparkSession, d: str) -> DataFrame:
    """Bands of every order on its own, UNCERTAIN abstaining."""
    return s.bands(s.sums(units(spark, d), ["grp"]))


DIMS = "dm AS (SELECT 'd' || CAST(i AS VARCHAR) AS dimension, 1.0 + i AS weight FROM range(9) r(i))"


@query(
    "a8_dimension_breakdown",
    f"""WITH {UNITS}, {DIMS}, sm AS (SELECT video, dimension, {SUMS} FROM un WHERE status <> 'NOT_APPLICABLE' GROUP BY ALL),
    vd AS (SELECT * FROM (SELECT DISTINCT video FROM un) CROSS JOIN dm), bd AS (SELECT {BANDED} FROM sm)
    SELECT video, dimension, coalesce(n_units, 0) AS n_units, optimistic, pessimistic, coalesce(n_units, 0) < 2 AS thin,
      CASE WHEN coalesce(dec, 0) > 0 THEN round_even(weight / sum(CASE WHEN dec > 0 THEN weight ELSE 0 END) OVER (PARTITION BY video), 6) ELSE 0.0 END AS weight
    FROM vd LEFT JOIN bd USING (video, dimension)""",
)
def a8(spark: SparkSession, d: str) -> DataFrame:
    """Each dimension's band; weights renormalised over the dimensions with a decided unit; absent ones as zero rows."""
    u = units(spark, d)
    dims = spark.range(9).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("dimension"), (F.lit(1.0) + F.col("id")).alias("weight"))
    every = u.select("video").distinct().withColumn("dimension", F.explode(F.array(*(F.lit(f"d{i}") for i in range(9))))).join(F.broadcast(dims), "dimension")
    b = s.bands(s.sums(u, ["video", "dimension"]))
    j = every.join(b, ["video", "dimension"], "left")
    covered = F.coalesce(F.col("dec"), F.lit(0)) > 0
    total = F.sum(F.when(covered, F.col("weight")).otherwise(0.0)).over(Window.partitionBy("video"))
    n = F.coalesce("n_units", F.lit(0))
    return j.select("video", "dimension", n.alias("n_units"), "optimistic", "pessimistic", (n < 2).alias("thin"), F.when(covered, F.bround(F.col("weight") / total, 6)).otherwise(0.0).alias("weight"))


A9 = """g AS (SELECT video, count(*) AS n, CAST(sum(CASE WHEN status IN ('PASS','PARTIAL','FAIL') THEN 1 ELSE 0 END) AS BIGINT) AS n_decided,
    CAST(sum(CASE status WHEN 'PASS' THEN 2 WHEN 'PARTIAL' THEN 1 ELSE 0 END) AS BIGINT) AS points2, CAST(sum(w2) AS BIGINT) AS w2
  FROM un WHERE flag = 'A' AND status <> 'NOT_APPLICABLE' GROUP BY video HAVING count(*) >= 2),
t AS (SELECT *, CAST(greatest(1, least(n, greatest(3, ceil(n * 2 / 5)))) AS BIGINT) AS target FROM g),
r AS (SELECT *, points2 / (2.0::DOUBLE * n) AS r, target / CAST(n AS DOUBLE) AS t FROM t),
c AS (SELECT video, n, n_decided, points2, w2, target,
  round_even(CASE WHEN r >= t THEN 0.7::DOUBLE + 0.3::DOUBLE * least(1.0::DOUBLE, (r - t) / CASE WHEN t >= 1 THEN 1.0::DOUBLE ELSE 1 - t END) ELSE 0.7::DOUBLE * r / t END, 6) AS score FROM r)"""


@query("a9_talking_points", f"WITH {UNITS}, {A9} SELECT *, CASE WHEN n_decided = 0 THEN 'UNCERTAIN' WHEN score >= 0.7 THEN 'PASS' WHEN score > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM c")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return s.collapse_points(units(spark, d).filter("flag = 'A' and status <> 'NOT_APPLICABLE'"), ["video"])


@query("a10_scoring_units", f"WITH {UNITS} SELECT grp, max(w2) AS w2, count(*) AS n, CAST(sum(max(w2)) OVER () AS BIGINT) AS total FROM un GROUP BY grp")
def a10(spark: SparkSession, d: str) -> DataFrame:
    """A choice group is one unit with its greatest member's weight; total over all units."""
    g = units(spark, d).groupBy("grp").agg(F.max("w2").alias("w2"), F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("w2").cast("long").alias("total"))))


@query(
    "a11_status_mix",
    f"""WITH {UNITS} SELECT dimension, status, count(*) AS n, grouping_id(dimension, status) AS level,
    round_even(CAST(count(*) FILTER (status = 'UNCERTAIN') AS DOUBLE) / nullif(count(*) FILTER (status <> 'NOT_APPLICABLE'), 0), 6) AS uncertain_rate
    FROM un GROUP BY ROLLUP (dimension, status)""",
)
def a11(spark: SparkSession, d: str) -> DataFrame:
    """Counts by dimension and status with subtotals; the uncertain rate leaves out NOT_APPLICABLE."""
    rate = F.try_divide(F.count_if(F.col("status") == "UNCERTAIN").cast("double"), F.count_if(F.col("status") != "NOT_APPLICABLE"))
    return units(spark, d).rollup("dimension", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("level"), F.bround(rate, 6).alias("uncertain_rate"))


AW = "CASE alignment WHEN 'exact' THEN 100 WHEN 'strong' THEN 85 WHEN 'partial' THEN 55 WHEN 'weak' THEN 25 WHEN 'none' THEN 0 END"


@query("a12_mean_alignment", f"WITH {UNITS} SELECT video, round_even(CAST(sum({AW}) AS DOUBLE) / nullif(count({AW}), 0) / 100, 6) AS mean_alignment, count({AW}) AS n FROM un WHERE status <> 'NOT_APPLICABLE' GROUP BY video")
def a12(spark: SparkSession, d: str) -> DataFrame:
    """Mean alignment over judged, applicable rows; null if none is judged."""
    w = mapped("alignment", {k: round(v * 100) for k, v in s.ALIGNMENT_WEIGHT.items()})
    return units(spark, d).filter("status <> 'NOT_APPLICABLE'").groupBy("video").agg(F.bround(F.try_divide(F.sum(w).cast("double"), F.count(w)) / 100, 6).alias("mean_alignment"), F.count(w).alias("n"))


@query(
    "a13_share_normalise",
    """WITH c AS (SELECT user_id AS video, event_type AS angle, least(100.0, greatest(0.0, round(sum(value), 2))) AS pct FROM events GROUP BY ALL),
    t AS (SELECT *, sum(CAST(round(pct * 100) AS BIGINT)) OVER (PARTITION BY video) AS total FROM c)
    SELECT video, angle, round_even(round(pct * 100) * 100.0 / total, 1) AS pct, abs(total - 10000) > 200 AS rescaled FROM t WHERE total > 0""",
)
def a13(spark: SparkSession, d: str) -> DataFrame:
    """Shares clipped to 0..100 and rescaled to a sum of 100 a video; dropped if nothing is left."""
    c = load(spark, d, "events").groupBy(F.col("user_id").alias("video"), F.col("event_type").alias("angle")).agg(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round(F.sum("value"), 2))).alias("pct"))
    cents = F.round(F.col("pct") * 100)
    t = c.withColumn("total", F.sum(cents.cast("long")).over(Window.partitionBy("video"))).filter("total > 0")
    return t.select("video", "angle", F.bround(cents * 100.0 / F.col("total"), 1).alias("pct"), (F.abs(F.col("total") - 10000) > 200).alias("rescaled"))


@query(
    "a14_angle_distribution",
    """WITH c AS (SELECT user_id AS video, event_type AS angle, count(*) AS n FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY n DESC, angle) AS rn FROM c),
    dm AS (SELECT unnest(['click','error','purchase','signup','view','share']) AS angle)
    SELECT dm.angle, count(r.video) AS n_videos, count(*) FILTER (rn = 1) AS dominant_for, round_even(avg(n), 4) AS mean_n, count(r.video) = 0 AS unused
    FROM dm LEFT JOIN r USING (angle) GROUP BY dm.angle""",
)
def a14(spark: SparkSession, d: str) -> DataFrame:
    """For each named angle in how many videos it occurs and leads; names that never occur are kept."""
    c = load(spark, d, "events").groupBy(F.col("user_id").alias("video"), F.col("event_type").alias("angle")).agg(F.count("*").alias("n"))
    r = c.withColumn("rn", F.row_number().over(Window.partitionBy("video").orderBy(F.desc("n"), "angle")))
    per = r.groupBy("angle").agg(F.count("video").alias("n_videos"), F.count_if(F.col("rn") == 1).alias("dominant_for"), F.bround(F.avg("n"), 4).alias("mean_n"))
    names = spark.createDataFrame([(x,) for x in ("click", "error", "purchase", "signup", "view", "share")], "angle string")
    zero = F.lit(0).cast("long")
    return F.broadcast(names).join(per, "angle", "left").select("angle", F.coalesce("n_videos", zero).alias("n_videos"), F.coalesce("dominant_for", zero).alias("dominant_for"), "mean_n", F.col("n_videos").isNull().alias("unused"))


LEVELS = ["exact", "strong", "partial", "weak", "none"]


@query(
    "a26_alignment_surface",
    f"""WITH {UNITS}, g AS (SELECT dimension, level FROM (SELECT DISTINCT dimension FROM un) CROSS JOIN (SELECT unnest(['exact','strong','partial','weak','none']) AS level))
    SELECT g.dimension, level, CAST(coalesce(sum(w2), 0) AS BIGINT) AS w2 FROM g LEFT JOIN un ON un.dimension = g.dimension AND alignment = level GROUP BY ALL""",
)
def a26(spark: SparkSession, d: str) -> DataFrame:
    """Weight by dimension and level, as a dense grid."""
    wide = units(spark, d).groupBy("dimension").pivot("alignment", LEVELS).agg(F.sum("w2"))
    return wide.unpivot("dimension", LEVELS, "level", "w2").withColumn("w2", F.coalesce("w2", F.lit(0)).cast("long"))


@query(
    "a27_batch_matrix",
    f"""WITH {UNITS}, sm AS (SELECT grp % 50 AS run, dimension, {SUMS} FROM un WHERE status <> 'NOT_APPLICABLE' GROUP BY ALL), bd AS (SELECT {BANDED} FROM sm)
    SELECT run, max(optimistic) FILTER (dimension = 'd0') AS d0, max(optimistic) FILTER (dimension = 'd1') AS d1, max(optimistic) FILTER (dimension = 'd2') AS d2, count(*) AS n_dims
    FROM bd GROUP BY run HAVING count(*) >= 2""",
)
def a27(spark: SparkSession, d: str) -> DataFrame:
    """Sub-scores as a matrix of runs and dimensions, for runs with two dimensions or more."""
    b = s.bands(s.sums(units(spark, d).withColumn("run", F.col("grp") % 50), ["run", "dimension"]))
    n = b.groupBy("run").agg(F.count("*").alias("n_dims")).filter("n_dims >= 2")
    return b.groupBy("run").pivot("dimension", ["d0", "d1", "d2"]).agg(F.max("optimistic")).join(n, "run")


@query("a28_requirement_digest", f"WITH {UNITS} SELECT video, sha256(string_agg(concat_ws('|', CAST(id AS VARCHAR), priority, polarity), chr(10) ORDER BY concat_ws('|', CAST(id AS VARCHAR), priority, polarity))) AS digest FROM un GROUP BY video")
def a28(spark: SparkSession, d: str) -> DataFrame:
    """sha256 of a video's sorted requirement rows."""
    row = F.concat_ws("|", F.col("id").cast("string"), "priority", "polarity")
    return units(spark, d).groupBy("video").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("digest"))


@query("a29_menu_selections", f"WITH {UNITS}, {RESOLVED} SELECT video, string_agg(grp || '=' || id, ',' ORDER BY grp) AS chosen FROM rs WHERE NOT lost AND status = 'PASS' GROUP BY video")
def a29(spark: SparkSession, d: str) -> DataFrame:
    """The chosen option of each group, as one text a video."""
    r = s.resolve_groups(units(spark, d), ["video"]).filter("not lost and status = 'PASS'")
    pairs = F.array_sort(F.collect_list(F.struct("grp", "id")))
    return r.groupBy("video").agg(F.array_join(F.transform(pairs, lambda x: F.concat_ws("=", x["grp"].cast("string"), x["id"].cast("string"))), ",").alias("chosen"))


@query("r15_priority_weights", f"WITH {UNITS} SELECT priority, status, count(*) AS n, CAST(sum(w2) AS BIGINT) AS w2, CAST(sum(CASE status WHEN 'PASS' THEN 2 * w2 WHEN 'PARTIAL' THEN w2 ELSE 0 END) AS BIGINT) AS earned FROM un GROUP BY CUBE (priority, status)")
def r15(spark: SparkSession, d: str) -> DataFrame:
    """Weights and points by priority and status, with all subtotals."""
    earned = F.when(F.col("status") == "PASS", 2 * F.col("w2")).when(F.col("status") == "PARTIAL", F.col("w2")).otherwise(0)
    return units(spark, d).cube("priority", "status").agg(F.count("*").alias("n"), F.sum("w2").cast("long").alias("w2"), F.sum(earned).cast("long").alias("earned"))


@query(
    "r16_dimension_resolve",
    """SELECT p_partkey, CASE WHEN p_type NOT IN ('SMALL', 'LARGE') THEN lower(p_type) WHEN regexp_matches(p_name, 'ring|bolt') THEN 'fastening' WHEN regexp_matches(p_name, 'widget|gear') THEN 'mechanics' ELSE 'general' END AS dimension FROM part""",
)
def r16(spark: SparkSession, d: str) -> DataFrame:
    """A declared type wins, then words of the name, then the default."""
    dim = F.when(~F.col("p_type").isin("SMALL", "LARGE"), F.lower("p_type")).when(F.col("p_name").rlike("ring|bolt"), "fastening").when(F.col("p_name").rlike("widget|gear"), "mechanics").otherwise("general")
    return load(spark, d, "part").select("p_partkey", dim.alias("dimension"))


@query("r18_relevance_gate", f"{SCORED} SELECT video, CASE WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'OFF_BRIEF' ELSE band END AS band, CASE WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN false ELSE floored END AS floored FROM sc LEFT JOIN customer ON c_custkey = video")
def r18(spark: SparkSession, d: str) -> DataFrame:
    """An off-topic video is OFF_BRIEF whatever it scored; an unjudged one passes the gate."""
    off = F.coalesce(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE"), F.lit(False))
    j = scored(spark, d).join(load(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("video") == F.col("c_custkey"), "left")
    return j.select("video", F.when(off, "OFF_BRIEF").otherwise(F.col("band")).alias("band"), F.when(off, False).otherwise(F.col("floored")).alias("floored"))


@query(
    "r19_literal_rescore",
    f"""{SCORED}, lit AS (SELECT video, {SUMS} FROM rs WHERE status <> 'NOT_APPLICABLE' AND polarity = 'required' AND alignment IS NOT NULL GROUP BY video), lb AS (SELECT {BANDED} FROM lit)
    SELECT sc.video, sc.optimistic AS headline, lb.optimistic AS literal, sc.optimistic - lb.optimistic AS lift FROM sc LEFT JOIN lb USING (video)""",
)
def r19(spark: SparkSession, d: str) -> DataFrame:
    """The headline beside a score over judged required units alone."""
    r = s.resolve_groups(units(spark, d), ["video"])
    full = s.bands(s.sums(r, ["video"])).select("video", F.col("optimistic").alias("headline"))
    lit = s.bands(s.sums(r.filter("polarity = 'required' and alignment is not null"), ["video"])).select("video", F.col("optimistic").alias("literal"))
    return full.join(lit, "video", "left").withColumn("lift", F.col("headline") - F.col("literal"))


@query(
    "r20_contradictions",
    f"""{SCORED}, mn AS (SELECT video, CAST(sum({AW}) AS DOUBLE) / nullif(count({AW}), 0) / 100 AS m FROM un WHERE status <> 'NOT_APPLICABLE' GROUP BY video)
    SELECT video, unnest(list_filter([CASE WHEN optimistic >= 85 AND m < 0.4 THEN 'HIGH_SCORE_LOW_STANDING' END, CASE WHEN optimistic < 50 AND m > 0.6 THEN 'LOW_SCORE_HIGH_STANDING' END,
      CASE WHEN critical_fail = 1 AND optimistic >= 70 THEN 'CRITICAL_FAIL_HIGH_SCORE' END, CASE WHEN coverage < 0.5 THEN 'MOSTLY_UNDECIDED' END], lambda x: x IS NOT NULL)) AS code FROM sc JOIN mn USING (video)""",
)
def r20(spark: SparkSession, d: str) -> DataFrame:
    """Where score and alignment disagree, one row a code."""
    w = mapped("alignment", {k: round(v * 100) for k, v in s.ALIGNMENT_WEIGHT.items()})
    m = units(spark, d).filter("status <> 'NOT_APPLICABLE'").groupBy("video").agg((F.try_divide(F.sum(w).cast("double"), F.count(w)) / 100).alias("m"))
    o = F.col("optimistic")
    codes = F.array_compact(F.array(F.when((o >= 85) & (F.col("m") < 0.4), "HIGH_SCORE_LOW_STANDING"), F.when((o < 50) & (F.col("m") > 0.6), "LOW_SCORE_HIGH_STANDING"), F.when((F.col("critical_fail") == 1) & (o >= 70), "CRITICAL_FAIL_HIGH_SCORE"), F.when(F.col("coverage") < 0.5, "MOSTLY_UNDECIDED")))
    return scored(spark, d).join(m, "video").select("video", F.explode(codes).alias("code"))


@query("x26_alignment_rank", f"WITH {UNITS} SELECT id, {ALIGN} AS rank, round_even(coalesce({AW}, 0) / 100.0::DOUBLE, 2) AS weight FROM un")
def x26(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).select("id", s.alignment_rank().alias("rank"), F.bround(F.coalesce(mapped("alignment", {k: round(v * 100) for k, v in s.ALIGNMENT_WEIGHT.items()}), F.lit(0)) / 100.0, 2).alias("weight"))


@query(
    "a20_group_of_one",
    f"WITH {UNITS} SELECT id, CASE WHEN count(*) OVER (PARTITION BY grp, status) < 2 THEN NULL ELSE grp END AS grp FROM un",
)
def a20(spark: SparkSession, d: str) -> DataFrame:
    """Members of a group of one lose their group."""
    n = F.count("*").over(Window.partitionBy("grp", "status"))
    return units(spark, d).select("id", F.when(n >= 2, F.col("grp")).alias("grp"))


@query(
    "a25_point_coverage",
    f"WITH {UNITS} SELECT video, count(*) FILTER (status IN ('PASS', 'PARTIAL')) AS covered, count(*) AS total, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (status IN ('PASS', 'PARTIAL')), '') AS ids FROM un WHERE flag = 'A' GROUP BY video",
)
def a25(spark: SparkSession, d: str) -> DataFrame:
    on = F.col("status").isin("PASS", "PARTIAL")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(on, F.col("id")))), lambda x: x.cast("string")), ",")
    return units(spark, d).filter("flag = 'A'").groupBy("video").agg(F.count_if(on).alias("covered"), F.count("*").alias("total"), ids.alias("ids"))


@query("k12_display_sort", f"WITH {UNITS} SELECT video, string_agg(CAST(id AS VARCHAR), ',' ORDER BY CASE status WHEN 'FAIL' THEN 0 WHEN 'PARTIAL' THEN 1 WHEN 'UNCERTAIN' THEN 2 WHEN 'PASS' THEN 3 ELSE 4 END, id) AS ids FROM un GROUP BY video")
def k12(spark: SparkSession, d: str) -> DataFrame:
    """Ids in display order: FAIL, PARTIAL, UNCERTAIN, PASS, others."""
    rank = mapped("status", {"FAIL": 0, "PARTIAL": 1, "UNCERTAIN": 2, "PASS": 3}, 4)
    return units(spark, d).groupBy("video").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "id"))), lambda x: x["id"].cast("string")), ",").alias("ids"))


@query(
    "j8_verdict_requirement",
    """SELECT l_orderkey, l_linenumber, o_orderpriority, o_orderkey IS NULL AS unmatched FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l_orderkey = o_orderkey""",
)
def j8(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts keep their row without a requirement."""
    o = load(spark, d, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderpriority")
    j = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.select("l_orderkey", "l_linenumber", "o_orderpriority", F.col("o_orderkey").isNull().alias("unmatched"))


@query("so5_partition_by_predicate", f"WITH {UNITS} SELECT CASE WHEN polarity = 'forbidden' THEN 'safety' WHEN alignment IS NULL THEN 'not_in_brief' ELSE 'achievement' END AS part, count(*) AS n, CAST(sum(w2) AS BIGINT) AS w2 FROM un GROUP BY ALL")
def so5(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(F.col("polarity") == "forbidden", "safety").when(F.col("alignment").isNull(), "not_in_brief").otherwise("achievement")
    return units(spark, d).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("w2").cast("long").alias("w2"))


@query("r29_job_rollup", f"WITH {UNITS} SELECT video, CASE WHEN count(*) FILTER (status IN ('PASS', 'PARTIAL')) = count(*) THEN 'succeeded' WHEN count(*) FILTER (status IN ('PASS', 'PARTIAL')) > 0 THEN 'partial' ELSE 'failed' END AS job FROM un GROUP BY video")
def r29(spark: SparkSession, d: str) -> DataFrame:
    ok = F.count_if(F.col("status").isin("PASS", "PARTIAL"))
    return units(spark, d).groupBy("video").agg(F.when(ok == F.count("*"), "succeeded").when(ok > 0, "partial").otherwise("failed").alias("job"))
