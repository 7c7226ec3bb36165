"""Timelines: A1-A6, A16, A17, A23, J1, J2, J6, J7, J20, P1, P2, P9-P12, W1, W5, W7, W8, W10, W11, R1, R2, R5, R6, SO1, X1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import intervals as iv
from tidemark.registry import query
from tidemark.tables import TIMELINE, load, timeline

FLAG = "CASE WHEN t0 - max(t1) OVER (PARTITION BY {k} ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END"


def isl(name: str, k: str, gap: int = 0, src: str = "tl") -> str:
    """CTEs for the islands of a table."""
    return f"""{name}_f AS (SELECT *, {FLAG.format(k=k, gap=gap)} AS nw FROM {src}),
    {name} AS (SELECT *, sum(nw) OVER (PARTITION BY {k} ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS island FROM {name}_f)"""


@query("a1_interval_union", f"WITH {TIMELINE}, {isl('i', 'video, modality')} SELECT video, modality, CAST(island AS BIGINT) AS island, min(t0) AS t0, max(t1) AS t1, count(*) AS n FROM i GROUP BY ALL")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return iv.union(timeline(spark, d), ["video", "modality"], "t0", "t1")


@query("a2_union_length", f"WITH {TIMELINE}, {isl('i', 'video')}, u AS (SELECT video, island, max(t1) - min(t0) AS len FROM i GROUP BY ALL) SELECT video, CAST(sum(len) AS BIGINT) AS covered, count(*) AS n_islands FROM u GROUP BY video")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return iv.union_length(timeline(spark, d), ["video"], "t0", "t1")


@query(
    "a3_derived_aggregates",
    f"""WITH {TIMELINE}, {isl('i', 'video')}, u AS (SELECT video, island, max(t1) - min(t0) AS len FROM i GROUP BY ALL), l AS (SELECT video, CAST(sum(len) AS BIGINT) AS covered, max(len) AS longest FROM u GROUP BY video)
    SELECT tl.video, min(t0) AS first_seen, max(t1) AS last_seen, arg_min(k, (t0, event_id)) AS first_k, any_value(covered) AS covered, any_value(longest) AS longest,
      count(*) FILTER (modality = 'click') AS click, count(*) FILTER (modality = 'error') AS error, count(*) FILTER (modality = 'purchase') AS purchase, count(*) FILTER (modality = 'signup') AS signup, count(*) FILTER (modality = 'view') AS view
    FROM tl JOIN l ON l.video = tl.video GROUP BY tl.video""",
)
def a3(spark: SparkSession, d: str) -> DataFrame:
    """First and last seen, covered time, longest island, counts by modality with zeros."""
    t = timeline(spark, d)
    u = iv.union(t, ["video"], "t0", "t1").groupBy("video").agg(F.sum(F.col("t1") - F.col("t0")).alias("covered"), F.max(F.col("t1") - F.col("t0")).alias("longest"))
    kinds = [F.count_if(F.col("modality") == m).alias(m) for m in ("click", "error", "purchase", "signup", "view")]
    g = t.groupBy("video").agg(F.min("t0").alias("first_seen"), F.max("t1").alias("last_seen"), F.min_by("k", F.struct("t0", "event_id")).alias("first_k"), *kinds)
    return g.join(u, "video")


HOUR12 = 43_200_000


@query(
    "a4_coverage_map",
    f"""WITH {TIMELINE}, d AS (SELECT video, max(t1) AS dur, greatest(1, CAST(ceil(max(t1) / {HOUR12}) AS BIGINT)) AS n FROM tl GROUP BY video),
    b AS (SELECT DISTINCT video, unnest(range(t0 // {HOUR12}, least(t1 // {HOUR12}, n - 1) + 1)) AS bin FROM tl JOIN d USING (video)),
    sp AS (SELECT video, unnest(range(n)) AS bin, n, dur FROM d),
    fr AS (SELECT sp.video, sp.bin, n, dur, sp.bin - row_number() OVER (PARTITION BY sp.video ORDER BY sp.bin) AS grp FROM sp LEFT JOIN b ON b.video = sp.video AND b.bin = sp.bin WHERE b.bin IS NULL)
    SELECT video, min(bin) * {HOUR12} AS gap_start, CASE WHEN max(bin) + 1 = any_value(n) THEN any_value(dur) ELSE (max(bin) + 1) * {HOUR12} END AS gap_end FROM fr GROUP BY video, grp""",
)
def a4(spark: SparkSession, d: str) -> DataFrame:
    """Runs of 12-hour bins without a record."""
    t = timeline(spark, d)
    return iv.coverage_bins(t.join(t.groupBy("video").agg(F.max("t1").alias("dur")), "video"), ["video"], "t0", "t1", "dur", HOUR12)


@query(
    "a5_modality_health",
    f"""WITH {TIMELINE}, {isl('i', 'video, modality')}, u AS (SELECT video, modality, island, max(t1) - min(t0) AS len, count(*) AS c FROM i GROUP BY ALL),
    g AS (SELECT video, modality, CAST(sum(len) AS BIGINT) AS covered, CAST(sum(c) AS BIGINT) AS n FROM u GROUP BY ALL), d AS (SELECT video, max(t1) AS dur FROM tl GROUP BY video)
    SELECT video, modality, n, round_even(CAST(covered AS DOUBLE) / dur, 6) AS ratio,
      CASE WHEN covered <= 0.01 * dur AND n <= 3 THEN 'absent' WHEN covered < 0.05 * dur THEN 'degraded' WHEN n < 15 THEN 'thin' ELSE 'ok' END AS health FROM g JOIN d USING (video)""",
)
def a5(spark: SparkSession, d: str) -> DataFrame:
    """Absent, degraded, thin or ok by covered share and count; absent is tested first."""
    return health(timeline(spark, d))


def health(t: DataFrame) -> DataFrame:
    u = iv.union(t, ["video", "modality"], "t0", "t1").groupBy("video", "modality").agg(F.sum(F.col("t1") - F.col("t0")).alias("covered"), F.sum("n").alias("n"))
    j = u.join(t.groupBy("video").agg(F.max("t1").alias("dur")), "video")
    h = F.when((F.col("covered") <= 0.01 * F.col("dur")) & (F.col("n") <= 3), "absent").when(F.col("covered") < 0.05 * F.col("dur"), "degraded").when(F.col("n") < 15, "thin").otherwise("ok")
    return j.select("video", "modality", "n", F.bround(F.col("covered").cast("double") / F.col("dur"), 6).alias("ratio"), h.alias("health"))


MODES = [("clicks", ["click"]), ("buys_or_views", ["purchase", "view"]), ("any", ["click", "purchase", "signup", "view"])]


@query(
    "a6_can_fail",
    f"""WITH {TIMELINE}, {isl('i', 'video, modality')}, u AS (SELECT video, modality, island, max(t1) - min(t0) AS len FROM i GROUP BY ALL),
    g AS (SELECT video, modality, sum(len) AS covered FROM u GROUP BY ALL), d AS (SELECT video, max(t1) AS dur FROM tl GROUP BY video),
    ok AS (SELECT video, modality FROM g JOIN d USING (video) WHERE covered >= 0.05 * dur),
    md AS (SELECT * FROM (VALUES ('clicks', 'click'), ('buys_or_views', 'purchase'), ('buys_or_views', 'view'), ('any', 'click'), ('any', 'purchase'), ('any', 'signup'), ('any', 'view')) v(mode, modality))
    SELECT d.video, md.mode, bool_and(ok.video IS NOT NULL) AS can_fail FROM d CROSS JOIN md LEFT JOIN ok ON ok.video = d.video AND ok.modality = md.modality GROUP BY ALL""",
)
def a6(spark: SparkSession, d: str) -> DataFrame:
    """A mode may fail a requirement only if all its modalities are sound."""
    t = timeline(spark, d)
    u = iv.union_length(t, ["video", "modality"], "t0", "t1")
    dur = t.groupBy("video").agg(F.max("t1").alias("dur"))
    sound = u.join(dur, "video").filter(F.col("covered") >= 0.05 * F.col("dur")).groupBy("video").agg(F.collect_set("modality").alias("sound"))
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), F.array(*map(F.lit, parts)).alias("needs")) for m, parts in MODES))
    j = dur.select("video").join(sound, "video", "left").withColumn("m", F.explode(modes))
    return j.select("video", "m.mode", (F.size(F.array_except("m.needs", F.coalesce("sound", F.array().cast("array<string>")))) == 0).alias("can_fail"))


@query("a16_frame_gaps", f"WITH {TIMELINE}, g AS (SELECT video, t0 - lag(t0) OVER (PARTITION BY video ORDER BY t0, event_id) AS gap FROM tl) SELECT video, median(gap) AS median_gap, max(gap) AS widest, least(greatest(max(gap) * 3 // 2, 350), 86400000) AS max_gap FROM g WHERE gap IS NOT NULL GROUP BY video")
def a16(spark: SparkSession, d: str) -> DataFrame:
    g = timeline(spark, d).withColumn("gap", F.col("t0") - F.lag("t0").over(Window.partitionBy("video").orderBy("t0", "event_id"))).filter("gap is not null")
    return g.groupBy("video").agg(F.median("gap").alias("median_gap"), F.max("gap").alias("widest"), F.least(F.greatest(F.expr("max(gap) * 3 div 2"), F.lit(350)), F.lit(86_400_000)).alias("max_gap"))


@query("a17_robust_threshold", "WITH m AS (SELECT user_id, median(value) AS med FROM events GROUP BY 1), a AS (SELECT e.user_id, med, median(abs(value - med)) AS mad FROM events e JOIN m ON m.user_id = e.user_id GROUP BY ALL) SELECT user_id, round_even(CASE WHEN mad = 0 THEN med + 6 ELSE greatest(med + 4 * 1.4826 * mad, 6) END, 4) AS threshold FROM a")
def a17(spark: SparkSession, d: str) -> DataFrame:
    """Median + 4 * 1.4826 * MAD with a floor, a fixed step where the MAD is 0."""
    e = load(spark, d, "events").select("user_id", "value")
    m = e.groupBy("user_id").agg(F.median("value").alias("med"))
    a = e.join(m, "user_id").groupBy("user_id", "med").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    return a.select("user_id", F.bround(F.when(F.col("mad") == 0, F.col("med") + 6).otherwise(F.greatest(F.col("med") + 4 * 1.4826 * F.col("mad"), F.lit(6.0))), 4).alias("threshold"))


@query("a23_manifest_stats", f"WITH {TIMELINE}, g AS (SELECT *, t0 - lag(t0) OVER (PARTITION BY video ORDER BY t0, event_id) AS gap FROM tl) SELECT video, count(*) AS n, count(DISTINCT modality) AS kinds, max(gap) AS max_gap, round_even(avg(gap), 3) AS mean_gap FROM g GROUP BY video")
def a23(spark: SparkSession, d: str) -> DataFrame:
    g = timeline(spark, d).withColumn("gap", F.col("t0") - F.lag("t0").over(Window.partitionBy("video").orderBy("t0", "event_id")))
    return g.groupBy("video").agg(F.count("*").alias("n"), F.count_distinct("modality").alias("kinds"), F.max("gap").alias("max_gap"), F.bround(F.avg("gap"), 3).alias("mean_gap"))


@query(
    "j1_overlay_link",
    f"WITH {TIMELINE} SELECT l.video, l.event_id AS a, r.event_id AS b, greatest(l.t0, r.t0) - least(l.t1, r.t1) AS gap FROM tl l JOIN tl r ON l.video = r.video AND l.modality = 'click' AND r.modality = 'view' AND greatest(l.t0, r.t0) - least(l.t1, r.t1) <= 600000",
)
def j1(spark: SparkSession, d: str) -> DataFrame:
    """Clicks linked to views at most ten minutes away, as an equi-join on bins."""
    t = timeline(spark, d)
    l = t.filter("modality = 'click'").select("video", F.col("event_id").alias("a"), F.col("t0").alias("a0"), F.col("t1").alias("a1"))
    r = t.filter("modality = 'view'").select("video", F.col("event_id").alias("b"), F.col("t0").alias("b0"), F.col("t1").alias("b1"))
    return iv.overlap_join(l, r, ["video"], ("a0", "a1"), ("b0", "b1"), slack=600_000).select("video", "a", "b", (F.greatest("a0", "b0") - F.least("a1", "b1")).alias("gap"))


REQ = "rq AS (SELECT r AS req, r * 86400000 AS lo, r * 86400000 + 43200000 AS hi, CASE WHEN r % 2 = 0 THEN 'click' ELSE 'view' END AS mode FROM range(10) x(r))"


def requirements(spark: SparkSession) -> DataFrame:
    """Ten windows of half a day with the modality that may answer them."""
    r = spark.range(10).withColumnRenamed("id", "req")
    return r.select("req", (F.col("req") * 86_400_000).alias("lo"), (F.col("req") * 86_400_000 + 43_200_000).alias("hi"), F.when(F.col("req") % 2 == 0, "click").otherwise("view").alias("mode"))


@query("j2_candidates", f"WITH {TIMELINE}, {REQ} SELECT req, video, event_id FROM rq JOIN tl ON modality = mode AND t0 - 300000 - 300000 <= hi AND t1 + 300000 + 300000 >= lo")
def j2(spark: SparkSession, d: str) -> DataFrame:
    """Records that may answer a requirement: its mode, its window; the tolerance counts twice."""
    t = timeline(spark, d)
    return t.join(F.broadcast(requirements(spark)), (F.col("mode") == F.col("modality")) & iv.within(F.col("t0"), F.col("t1"), F.col("lo"), F.col("hi"), 300_000, 300_000)).select("req", "video", "event_id")


@query("j6_frame_snap", f"WITH {TIMELINE}, p AS (SELECT event_id, video, t0 FROM tl WHERE modality = 'error'), g AS (SELECT DISTINCT video, t0 AS g FROM tl WHERE modality = 'view') SELECT event_id, video, t0, (SELECT arg_min(g, (abs(g - p.t0), g)) FROM g WHERE g.video = p.video) AS g FROM p")
def j6(spark: SparkSession, d: str) -> DataFrame:
    """The nearest view to each error, the earlier on a tie."""
    t = timeline(spark, d)
    return iv.nearest_join(t.filter("modality = 'error'").select("event_id", "video", "t0"), t.filter("modality = 'view'").select("video", F.col("t0").alias("g")).distinct(), ["video"], "t0", "g")


@query("j7_index_range", f"WITH {TIMELINE}, f AS (SELECT video, t0, row_number() OVER (PARTITION BY video ORDER BY t0, event_id) - 1 AS idx FROM tl), e AS (SELECT event_id, user_id AS video, CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS a FROM events WHERE event_type = 'signup') SELECT event_id, x.t0 AS start_t, y.t0 AS end_t FROM e LEFT JOIN f x ON x.video = e.video AND x.idx = a LEFT JOIN f y ON y.video = e.video AND y.idx = a + 3")
def j7(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of frame numbers to times, by two equi-joins."""
    t = timeline(spark, d)
    f = t.select("video", "t0", (F.row_number().over(Window.partitionBy("video").orderBy("t0", "event_id")) - 1).alias("idx"))
    e = t.filter("modality = 'signup'").select("event_id", "video", (F.col("k") % 20).alias("a"))
    x, y = f.select("video", F.col("idx").alias("a"), F.col("t0").alias("start_t")), f.select("video", (F.col("idx") - 3).alias("a"), F.col("t0").alias("end_t"))
    return e.join(x, ["video", "a"], "left").join(y, ["video", "a"], "left").select("event_id", "start_t", "end_t")


@query(
    "j20_gap_window",
    f"""WITH {TIMELINE}, {REQ}, {isl('i', 'video')}, u AS (SELECT video, island, min(t0) AS a, max(t1) AS b FROM i GROUP BY ALL), g AS (SELECT video, b AS g0, lead(a) OVER (PARTITION BY video ORDER BY island) AS g1 FROM u)
    SELECT video, req, CAST(sum(greatest(0, least(g1, hi) - greatest(g0, lo))) AS BIGINT) AS uncovered FROM g JOIN rq ON g0 <= hi AND g1 >= lo WHERE g1 IS NOT NULL GROUP BY ALL""",
)
def j20(spark: SparkSession, d: str) -> DataFrame:
    """Uncovered time within each window."""
    g = iv.gaps(timeline(spark, d), ["video"], "t0", "t1")
    j = g.join(F.broadcast(requirements(spark)), (F.col("t0") <= F.col("hi")) & (F.col("t1") >= F.col("lo")))
    return j.groupBy("video", "req").agg(F.sum(F.greatest(F.lit(0), F.least("t1", "hi") - F.greatest("t0", "lo"))).alias("uncovered"))


@query(
    "p1_normalise",
    f"""WITH {TIMELINE}, s AS (SELECT *, t0 - (k % 5) * 100000 AS s0, CASE WHEN k % 7 = 0 THEN t0 - 5000 ELSE t1 END AS s1 FROM tl)
    SELECT event_id, video, CASE WHEN modality IN ('click', 'view', 'purchase') THEN modality ELSE 'other' END AS type, least(greatest(s0, 0), greatest(s1, 0)) AS t0, greatest(greatest(s0, 0), greatest(s1, 0)) AS t1,
      round_even(least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 100)), 4) AS confidence, 'ev_' || substr(sha256(concat_ws('|', CAST(video AS VARCHAR), modality, CAST(t0 AS VARCHAR))), 1, 10) AS rid FROM s""",
)
def p1(spark: SparkSession, d: str) -> DataFrame:
    """One schema for every modality: clip, swap if the end comes first, closed type domain, content id."""
    s = timeline(spark, d).withColumns({"s0": F.greatest(F.col("t0") - (F.col("k") % 5) * 100_000, F.lit(0)), "s1": F.greatest(F.when(F.col("k") % 7 == 0, F.col("t0") - 5000).otherwise(F.col("t1")), F.lit(0))})
    rid = F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws("|", F.col("video").cast("string"), "modality", F.col("t0").cast("string")), 256), 1, 10))
    return s.select("event_id", "video", F.when(F.col("modality").isin("click", "view", "purchase"), F.col("modality")).otherwise("other").alias("type"), F.least("s0", "s1").alias("t0"), F.greatest("s0", "s1").alias("t1"), F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)), 4).alias("confidence"), rid.alias("rid"))


@query("p9_window_tolerance", f"WITH {TIMELINE} SELECT event_id, t0 - coalesce(nullif(k % 4 * 1000, 0), 5000) - 60000 <= 172800000 AND t1 + coalesce(nullif(k % 3 * 1000, 0), 5000) + 60000 >= 86400000 AS inside FROM tl")
def p9(spark: SparkSession, d: str) -> DataFrame:
    """Overlap with the second day; a tolerance of 0 counts as missing."""
    tol = lambda n: F.coalesce(F.nullif(F.col("k") % n * 1000, F.lit(0)), F.lit(5000))
    return timeline(spark, d).select("event_id", ((F.col("t0") - tol(4) - 60_000 <= 172_800_000) & (F.col("t1") + tol(3) + 60_000 >= 86_400_000)).alias("inside"))


@query("p10_mode_admissible", f"WITH {TIMELINE}, m AS (SELECT * FROM (VALUES ('click', 'touch'), ('click', 'any'), ('view', 'sight'), ('view', 'any'), ('purchase', 'any')) v(modality, mode)) SELECT event_id, mode FROM tl JOIN m USING (modality)")
def p10(spark: SparkSession, d: str) -> DataFrame:
    m = spark.createDataFrame([("click", "touch"), ("click", "any"), ("view", "sight"), ("view", "any"), ("purchase", "any")], "modality string, mode string")
    return timeline(spark, d).join(F.broadcast(m), "modality").select("event_id", "mode")


@query("p11_window_access", f"WITH {TIMELINE} SELECT video, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY t0, event_id) AS ids FROM tl WHERE modality = 'click' AND t0 <= 864000000 AND t1 >= 432000000 GROUP BY video")
def p11(spark: SparkSession, d: str) -> DataFrame:
    """Clicks of days 5 to 10 in order of start."""
    t = timeline(spark, d).filter((F.col("modality") == "click") & iv.within(F.col("t0"), F.col("t1"), F.lit(432_000_000), F.lit(864_000_000)))
    return t.groupBy("video").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t0", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@query(
    "w1_adjacent_merge",
    f"""WITH {TIMELINE}, {isl('i', 'video, modality', 3600000)}
    SELECT video, modality, CAST(island AS BIGINT) AS island, arg_min(event_id, (t0, t1, event_id)) AS survivor, min(t0) AS t0, max(t1) AS t1, max(value) AS confidence, count(*) - 1 AS absorbed, arg_max(k, (t0, t1, event_id)) AS end_k FROM i GROUP BY ALL""",
)
def w1(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours at most an hour apart merge; the first row's id survives, the end's data come from the last absorbed."""
    i = iv.islands(timeline(spark, d), ["video", "modality"], "t0", "t1", 3_600_000)
    o = F.struct("t0", "t1", "event_id")
    return i.groupBy("video", "modality", "island").agg(F.min_by("event_id", o).alias("survivor"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.max("value").alias("confidence"), (F.count("*") - 1).alias("absorbed"), F.max_by("k", o).alias("end_k"))


@query(
    "w5_min_separation",
    f"""WITH RECURSIVE {TIMELINE}, s AS (SELECT DISTINCT video, t0 FROM tl), r AS (
      SELECT video, min(t0) AS t0 FROM s GROUP BY video UNION ALL
      SELECT r.video, (SELECT min(s.t0) FROM s WHERE s.video = r.video AND s.t0 >= r.t0 + 86400000) FROM r WHERE r.t0 IS NOT NULL
    ) SELECT video, t0 FROM r WHERE t0 IS NOT NULL""",
)
def w5(spark: SparkSession, d: str) -> DataFrame:
    """Starts kept greedily a day apart."""
    return iv.separated(timeline(spark, d), ["video"], "t0", 86_400_000)


@query(
    "w7_sampling_tolerance",
    f"""WITH {TIMELINE}, g AS (SELECT DISTINCT video, t0 FROM tl), n AS (SELECT video, t0, t0 - lag(t0) OVER w AS b, lead(t0) OVER w - t0 AS a FROM g WINDOW w AS (PARTITION BY video ORDER BY t0))
    SELECT video, t0, least(greatest(coalesce(greatest(b, a), 5000), 50), 36000000) AS tolerance FROM n""",
)
def w7(spark: SparkSession, d: str) -> DataFrame:
    """The wider of the gaps to the nearest distinct neighbours, clamped; alone: the default."""
    w = Window.partitionBy("video").orderBy("t0")
    n = timeline(spark, d).select("video", "t0").distinct().withColumns({"b": F.col("t0") - F.lag("t0").over(w), "a": F.lead("t0").over(w) - F.col("t0")})
    return n.select("video", "t0", F.least(F.greatest(F.coalesce(F.greatest("b", "a"), F.lit(5000)), F.lit(50)), F.lit(36_000_000)).alias("tolerance"))


@query("w8_id_suffix", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) > 1 THEN k || '_' || row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) ELSE k END AS rid FROM (SELECT *, 'e' || json_extract_string(props, '$.k') AS k FROM events)")
def w8(spark: SparkSession, d: str) -> DataFrame:
    """The second and later uses of an id in a video get a suffix."""
    e = load(spark, d, "events").withColumn("k", F.concat(F.lit("e"), F.get_json_object("props", "$.k")))
    n = F.row_number().over(Window.partitionBy("user_id", "k").orderBy("ts", "event_id"))
    return e.select("event_id", F.when(n > 1, F.concat_ws("_", "k", n.cast("string"))).otherwise(F.col("k")).alias("rid"))


@query(
    "w11_speech_segments",
    f"""WITH {TIMELINE}, f AS (SELECT *, CASE WHEN t0 - lag(t1) OVER w > 7200000 OR coalesce(lag(k % 10 = 0) OVER w, true) THEN 1 ELSE 0 END AS nw FROM tl WINDOW w AS (PARTITION BY video ORDER BY t0, event_id)),
    i AS (SELECT *, sum(nw) OVER (PARTITION BY video ORDER BY t0, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f),
    s AS (SELECT *, (row_number() OVER (PARTITION BY video, island ORDER BY t0, event_id) - 1) // 4 AS part FROM i)
    SELECT video, CAST(island AS BIGINT) AS island, part, min(t0) AS t0, max(t1) AS t1, count(*) AS n FROM s GROUP BY ALL""",
)
def w11(spark: SparkSession, d: str) -> DataFrame:
    """A new segment after a silence, after a row that ends a sentence, or when four rows are in it."""
    w = Window.partitionBy("video").orderBy("t0", "event_id")
    new = (F.col("t0") - F.lag("t1").over(w) > 7_200_000) | F.coalesce(F.lag(F.col("k") % 10 == 0).over(w), F.lit(True))
    i = timeline(spark, d).withColumn("nw", new.cast("int")).withColumn("nw", F.coalesce("nw", F.lit(0)))
    i = i.withColumn("island", F.sum("nw").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    i = i.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("video", "island").orderBy("t0", "event_id")) - 1) / 4))
    return i.groupBy("video", "island", "part").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count("*").alias("n"))


@query("r1_time_windows", f"WITH {TIMELINE}, d AS (SELECT video, max(t1) AS dur FROM tl GROUP BY video) SELECT video, CASE WHEN video % 3 = 0 THEN 0 WHEN video % 3 = 1 THEN dur - 3600000 ELSE 0 END AS lo, CASE WHEN video % 3 = 0 THEN least(86400000, dur) ELSE dur END AS hi, video % 3 = 2 AS unbounded FROM d")
def r1(spark: SparkSession, d: str) -> DataFrame:
    """A deadline gives [0, d], an expression `duration - 3600000` its end, nothing the whole video."""
    from tidemark.functions.expressions import column_of

    m = F.col("video") % 3
    t = timeline(spark, d).groupBy("video").agg(F.max("t1").alias("dur"))
    lo = F.when(m == 1, column_of("duration - 3600000", F.col("dur"))).otherwise(0)
    return t.select("video", lo.cast("long").alias("lo"), F.when(m == 0, F.least(F.lit(86_400_000), F.col("dur"))).otherwise(F.col("dur")).alias("hi"), (m == 2).alias("unbounded"))


@query("r2_requirement_resolve", f"WITH {TIMELINE}, d AS (SELECT video, max(t1) / 1000.0::DOUBLE AS dur FROM tl GROUP BY video), x AS (SELECT video, dur, least(greatest(dur / 2 - 100 * (3 + 2), 0), dur) AS a, least(greatest(dur - 5 * video * 86400, 0), dur) AS b FROM d) SELECT video, round_even(least(a, b), 3) AS lo, round_even(greatest(a, b), 3) AS hi, a > b AS swapped, dur < 86400 * 29 AS beyond FROM x")
def r2(spark: SparkSession, d: str) -> DataFrame:
    """Symbolic windows for each video: evaluated, clamped to its duration, swapped if inverted."""
    from tidemark.functions.expressions import column_of

    t = timeline(spark, d).groupBy("video").agg((F.max("t1") / 1000.0).alias("dur"))
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.col("dur"))
    t = t.withColumns({"a": clamp(column_of("duration / 2 - 100 * (3 + 2)", F.col("dur"))), "b": clamp(F.col("dur") - 5 * F.col("video") * 86_400)})
    return t.select("video", F.bround(F.least("a", "b"), 3).alias("lo"), F.bround(F.greatest("a", "b"), 3).alias("hi"), (F.col("a") > F.col("b")).alias("swapped"), (F.col("dur") < 86_400 * 29).alias("beyond"))


@query("r5_presence", f"WITH {TIMELINE}, v AS (SELECT video, max(t1) AS dur FROM tl GROUP BY video) SELECT v.video, count(event_id) AS n, CASE WHEN count(event_id) > 0 THEN 'ESCALATE' WHEN v.video % 2 = 0 THEN 'FAIL' ELSE 'UNCERTAIN' END AS status FROM v LEFT JOIN tl ON tl.video = v.video AND modality = 'signup' AND k < 5 GROUP BY v.video")
def r5(spark: SparkSession, d: str) -> DataFrame:
    """No candidate at all fails, where the mode may fail, else it is uncertain."""
    t = timeline(spark, d)
    n = t.groupBy("video").agg(F.count_if((F.col("modality") == "signup") & (F.col("k") < 5)).alias("n"))
    return n.withColumn("status", F.when(F.col("n") > 0, "ESCALATE").when(F.col("video") % 2 == 0, "FAIL").otherwise("UNCERTAIN"))


@query(
    "r6_deadline",
    f"""WITH {TIMELINE}, c AS (SELECT video, min(t0 - 60000) AS lo_any, min(CASE WHEN k < 30 THEN t0 - 60000 END) AS lo, arg_min(t1 + 60000, (t0, event_id)) FILTER (k < 30) AS hi FROM tl WHERE modality = 'purchase' GROUP BY video)
    SELECT video, CASE WHEN lo_any > 259200000 THEN 'FAIL' WHEN lo IS NULL THEN 'ESCALATE' WHEN lo <= 259200000 AND hi >= 259200000 THEN 'UNCERTAIN' WHEN hi < 259200000 THEN 'PASS' ELSE 'ESCALATE' END AS status FROM c""",
)
def r6(spark: SparkSession, d: str) -> DataFrame:
    """Purchases by day three: all late fails, a straddling first relevant one is uncertain (closed on both sides)."""
    p = timeline(spark, d).filter("modality = 'purchase'")
    rel = F.col("k") < 30
    c = p.groupBy("video").agg(F.min(F.col("t0") - 60_000).alias("lo_any"), F.min(F.when(rel, F.col("t0") - 60_000)).alias("lo"), F.min_by(F.when(rel, F.col("t1") + 60_000), F.when(rel, F.struct("t0", "event_id"))).alias("hi"))
    at = 259_200_000
    return c.select("video", F.when(F.col("lo_any") > at, "FAIL").when(F.col("lo").isNull(), "ESCALATE").when((F.col("lo") <= at) & (F.col("hi") >= at), "UNCERTAIN").when(F.col("hi") < at, "PASS").otherwise("ESCALATE").alias("status"))


@query("so1_timeline_union", f"WITH {TIMELINE} SELECT 'event' AS src, video AS key, t0 AS at, modality AS kind FROM tl UNION ALL SELECT 'turn', conv_id, turn * 1000, role FROM conversations")
def so1(spark: SparkSession, d: str) -> DataFrame:
    """Two sources in one timeline."""
    t = timeline(spark, d).select(F.lit("event").alias("src"), F.col("video").alias("key"), F.col("t0").alias("at"), F.col("modality").alias("kind"))
    return t.unionByName(load(spark, d, "conversations").select(F.lit("turn").alias("src"), F.col("conv_id").alias("key"), (F.col("turn") * 1000).alias("at"), F.col("role").alias("kind")))


@query("x1_examined_grid", f"WITH {TIMELINE}, v AS (SELECT DISTINCT video FROM tl), e AS (SELECT video, t0 FROM tl WHERE modality = 'view' AND k < 3), p AS (SELECT video, t0 FROM tl WHERE modality = 'error') SELECT video, t0, true AS examined FROM e UNION ALL SELECT p.video, t0, false FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.video = p.video)")
def x1(spark: SparkSession, d: str) -> DataFrame:
    """The grid that was really looked at, else the plan."""
    t = timeline(spark, d)
    e = t.filter("modality = 'view' and k < 3").select("video", "t0")
    p = t.filter("modality = 'error'").select("video", "t0").join(e.select("video").distinct(), "video", "left_anti")
    return e.withColumn("examined", F.lit(True)).unionByName(p.withColumn("examined", F.lit(False)))


@query("x28_timeline_lanes", f"WITH {TIMELINE}, d AS (SELECT video, max(t1) AS dur FROM tl GROUP BY video) SELECT event_id, round_even(100.0::DOUBLE * t0 / dur, 4) AS left_pct, round_even(greatest(0.35::DOUBLE, 100.0::DOUBLE * (t1 - t0) / dur), 4) AS width_pct FROM tl JOIN d USING (video)")
def x28(spark: SparkSession, d: str) -> DataFrame:
    t = timeline(spark, d)
    j = t.join(t.groupBy("video").agg(F.max("t1").alias("dur")), "video")
    return j.select("event_id", F.bround(100.0 * F.col("t0") / F.col("dur"), 4).alias("left_pct"), F.bround(F.greatest(F.lit(0.35), 100.0 * (F.col("t1") - F.col("t0")) / F.col("dur")), 4).alias("width_pct"))
