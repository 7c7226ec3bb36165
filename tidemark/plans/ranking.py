"""Top-k, budgets, sources and verdict rules: S3-S5, S7, S8, S12, S15, S19-S21, K1-K6, K9-K11, K13, J9-J11, J17-J19, A19, A21, R3, R4, R7-R14, R21-R28, R30-R32, R35, X2, X4, X6, X8, X9, X19, X22-X25, X29."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import cues, fuzzy
from tidemark.functions import lexicon as lx
from tidemark.functions import text as tx
from tidemark.operators import matching
from tidemark.operators import ranking as rk
from tidemark.operators import verdicts as vd
from tidemark.plans.text import figures_sql
from tidemark.registry import query
from tidemark.tables import ASKS_SQL, TIMELINE, UNITS, asks, load, per_text, timeline, units


@query("k1_rank_candidates", f"WITH {TIMELINE} SELECT video, event_id, row_number() OVER (PARTITION BY video ORDER BY k DESC, t0, event_id) AS rank FROM tl")
def k1(spark: SparkSession, d: str) -> DataFrame:
    return timeline(spark, d).select("video", "event_id", F.row_number().over(Window.partitionBy("video").orderBy(F.desc("k"), "t0", "event_id")).alias("rank"))


@query(
    "k2_quota_top_k",
    f"""WITH {TIMELINE}, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY k DESC, t0, event_id) AS rnk, count(*) OVER (PARTITION BY video) AS n, min(modality) OVER (PARTITION BY video) AS lo, max(modality) OVER (PARTITION BY video) AS hi FROM tl),
    m AS (SELECT *, row_number() OVER (PARTITION BY video, modality ORDER BY rnk) AS ink FROM r),
    p AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY CASE WHEN n <= 10 OR lo = hi THEN 0 WHEN ink > 6 THEN 1 ELSE 0 END, rnk) AS pos FROM m)
    SELECT video, event_id, pos FROM p WHERE pos <= 10""",
)
def k2(spark: SparkSession, d: str) -> DataFrame:
    """Ten records a video, of which no modality has more than six unless rows are left over."""
    return rk.quota_top_k(timeline(spark, d), ["video"], "modality", [F.desc("k"), F.col("t0"), F.col("event_id")], 10, 0.6).select("video", "event_id", "pos")


@query("k3_distinct_text", "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY role, lower(text) ORDER BY conv_id, turn) AS rn FROM conversations) SELECT conv_id, turn FROM r WHERE rn = 1")
def k3(spark: SparkSession, d: str) -> DataFrame:
    """The first turn of each (role, normalised text)."""
    c = load(spark, d, "conversations").select("conv_id", "turn", "role", F.md5(F.lower("text")).alias("h"))
    return c.groupBy("role", "h").agg(F.min(F.struct("conv_id", "turn")).alias("m")).select("m.*")


@query(
    "k4_spread_sample",
    f"""WITH {TIMELINE}, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t0, event_id) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM tl), q AS (SELECT DISTINCT video, j, n, least(n - 1, j * n // 8) AS p FROM (SELECT DISTINCT video, n FROM r) CROSS JOIN range(8) x(j))
    SELECT r.video, event_id FROM r WHERE n <= 8 OR EXISTS (SELECT 1 FROM q WHERE q.video = r.video AND q.p = r.i)""",
)
def k4(spark: SparkSession, d: str) -> DataFrame:
    """Eight records spread evenly over each video."""
    return rk.spread(timeline(spark, d), ["video"], [F.col("t0"), F.col("event_id")], 8).select("video", "event_id")


@query(
    "k5_linspace",
    f"""WITH {TIMELINE}, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t0, event_id) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM tl), q AS (SELECT DISTINCT video, CAST(round_even(CAST(j * (n - 1) AS DOUBLE) / 11, 0) AS BIGINT) AS p FROM (SELECT DISTINCT video, n FROM r) CROSS JOIN range(12) x(j))
    SELECT r.video, event_id FROM r JOIN q ON q.video = r.video AND q.p = r.i""",
)
def k5(spark: SparkSession, d: str) -> DataFrame:
    """Twelve places round(linspace(0, n - 1)) of each video, half to even."""
    w = Window.partitionBy("video")
    r = timeline(spark, d).withColumns({"i": F.row_number().over(w.orderBy("t0", "event_id")) - 1, "n": F.count("*").over(w)})
    places = F.expr("transform(sequence(0, 11), j -> cast(bround(cast(j * (n - 1) as double) / 11, 0) as bigint))")
    return r.filter(F.array_contains(places, F.col("i").cast("long"))).select("video", "event_id")


@query("k6_priority_budget", f"WITH {TIMELINE}, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY CASE modality WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, t0, event_id) AS rn FROM tl) SELECT video, event_id FROM r WHERE rn <= 30")
def k6(spark: SparkSession, d: str) -> DataFrame:
    """Thirty records a video, filled by the priority of their reason."""
    from tidemark.tables import mapped

    return rk.budget(timeline(spark, d), ["video"], mapped("modality", {"signup": 0, "purchase": 1, "click": 2}, 3), [F.col("t0"), F.col("event_id")], 30).select("video", "event_id")


@query(
    "k9_sampling_plan",
    """WITH e AS (SELECT user_id AS video, 500 + user_id * 7919 % 240000 AS dur, event_id FROM events), v AS (SELECT DISTINCT video, dur FROM e),
    c AS (SELECT DISTINCT video, dur, event_id * 9973 % dur AS cut FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY cut) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM c),
    t AS (SELECT *, CASE WHEN dur < 10000 THEN 24 WHEN dur < 30000 THEN 40 WHEN dur < 60000 THEN 60 WHEN dur < 180000 THEN 90 ELSE 120 END AS n FROM v)
    SELECT video, 'uniform' AS reason, (2 * i + 1) * dur // (2 * n) AS at FROM t, LATERAL (SELECT unnest(range(n)) AS i)
    UNION ALL SELECT video, 'hook_window', i FROM v, LATERAL (SELECT unnest(range(0, least(5000, dur) + 1, 250)) AS i)
    UNION ALL SELECT video, 'cta_window', i FROM v, LATERAL (SELECT unnest(range(greatest(0, dur - 5000), dur + 1, 250)) AS i)
    UNION ALL SELECT video, 'scene_change', cut + 150 FROM r WHERE cut + 150 <= dur AND (n <= 48 OR EXISTS (SELECT 1 FROM range(48) x(j) WHERE CAST(round_even(CAST(j * (n - 1) AS DOUBLE) / 47, 0) AS BIGINT) = r.i))""",
)
def k9(spark: SparkSession, d: str) -> DataFrame:
    """A sampling plan for each video: equal bins, dense opening and end, a sample after each cut (stand-ins, in ms)."""
    e = load(spark, d, "events").select(F.col("user_id").alias("video"), (500 + F.col("user_id") * 7919 % 240_000).alias("dur"), "event_id")
    return rk.sampling_plan(e.select("video", "dur").distinct(), e.select("video", (F.col("event_id") * 9973 % F.col("dur")).alias("cut")))


@query(
    "k10_meaning",
    """WITH c AS (SELECT label AS key, vec_id AS cand, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)) AS v FROM embeddings WHERE vec_id % 10 <> 0),
    q AS (SELECT label AS key, vec_id AS req, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)) AS v FROM embeddings WHERE vec_id % 10 = 0), n AS (SELECT key, count(*) AS n FROM c GROUP BY key),
    p AS (SELECT q.req, c.cand, n.n, CASE WHEN q.req % 30 = 0 AND (q.req + c.cand) % 7 = 0 THEN 50 + c.cand % 40 ELSE 0 END AS hint, round_even(list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(c.v, c.v)), 6) AS near FROM q JOIN c USING (key) JOIN n USING (key)),
    h AS (SELECT *, max(hint) OVER (PARTITION BY req) > 0 AS hit FROM p),
    s AS (SELECT req, cand, CASE WHEN hit THEN hint WHEN n <= 12 THEN 0 ELSE near END::DOUBLE AS score, CASE WHEN hit THEN 'hint' WHEN n <= 12 THEN 'all' ELSE 'meaning' END AS "by" FROM h WHERE NOT hit OR hint > 0)
    SELECT req, cand, score, "by", CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY req ORDER BY score DESC, cand) AS rank FROM s) WHERE rank <= 12""",
)
def k10_meaning(spark: SparkSession, d: str) -> DataFrame:
    """Twelve candidates of each requirement: by hints where one hits, else by meaning where there are more than twelve (K10). Every tenth vector is a requirement."""
    e = load(spark, d, "embeddings").select(F.col("label").alias("key"), "vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000)).alias("v"))
    q = e.filter("vec_id % 10 = 0").select("key", F.col("vec_id").alias("req"), "v")
    c = e.filter("vec_id % 10 <> 0").select("key", F.col("vec_id").alias("cand"), F.col("vec_id").alias("at"), "v")
    h = q.filter("req % 30 = 0").select("key", "req").join(c.select("key", "cand"), "key").filter("(req + cand) % 7 = 0").select("req", "cand", (50 + F.col("cand") % 40).alias("score"))
    return rk.semantic_rank(q, c, h, 12)


@query(
    "k10_semantic_rank",
    """WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)) AS v FROM embeddings), q AS (SELECT label, arg_min(v, vec_id) AS c, min(vec_id) AS own FROM n GROUP BY label),
    s AS (SELECT q.label, n.vec_id, CAST(list_dot_product(q.c, n.v) AS BIGINT) AS score FROM n JOIN q ON n.label = q.label AND n.vec_id <> q.own), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT label, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
)
def k10(spark: SparkSession, d: str) -> DataFrame:
    """Of each label, the ten vectors most like its first one."""
    n = load(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000)).alias("v"))
    q = n.groupBy("label").agg(F.min_by("v", "vec_id").alias("c"), F.min("vec_id").alias("own"))
    s = n.join(q, "label").filter("vec_id <> own")
    s = s.withColumn("score", F.aggregate(F.zip_with("c", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).cast("long"))
    w = Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    return s.select("label", "vec_id", "score", F.row_number().over(w).alias("rank")).filter("rank <= 10")


@query("k11_id_caps", f"WITH {UNITS}, r AS (SELECT DISTINCT video, id FROM un), s AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY id) AS rn FROM r) SELECT video, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM s WHERE rn <= 5 GROUP BY video")
def k11(spark: SparkSession, d: str) -> DataFrame:
    """The first five ids of each video."""
    ids = F.slice(F.array_sort(F.collect_set("id")), 1, 5)
    return units(spark, d).groupBy("video").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query("k13_ladder_rungs", "WITH m AS (SELECT p_brand, p_partkey, p_size, min(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo FROM part) SELECT p_brand, p_partkey, p_size FROM m WHERE lo IS NULL OR p_size < lo")
def k13(spark: SparkSession, d: str) -> DataFrame:
    """Rungs that are lower than all before them."""
    lo = F.min("p_size").over(Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, -1))
    return load(spark, d, "part").select("p_brand", "p_partkey", "p_size", lo.alias("lo")).filter("lo is null or p_size < lo").drop("lo")


@query("s3_newest_artifact", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'signup' THEN 0 WHEN event_type = 'purchase' THEN 1 ELSE 2 END, ts DESC, event_id DESC) AS rn, event_type FROM events) SELECT user_id, event_id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'exact' ELSE 'fallback' END AS how FROM r WHERE rn = 1")
def s3(spark: SparkSession, d: str) -> DataFrame:
    """The preferred key if it is there, newest first, else the newest of any."""
    pref = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    best = rk.first_per(load(spark, d, "events"), ["user_id"], [pref, F.desc("ts"), F.desc("event_id")])
    return best.select("user_id", "event_id", F.when(F.col("event_type").isin("signup", "purchase"), "exact").otherwise("fallback").alias("how"))


@query("s4_best_per_key", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) SELECT source, doc_id, n_chars FROM r WHERE rn = 1")
def s4(spark: SparkSession, d: str) -> DataFrame:
    """Of each source the longest document, the first of equals."""
    best = F.max_by(F.struct("doc_id", "n_chars"), F.struct(F.col("n_chars"), -F.col("doc_id")))
    return load(spark, d, "documents").groupBy("source").agg(best.alias("b")).select("source", "b.*")


@query("s5_job_scope", "WITH j AS (SELECT * FROM nation WHERE n_regionkey = 99), m AS (SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM j)) SELECT s_suppkey FROM m UNION ALL SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM m)")
def s5(spark: SparkSession, d: str) -> DataFrame:
    """Rows of this job's inbox, or all of them if none is."""
    sup = load(spark, d, "supplier")
    m = sup.join(load(spark, d, "nation").filter("n_regionkey = 99").select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey", "left_semi").select("s_suppkey")
    n = m.agg(F.count("*").alias("n"))
    return m.unionByName(sup.select("s_suppkey").crossJoin(F.broadcast(n)).filter("n = 0").drop("n"))


@query("s7_probe_row", "SELECT p_partkey, TRY_CAST(string_split(r, '/')[1] AS DOUBLE) / nullif(TRY_CAST(string_split(r, '/')[2] AS DOUBLE), 0) AS rate, ((p_size * 90 % 360) + 360) % 360 AS rotation FROM (SELECT *, CASE WHEN p_size % 5 = 0 THEN '0/0' ELSE (p_size * 1000) || '/1001' END AS r FROM part)")
def s7(spark: SparkSession, d: str) -> DataFrame:
    """Rates `num/den`, null without a denominator; rotation from 0 to 270."""
    p = load(spark, d, "part").withColumn("r", F.when(F.col("p_size") % 5 == 0, "0/0").otherwise(F.concat((F.col("p_size") * 1000).cast("string"), F.lit("/1001"))))
    part = lambda i: F.split("r", "/")[i].try_cast("double")
    return p.select("p_partkey", F.try_divide(part(0), part(1)).alias("rate"), ((F.col("p_size") * 90 % 360 + 360) % 360).alias("rotation"))


@query("s15_safe_names", "WITH n AS (SELECT page_id, substr(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), 1, 24) AS base FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) AS rn FROM n) SELECT page_id, CASE WHEN rn > 1 THEN base || '_' || (rn - 1) ELSE base END AS name FROM r")
def s15(spark: SparkSession, d: str) -> DataFrame:
    """Sanitised names, a number after the second and later uses."""
    n = load(spark, d, "pages").select("page_id", F.substring(F.regexp_replace(F.lower("url"), "[^a-z0-9]+", "_"), 1, 24).alias("base"))
    rn = F.row_number().over(Window.partitionBy("base").orderBy("page_id"))
    return n.withColumn("rn", rn).select("page_id", F.when(F.col("rn") > 1, F.concat_ws("_", "base", (F.col("rn") - 1).cast("string"))).otherwise(F.col("base")).alias("name"))


@query("s19_metrics", "WITH dm AS (SELECT unnest(['click','error','purchase','signup','view','queued']) AS status) SELECT status, count(event_id) AS n FROM dm LEFT JOIN events ON event_type = status GROUP BY status")
def s19(spark: SparkSession, d: str) -> DataFrame:
    """Counts by status over the whole domain, zeros included."""
    dm = spark.createDataFrame([(x,) for x in ("click", "error", "purchase", "signup", "view", "queued")], "status string")
    n = load(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
    return F.broadcast(dm).join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("s20_job_restore", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS status, o_orderstatus = 'P' AS interrupted FROM orders")
def s20(spark: SparkSession, d: str) -> DataFrame:
    """What was running at a restart has failed."""
    return load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus")).alias("status"), (F.col("o_orderstatus") == "P").alias("interrupted"))


@query("s21_retention_sweep", "SELECT user_id, max(ts) AS newest, count(*) AS files FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR")
def s21(spark: SparkSession, d: str) -> DataFrame:
    """Folders whose newest file is older than the cutoff go whole."""
    e = load(spark, d, "events")
    cut = e.agg((F.max("ts") - F.expr("interval 12 hours")).alias("cut"))
    return e.groupBy("user_id").agg(F.max("ts").alias("newest"), F.count("*").alias("files")).crossJoin(F.broadcast(cut)).filter("newest < cut").drop("cut")


@query("j9_citation_times", f"WITH {TIMELINE}, c AS (SELECT event_id AS vid, unnest(CASE WHEN k % 3 = 0 THEN [event_id + 1, event_id + 2] ELSE [event_id] END) AS cited FROM tl) SELECT c.vid, min(t0) AS at FROM c LEFT JOIN tl ON tl.event_id = cited GROUP BY c.vid")
def j9(spark: SparkSession, d: str) -> DataFrame:
    """The earliest start among a verdict's cited records."""
    t = timeline(spark, d)
    c = t.select(F.col("event_id").alias("vid"), F.explode(F.when(F.col("k") % 3 == 0, F.array(F.col("event_id") + 1, F.col("event_id") + 2)).otherwise(F.array("event_id"))).alias("event_id"))
    return c.join(t.select("event_id", "t0"), "event_id", "left").groupBy("vid").agg(F.min("t0").alias("at"))


@query("j10_fabricated_citations", "WITH c AS (SELECT doc_id, unnest([doc_id, doc_id * 2]) AS cited FROM documents) SELECT doc_id, cited FROM c WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = c.cited)")
def j10(spark: SparkSession, d: str) -> DataFrame:
    """Citations of what was never offered."""
    c = load(spark, d, "documents").select("doc_id", F.explode(F.array("doc_id", F.col("doc_id") * 2)).alias("cited"))
    return c.join(load(spark, d, "labels").select(F.col("doc_id").alias("cited")), "cited", "left_anti").select("doc_id", "cited")


@query("j11_reply_validation", "SELECT l.doc_id FROM labels l JOIN documents USING (doc_id) WHERE l.doc_id + 1 IN (SELECT doc_id FROM labels)")
def j11(spark: SparkSession, d: str) -> DataFrame:
    """Replies to known requests all of whose ids were offered."""
    l = load(spark, d, "labels").select("doc_id")
    r = load(spark, d, "documents").select("doc_id").join(l, "doc_id", "left_semi").withColumn("ids", F.array("doc_id", F.col("doc_id") + 1))
    e = r.select("doc_id", F.explode("ids").alias("i")).join(l.select(F.col("doc_id").alias("i"), F.lit(1).alias("there")), "i", "left")
    return e.groupBy("doc_id").agg(F.count("there").alias("n"), F.count("*").alias("m")).filter("n = m").select("doc_id")


@query("j18_angle_match", "WITH a AS (SELECT p_partkey, p_name FROM part), n AS (SELECT * FROM (VALUES (0, 'ring'), (1, 'red widget'), (2, 'bolt'), (3, 'blue')) v(pos, name)), m AS (SELECT p_partkey, name, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN lower(p_name) = name THEN 0 ELSE 1 END, pos) AS rn FROM a JOIN n ON contains(lower(p_name), name) OR contains(name, lower(p_name))) SELECT p_partkey, name FROM m WHERE rn = 1")
def j18(spark: SparkSession, d: str) -> DataFrame:
    """The first name that equals, contains or is contained."""
    n = spark.createDataFrame([(0, "ring"), (1, "red widget"), (2, "bolt"), (3, "blue")], "pos int, name string")
    low = F.lower("p_name")
    m = load(spark, d, "part").join(F.broadcast(n), F.contains(low, F.col("name")) | F.contains(F.col("name"), low))
    return rk.first_per(m, ["p_partkey"], [F.when(low == F.col("name"), 0).otherwise(1), F.col("pos")]).select("p_partkey", "name")


@query("j19_submitted_results", "SELECT coalesce(c_custkey, o_custkey) AS custkey, o_custkey IS NOT NULL AS placed, n FROM customer FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def j19(spark: SparkSession, d: str) -> DataFrame:
    """Everything submitted and everything that came back, once each."""
    o = load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    j = load(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "full_outer")
    return j.select(F.coalesce("c_custkey", "o_custkey").alias("custkey"), F.col("o_custkey").isNotNull().alias("placed"), "n")


@query("a19_group_intent", "WITH c AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, length(p_name) DESC, p_name) AS rn FROM c) SELECT p_brand, p_name AS intent FROM r WHERE rn = 1")
def a19(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent name of a group, then the longest, then the first."""
    c = load(spark, d, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n"))
    return rk.first_per(c, ["p_brand"], [F.desc("n"), F.desc(F.length("p_name")), F.col("p_name")]).select("p_brand", F.col("p_name").alias("intent"))


@query("a21_decomposition_health", "SELECT source, round_even(CAST(count(*) AS DOUBLE) / sum(len(string_split(text, chr(10)))), 6) AS ratio, CAST(count(*) AS DOUBLE) / sum(len(string_split(text, chr(10)))) > 2.5 AS over, CAST(count(*) AS DOUBLE) / sum(len(string_split(text, chr(10)))) < 0.4 AS under FROM documents GROUP BY source")
def a21(spark: SparkSession, d: str) -> DataFrame:
    r = F.count("*").cast("double") / F.sum(F.size(F.split("text", "\n")))
    return load(spark, d, "documents").groupBy("source").agg(r.alias("r")).select("source", F.bround("r", 6).alias("ratio"), (F.col("r") > 2.5).alias("over"), (F.col("r") < 0.4).alias("under"))


@query(
    "a15_consensus_vote",
    """WITH c AS (SELECT regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g') AS fp, doc_id, text FROM documents), g AS (SELECT fp, count(*) AS votes, arg_max(doc_id, (length(text), -doc_id)) AS rep FROM c GROUP BY fp),
    k AS (SELECT rep, votes, regexp_matches(fp, 'rights reserved|license') AS safety FROM g), s AS (SELECT rep, votes, CASE WHEN votes < 2 THEN 'KEPT_AS_SAFETY_RULE:seen_' || votes || '_of_3' END AS flag FROM k WHERE votes >= 2 OR safety ORDER BY votes DESC, rep LIMIT 40)
    SELECT *, CAST(row_number() OVER (ORDER BY votes DESC, rep) AS INTEGER) AS ordinal FROM s""",
)
def a15(spark: SparkSession, d: str) -> DataFrame:
    """Requirements (stand-ins: texts) that a quorum of three compiles has, and safety rules whatever their votes; the longest text stands for its cluster. At most 40, by votes, numbered anew."""
    fp = F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", "")
    c = load(spark, d, "documents").select("doc_id", F.length("text").alias("len"), F.md5(fp).alias("fp"), fp.rlike("rights reserved|license").alias("safety"))
    g = c.groupBy("fp").agg(F.count("*").alias("votes"), F.max_by("doc_id", F.struct("len", -F.col("doc_id"))).alias("rep"), F.first("safety").alias("safety"))
    need = max(1, round(0.5 * 3))  # half to even
    flag = F.when(F.col("votes") < need, F.concat(F.lit("KEPT_AS_SAFETY_RULE:seen_"), F.col("votes").cast("string"), F.lit("_of_3")))
    top = g.filter((F.col("votes") >= need) | F.col("safety")).select("rep", "votes", flag.alias("flag")).orderBy(F.desc("votes"), "rep").limit(40)
    return top.withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("votes"), "rep")))  # of 40 rows


VR = f"""{UNITS}, vr AS (SELECT *, q % 3 <> 0 AS can_fail, q % 11 = 0 AS degraded, q * 2 AS sim FROM un)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    return units(spark, d).withColumns({"can_fail": q % 3 != 0, "degraded": q % 11 == 0, "sim": q * 2})


@query("r9_fail_gate", f"WITH {VR} SELECT id, q, CASE WHEN status = 'FAIL' AND NOT can_fail THEN 'UNCERTAIN' ELSE status END AS status, status = 'FAIL' AND NOT can_fail AS gated FROM vr")
def r9(spark: SparkSession, d: str) -> DataFrame:
    """A mode that may not fail a requirement makes a FAIL uncertain."""
    return vd.fail_gate(judged(spark, d)).select("id", "q", "status", "gated")


@query("r10_triage", f"WITH {VR} SELECT id, q, CASE WHEN sim >= 72 THEN 'PASS' WHEN sim <= 35 AND can_fail THEN 'FAIL' WHEN sim <= 35 THEN 'UNCERTAIN' ELSE 'ESCALATE' END AS status FROM vr")
def r10(spark: SparkSession, d: str) -> DataFrame:
    """High similarity passes, low fails where it may, the rest goes on."""
    return judged(spark, d).select("id", "q", vd.triage(F.col("sim"), F.col("can_fail")).alias("status"))


FORBIDDEN = ["cure", "heal", "guarantee", "other brands"]
_FORBIDDEN_SQL = " OR ".join(f"regexp_matches(' ' || lower(text), '[^a-z0-9_]{t}(s|es|ed|d|ing)?([^a-z0-9_]|$)')" for t in FORBIDDEN)


@query(
    "r3_forbidden_check",
    f"""WITH {ASKS_SQL}, h AS (SELECT id, CASE id % 3 WHEN 0 THEN 'speech' WHEN 1 THEN 'ocr' ELSE 'visual' END AS modality, id // 24 % 40 AS video, {_FORBIDDEN_SQL} AS hit FROM asks),
    g AS (SELECT video, min(id) FILTER (hit) AS first_hit, count(*) FILTER (hit) AS hits, arg_min(modality, id) FILTER (hit) AS said_in FROM h GROUP BY video)
    SELECT video, hits, first_hit, CASE WHEN hits > 0 AND said_in = 'ocr' AND video % 5 = 0 THEN 'UNCERTAIN' WHEN hits > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN hits = 0 THEN 'PASS_FROM_ABSENCE' END AS flag FROM g""",
)
def r3(spark: SparkSession, d: str) -> DataFrame:
    """A forbidden term is positive evidence of a FAIL, unless the modality of its first hit is degraded for the video; none at all is a pass from absence."""
    modality = F.when(F.col("id") % 3 == 0, "speech").when(F.col("id") % 3 == 1, "ocr").otherwise("visual")
    hit = reduce(lambda a, b: a | b, (tx.word_hit(F.lower("text"), F.lit(t)) for t in FORBIDDEN))
    h = asks(spark, d).select("id", modality.alias("modality"), F.expr("id div 24 % 40").alias("video"), hit.alias("hit"))
    g = h.groupBy("video").agg(F.count_if("hit").alias("hits"), F.min(F.when(F.col("hit"), F.struct("id", "modality"))).alias("first"))
    degraded = (F.col("first.modality") == "ocr") & (F.col("video") % 5 == 0)
    status = F.when(F.col("hits") == 0, "PASS").when(degraded, "UNCERTAIN").otherwise("FAIL")
    return g.select("video", "hits", F.col("first.id").alias("first_hit"), status.alias("status"), F.when(F.col("hits") == 0, "PASS_FROM_ABSENCE").alias("flag"))


@query("r4_phrase_check", "WITH h AS (SELECT item_id, b.text AS phrase, count(d.doc_id) AS n, count(d.doc_id) FILTER (lang = 'en') AS en FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY ALL) SELECT item_id, n, CASE WHEN n > 0 AND en > 0 AND en < n THEN 'PASS' WHEN n > 0 THEN 'PARTIAL' ELSE 'ESCALATE' END AS status FROM h")
def r4(spark: SparkSession, d: str) -> DataFrame:
    """A phrase in both kinds of source passes, in one it is partial, in none it goes on (exact phrases; r4_fuzzy_phrases for like ones)."""
    b = load(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    m = matching.contained(b, "item", load(spark, d, "documents").select("doc_id", "text", "lang"), "text", "doc_id")
    m = m.groupBy("item_id").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("en"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return b.select("item_id").join(m, "item_id", "left").select("item_id", n.alias("n"), F.when((n > 0) & (F.col("en") > 0) & (F.col("en") < n), "PASS").when(n > 0, "PARTIAL").otherwise("ESCALATE").alias("status"))


@query("r4_fuzzy_phrases")
def r4_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """The best hint of each requirement in a record: 85 passes, else it goes on; a lone word goes on even so where it is one of a group's options."""
    hints = ["dermatologist recommended", "clinically proven", "score", "shop now"]
    best = per_text(asks(spark, d), "text", lambda t: t.withColumn("best", fuzzy.hint_score(hints, F.lower("text")))).select("id", "text", (F.col("id") % 4 == 0).alias("grouped"), "best.*")
    lone = F.col("grouped") & ~F.contains("hint", F.lit(" "))
    return best.withColumn("status", F.when((F.col("score") >= 85) & ~lone, "PASS").otherwise("ESCALATE"))


@query("r8_ladder", f"WITH {VR} SELECT id, q, coalesce(CASE WHEN polarity = 'forbidden' AND degraded THEN 'UNCERTAIN' WHEN polarity = 'forbidden' AND alignment = 'exact' THEN 'FAIL' END, CASE WHEN sim >= 85 THEN 'PASS' END, CASE WHEN alignment IS NULL AND can_fail THEN 'FAIL' WHEN alignment IS NULL THEN 'UNCERTAIN' END, 'ESCALATE') AS status FROM vr")
def r8(spark: SparkSession, d: str) -> DataFrame:
    """Rules in a fixed order: the first that has an answer gives it."""
    f = F.col("polarity") == "forbidden"
    rules = [
        lambda: F.when(f & F.col("degraded"), "UNCERTAIN").when(f & (F.col("alignment") == "exact"), "FAIL"),
        lambda: F.when(F.col("sim") >= 85, "PASS"),
        lambda: F.when(F.col("alignment").isNull() & F.col("can_fail"), "FAIL").when(F.col("alignment").isNull(), "UNCERTAIN"),
    ]
    return judged(spark, d).select("id", "q", vd.ladder(rules, "ESCALATE").alias("status"))


@query("r11_batch_merge", f"WITH {VR}, o AS (SELECT *, (row_number() OVER (PARTITION BY video ORDER BY id, q, polarity, dimension, flag) - 1) // 12 AS batch FROM vr WHERE alignment IS NOT NULL) SELECT video, batch, count(*) AS n, count(*) FILTER (q % 5 = 0) AS unanswered FROM o GROUP BY ALL")
def r11(spark: SparkSession, d: str) -> DataFrame:
    """Batches of twelve a video; what got no reply is uncertain."""
    o = judged(spark, d).filter("alignment is not null").withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("video").orderBy("id", "q", "polarity", "dimension", "flag")) - 1) / 12))
    return o.groupBy("video", "batch").agg(F.count("*").alias("n"), F.count_if(F.col("q") % 5 == 0).alias("unanswered"))


@query("r12_alignment_backfill", f"WITH {VR} SELECT id, q, CASE WHEN alignment IS NOT NULL THEN alignment WHEN degraded THEN NULL WHEN status = 'PASS' THEN 'exact' WHEN status = 'FAIL' THEN 'none' WHEN status = 'PARTIAL' THEN 'partial' END AS alignment FROM vr")
def r12(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("id", "q", vd.backfilled(F.col("degraded")).alias("alignment"))


@query(
    "r13_substance_credit",
    f"""WITH {VR} SELECT id, q, CASE WHEN NOT elig THEN status WHEN gate THEN 'UNCERTAIN' WHEN alignment IN ('exact', 'strong') THEN 'PASS' ELSE 'PARTIAL' END AS status, CASE WHEN elig THEN 'FAIL/' || alignment END AS literal
    FROM (SELECT *, coalesce(polarity <> 'forbidden' AND (status = 'FAIL' AND alignment IN ('exact', 'strong', 'partial') OR status = 'PARTIAL' AND alignment IN ('exact', 'strong')), false) AS elig, q % 7 = 0 AS gate FROM vr)""",
)
def r13(spark: SparkSession, d: str) -> DataFrame:
    """A literal miss that delivers the substance is promoted, unless a trust gate makes it uncertain."""
    return vd.credited(judged(spark, d), F.col("q") % 7 == 0).select("id", "q", "status", "literal")


@query("r14_illegal_fail", f"WITH {VR} SELECT video, count(*) AS n FROM vr WHERE status = 'FAIL' AND NOT can_fail AND polarity <> 'forbidden' GROUP BY video")
def r14(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).filter("status = 'FAIL' and not can_fail and polarity <> 'forbidden'").groupBy("video").agg(F.count("*").alias("n"))


@query(
    "r7_figure_fidelity",
    f"""WITH {ASKS_SQL}, {figures_sql('f', "SELECT id, CASE WHEN id % 3 = 2 THEN 'visual' ELSE 'speech' END AS modality, id % 50 = 3 AS approved, text AS x FROM asks")},
    ok AS (SELECT DISTINCT value, unit FROM f WHERE approved)
    SELECT id, count(DISTINCT (value, unit)) AS bad FROM f WHERE unit <> '' AND modality <> 'visual' AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.value = f.value AND ok.unit = f.unit) GROUP BY id""",
)
def r7(spark: SparkSession, d: str) -> DataFrame:
    """Records that say or show a figure of a policed unit that no approved text has: an anti-join on value and unit. Bare numbers and what is only seen are left alone."""
    a = asks(spark, d).withColumn("f", tx.policed(tx.figures(F.col("text"))))
    ok = a.filter("id % 50 = 3").select(F.explode("f").alias("f")).select("f.*").distinct()
    said = a.filter("id % 3 <> 2").select("id", F.explode(F.array_distinct("f")).alias("f")).select("id", "f.*")
    return said.join(ok, ["value", "unit"], "left_anti").groupBy("id").agg(F.count("*").alias("bad"))


@query("r21_hook_features", r"WITH o AS (SELECT conv_id, arg_min(text, turn) AS text, min(turn) AS onset, count(*) FILTER (turn < 3) AS early, count(DISTINCT role) FILTER (turn < 3) - 1 AS cuts FROM conversations GROUP BY conv_id) SELECT conv_id, onset, early, cuts, contains(text, '?') AS question, regexp_matches(text, '[0-9]') AS number, regexp_matches(lower(text), '(^|[^a-z])(no|not|never)([^a-z]|$)') AS negation, regexp_matches(lower(text), '(^|[^a-z])(you|your|yours|yourself)([^a-z]|$)') AS second_person FROM o")
def r21(spark: SparkSession, d: str) -> DataFrame:
    """What the opening of a conversation has: turns before the third second, changes of speaker among them, and the wording of the first turn."""
    early = F.col("turn") < 3
    o = load(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"), F.min("turn").alias("onset"), F.count_if(early).alias("early"), (F.count_distinct(F.when(early, F.col("role"))) - 1).alias("cuts"))
    word = lambda ws: F.lower("text").rlike(f"(^|[^a-z])({ws})([^a-z]|$)")
    return o.select("conv_id", "onset", "early", "cuts", F.contains("text", F.lit("?")).alias("question"), F.col("text").rlike("[0-9]").alias("number"), word("no|not|never").alias("negation"), word("you|your|yours|yourself").alias("second_person"))


@query(
    "p19_request_guard",
    """WITH q AS (SELECT o_orderkey, CAST(o_totalprice AS BIGINT) % 31 AS n_videos, o_orderkey % 3 <> 0 AS has_url, o_orderkey % 4 = 0 AS has_text, o_orderkey % 7 = 0 AS compiled, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS depth FROM orders)
    SELECT o_orderkey, CASE WHEN NOT has_url AND NOT has_text AND NOT compiled THEN 422 WHEN has_url AND has_text THEN 422 WHEN n_videos > 25 THEN 422 WHEN depth >= 20 THEN 429 ELSE 202 END AS status,
      CASE WHEN NOT has_url AND NOT has_text AND NOT compiled THEN 'NO_BRIEF' WHEN has_url AND has_text THEN 'BRIEF_TWICE' WHEN n_videos > 25 THEN 'TOO_MANY_VIDEOS' WHEN depth >= 20 THEN 'QUEUE_FULL' END AS reason FROM q""",
)
def p19(spark: SparkSession, d: str) -> DataFrame:
    """What must hold before a job is taken on: a brief, in one form, at most 25 videos, at most 20 jobs waiting; the first that doesn't is the reason."""
    depth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    key = F.col("o_orderkey")
    q = load(spark, d, "orders").select("o_orderkey", (F.bround("o_totalprice", 0).cast("long") % 31).alias("n_videos"), (key % 3 != 0).alias("url"), (key % 4 == 0).alias("text"), (key % 7 == 0).alias("compiled"), depth.alias("depth"))
    reason = F.when(~F.col("url") & ~F.col("text") & ~F.col("compiled"), "NO_BRIEF").when(F.col("url") & F.col("text"), "BRIEF_TWICE").when(F.col("n_videos") > 25, "TOO_MANY_VIDEOS").when(F.col("depth") >= 20, "QUEUE_FULL")
    r = q.select("o_orderkey", reason.alias("reason"))
    return r.select("o_orderkey", F.when(F.col("reason").isNull(), 202).when(F.col("reason") == "QUEUE_FULL", 429).otherwise(422).alias("status"), "reason")


@query("r22_claim_candidates")
def r22(spark: SparkSession, d: str) -> DataFrame:
    """Records that may make a claim: up to six of their terms and wordings, sorted, and the class of the first wording (long terms also where they are alike at 90)."""
    long = [t for t in lx.CLAIM_TERMS if len(t) >= fuzzy.SHORT_TERM or " " in t]

    @F.pandas_udf("string")
    def terms(low: pd.Series, hits: pd.Series) -> pd.Series:
        near = lambda x: [] if x is None else [t for t in long if fuzzy.holds_term(t, x, 90)]
        return pd.Series([",".join(sorted({*near(x), *(() if h is None else h)})[:6]) for x, h in zip(low, hits, strict=True)], dtype=object)

    def of(t: DataFrame) -> DataFrame:
        c = t.select("text", cues.claim_candidate(F.col("text")).alias("c"))
        # said to be nondeterministic, as else the filter is pushed below the exchanges, to each row in its small file
        return c.select("text", terms.asNondeterministic()(F.lower(F.trim("text")), F.col("c.all_terms")).alias("terms"), F.col("c.klass").alias("klass"))

    return per_text(asks(spark, d), "text", of).select("id", "text", "terms", "klass").filter("terms <> ''")


@query("r22_claim_wordings", f"WITH {ASKS_SQL} SELECT id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{k}'" for p, k in lx.CLAIM_WORDINGS) + " END AS klass FROM asks")
def r22_wordings(spark: SparkSession, d: str) -> DataFrame:
    """The class of the first wording of a claim that a record has."""
    low = F.lower("text")
    return asks(spark, d).select("id", F.coalesce(*(F.when(low.rlike(p), k) for p, k in lx.CLAIM_WORDINGS)).alias("klass"))


@query("r24_recommendations", f"WITH {TIMELINE}, r AS (SELECT event_id, video, k, t0 + (k % 4) * 1000 AS anchor, t0, t1 FROM tl WHERE k % 9 <> 0), x AS (SELECT *, row_number() OVER (PARTITION BY video, k ORDER BY t0, event_id) AS rn FROM r) SELECT event_id, CASE WHEN anchor BETWEEN t0 - 1000 AND t1 + 1000 THEN anchor END AS anchor FROM x WHERE rn = 1")
def r24(spark: SparkSession, d: str) -> DataFrame:
    """Banned rows go, anchors outside their record become null, repeats of (video, text) go."""
    r = timeline(spark, d).filter("k % 9 <> 0").withColumn("anchor", F.col("t0") + (F.col("k") % 4) * 1000)
    return rk.first_per(r, ["video", "k"], [F.col("t0"), F.col("event_id")]).select("event_id", F.when(F.col("anchor").between(F.col("t0") - 1000, F.col("t1") + 1000), F.col("anchor")).alias("anchor"))


@query(
    "r26_budget_digest",
    """WITH b AS (SELECT conv_id, role, turn, trim(replace(text, chr(10), ' ')) AS body FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, lower(substr(body, 1, 80)) ORDER BY turn) AS rn FROM b WHERE body <> ''),
    r AS (SELECT conv_id, role, turn, length(body) + 12 AS n, sum(length(body) + 12) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM k WHERE rn = 1)
    SELECT conv_id, role, count(*) FILTER (run <= 1200) AS lines, CAST(coalesce(sum(n) FILTER (run <= 1200), 0) AS BIGINT) AS chars, max(run) > 1200 AS truncated FROM r GROUP BY ALL""",
)
def r26(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each kind in order, those whose first 80 characters came before left out, until the first that overflows the budget of characters."""
    body = F.trim(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    b = load(spark, d, "conversations").select("conv_id", "role", "turn", body.alias("body")).filter("body <> ''")
    k = rk.first_per(b.withColumn("key", F.lower(F.substring("body", 1, 80))), ["conv_id", "role", "key"], [F.col("turn")])
    run = F.sum(F.length("body") + 12).over(Window.partitionBy("conv_id", "role").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    r = k.select("conv_id", "role", (F.length("body") + 12).alias("n"), run.alias("run"))
    shown = F.col("run") <= 1200
    return r.groupBy("conv_id", "role").agg(F.count_if(shown).alias("lines"), F.coalesce(F.sum(F.when(shown, F.col("n"))), F.lit(0)).alias("chars"), (F.max("run") > 1200).alias("truncated"))


@query("r28_frozen_contract", "SELECT o_custkey, coalesce(max(o_orderkey) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'), arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F')) AS contract FROM orders GROUP BY o_custkey")
def r28(spark: SparkSession, d: str) -> DataFrame:
    """The pointed-at contract if it is valid, else the oldest approved one."""
    ok = F.col("o_orderstatus") == "F"
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.coalesce(F.max(F.when(ok & (F.col("o_orderpriority") == "1-URGENT"), F.col("o_orderkey"))), F.min_by(F.when(ok, F.col("o_orderkey")), F.when(ok, F.struct("o_orderdate", "o_orderkey")))).alias("contract"))


@query("r27_approval_state", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice < 50000 THEN 'approved_legacy' WHEN substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 1) < '8' THEN 'approved' ELSE 'tampered' END AS state FROM orders")
def r27(spark: SparkSession, d: str) -> DataFrame:
    """Approved if the digest matches; without one it is approved as before digests."""
    digest = F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 1)
    return load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_totalprice") < 50000, "approved_legacy").when(digest < "8", "approved").otherwise("tampered").alias("state"))


@query("x6_frame_selection", f"WITH {TIMELINE}, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY CASE modality WHEN 'signup' THEN 0 ELSE 1 END, t0, event_id) AS rn FROM tl WHERE modality <> 'error') SELECT video, event_id, row_number() OVER (PARTITION BY video ORDER BY t0, event_id) AS pos FROM r WHERE rn <= 20")
def x6(spark: SparkSession, d: str) -> DataFrame:
    """Twenty frames by priority, back in order of time."""
    best = rk.first_per(timeline(spark, d).filter("modality <> 'error'"), ["video"], [F.when(F.col("modality") == "signup", 0).otherwise(1), F.col("t0"), F.col("event_id")], 20)
    return best.select("video", "event_id", F.row_number().over(Window.partitionBy("video").orderBy("t0", "event_id")).alias("pos"))


@query("x8_planned_frames", f"WITH {TIMELINE}, p AS (SELECT event_id FROM tl WHERE k % 2 = 0) SELECT event_id, 'f' || lpad(CAST(row_number() OVER (PARTITION BY video ORDER BY t0, event_id) AS VARCHAR), 5, '0') AS frame FROM tl WHERE event_id IN (SELECT event_id FROM p)")
def x8(spark: SparkSession, d: str) -> DataFrame:
    t = timeline(spark, d)
    p = t.filter("k % 2 = 0").select("event_id")
    return t.join(p, "event_id", "left_semi").select("event_id", F.format_string("f%05d", F.row_number().over(Window.partitionBy("video").orderBy("t0", "event_id"))).alias("frame"))


@query("x9_frame_table", f"WITH {TIMELINE} SELECT video, event_id, row_number() OVER (PARTITION BY video ORDER BY t0, event_id) - 1 AS idx FROM tl")
def x9(spark: SparkSession, d: str) -> DataFrame:
    return timeline(spark, d).select("video", "event_id", (F.row_number().over(Window.partitionBy("video").orderBy("t0", "event_id")) - 1).alias("idx"))


@query("x19_schema_violations", "SELECT 'orders.o_orderstatus' AS rule, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'lineitem.l_discount', count(*) FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 0.08 UNION ALL SELECT 'customer.c_acctbal', count(*) FROM customer WHERE c_acctbal < 0")
def x19(spark: SparkSession, d: str) -> DataFrame:
    """Violations of closed domains and ranges, by rule."""
    rules = [("orders", "orders.o_orderstatus", ~F.col("o_orderstatus").isin("F", "O")), ("lineitem", "lineitem.l_discount", ~F.col("l_discount").between(0, 0.08)), ("customer", "customer.c_acctbal", F.col("c_acctbal") < 0)]
    parts = [load(spark, d, t).filter(bad).agg(F.count("*").alias("n")).select(F.lit(r).alias("rule"), "n") for t, r, bad in rules]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("x23_deadline", f"WITH {TIMELINE}, c AS (SELECT event_id, video, sum(value) OVER (PARTITION BY video ORDER BY t0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent FROM tl) SELECT event_id, CASE WHEN coalesce(round(spent, 2), 0) > 1000 THEN 'SKIPPED_DEADLINE' ELSE 'RUN' END AS status FROM c")
def x23(spark: SparkSession, d: str) -> DataFrame:
    """After the budget of cost the rest is skipped, as rows."""
    spent = F.sum("value").over(Window.partitionBy("video").orderBy("t0", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return timeline(spark, d).select("event_id", F.when(F.coalesce(F.round(spent, 2), F.lit(0.0)) > 1000, "SKIPPED_DEADLINE").otherwise("RUN").alias("status"))


@query("x24_job_listing", "WITH a AS (SELECT c_custkey AS id, c_name AS name, 0 AS src FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src) AS rn FROM a) SELECT id, name FROM r WHERE rn = 1")
def x24(spark: SparkSession, d: str) -> DataFrame:
    """Memory and disk together, an id once, memory first."""
    a = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0).alias("src"))
    a = a.unionByName(load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(1).alias("src")))
    return a.groupBy("id").agg(F.min_by("name", "src").alias("name"))


@query("x25_flag_prefix", "SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: starts_with(w, 'th'))) > 0 AS has_th, starts_with(source, 'src1') AS early FROM documents")
def x25(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.exists(F.split("text", " "), lambda w: F.startswith(w, F.lit("th"))).alias("has_th"), F.startswith("source", F.lit("src1")).alias("early"))
