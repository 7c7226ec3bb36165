"""The general relational surface, and business queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import streaming
from tidemark.registry import ORACLE, query
from tidemark.session import scratch
from tidemark.tables import load


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


@query("rel_pricing_summary", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.sum(cents("l_extendedprice")).alias("cents"), F.count("*").alias("n"))


@query("rel_regional_revenue", "SELECT r_name, n_name, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY ALL")
def regional(spark: SparkSession, d: str) -> DataFrame:
    """A star join over five tables."""
    o = load(spark, d, "orders").filter("o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1997-01-01'").select("o_orderkey", "o_custkey")
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = load(spark, d, "lineitem").select("l_orderkey", "l_extendedprice").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("r_name", "n_name").agg(F.sum(cents("l_extendedprice")).alias("cents"))


@query("rel_shipping_priority", "SELECT l_orderkey, o_orderdate, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY ALL ORDER BY cents DESC, l_orderkey LIMIT 10")
def shipping(spark: SparkSession, d: str) -> DataFrame:
    """A top-ten report."""
    c = load(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    li = load(spark, d, "lineitem").filter("l_shipdate > timestamp_ntz '1998-03-15'").select("l_orderkey", "l_extendedprice")
    g = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "o_orderdate").agg(F.sum(cents("l_extendedprice")).alias("cents"))
    return g.orderBy(F.desc("cents"), "l_orderkey").limit(10)


@query("rel_forecast_revenue", "SELECT CAST(sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24")
def forecast(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").filter("l_shipdate >= timestamp_ntz '1997-01-01' and l_shipdate < timestamp_ntz '1998-01-01' and l_discount between 0.045 and 0.075 and l_quantity < 24")
    return li.agg(F.sum(F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("long")).alias("cents"))


@query("rel_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return load(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("rel_anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def anti(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return load(spark, d, "part").join(li, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("rel_full_join", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal < 5000 GROUP BY 1) b ON a.k = b.k")
def full(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = load(spark, d, "supplier").filter("s_acctbal < 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full_outer")


@query("rel_domain_cross", "SELECT r_name, event_type, count(*) AS n FROM region CROSS JOIN (SELECT DISTINCT event_type FROM events) GROUP BY ALL")
def cross(spark: SparkSession, d: str) -> DataFrame:
    """The grid of two small domains."""
    return load(spark, d, "region").crossJoin(load(spark, d, "events").select("event_type").distinct()).groupBy("r_name", "event_type").agg(F.count("*").alias("n"))


@query("rel_grouping_sets", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, grouping_id(l_returnflag, l_linestatus, l_linenumber) AS gid FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    return load(spark, d, "lineitem").groupingSets([[a, b], [c], []], a, b, c).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))


@query("rel_rollup_cube", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.round("o_totalprice").cast("long")).alias("total"))


@query("rel_ranking_windows", "SELECT o_orderkey, rank() OVER w AS rnk, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS quart, round_even(percent_rank() OVER w, 6) AS pr, round_even(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def ranks(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return load(spark, d, "orders").select("o_orderkey", F.rank().over(w).alias("rnk"), F.dense_rank().over(w).alias("dense"), F.ntile(4).over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")).alias("quart"), F.bround(F.percent_rank().over(w), 6).alias("pr"), F.bround(F.cume_dist().over(w), 6).alias("cd"))


@query("rel_analytic_windows", "SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id, 2) OVER w AS next2, first_value(event_id) OVER w AS first_id, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS near FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def analytic(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    full_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return load(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("prev"), F.lead("event_id", 2).over(w).alias("next2"), F.first("event_id").over(w).alias("first_id"), F.nth_value("event_id", 2).over(full_).alias("second_id"), F.count("*").over(w.rowsBetween(-3, 1)).alias("near"))


@query("rel_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS day_count FROM events")
def range_frame(spark: SparkSession, d: str) -> DataFrame:
    """Events of the same user in the day up to each one."""
    s = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    return load(spark, d, "events").withColumn("s", s).select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-86400, 0)).alias("day_count"))


@query("rel_set_operations", "SELECT 'both' AS side, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT 'left', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def sets(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    b = load(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("side"), "k").unionByName(a.exceptAll(b.distinct()).join(b, "k", "left_anti").distinct().select(F.lit("left").alias("side"), "k"))


@query("rel_pivot", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id")
def pivot(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view", "error"]).agg(F.count("event_id")).fillna(0)


@query("rel_unpivot", "SELECT p_partkey, 'p_size' AS k, CAST(p_size AS BIGINT) AS v FROM part UNION ALL SELECT p_partkey, 'cents', CAST(round(p_retailprice * 100) AS BIGINT) FROM part")
def unpivot(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"), cents("p_retailprice").alias("cents"))
    return p.unpivot("p_partkey", ["p_size", "cents"], "k", "v")


@query("rel_json_access", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') IS NULL AS missing, len(json_keys(props)) AS n_keys FROM events")
def json_access(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").withColumn("v", F.parse_json("props"))
    return e.select("event_id", F.variant_get("v", "$.k", "int").alias("k"), F.get_json_object("props", "$.none").isNull().alias("missing"), F.size(F.json_object_keys("props")).alias("n_keys"))


@query("rel_map_functions", "SELECT user_id, max(n) AS most, arg_max(event_type, (n, event_type)) AS top, count(*) AS kinds FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def maps(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type as a map, and what it answers."""
    c = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    best = F.array_max(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("k"))))
    return c.select("user_id", best["n"].alias("most"), best["k"].alias("top"), F.size("m").cast("long").alias("kinds"))


@query("rel_distinct_aggregates", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT json_extract_string(props, '$.k')) AS ks, median(value) AS med, mode(user_id % 3) IS NOT NULL AS has_mode FROM events GROUP BY event_type")
def distinct_aggs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.get_json_object("props", "$.k")).alias("ks"), F.median("value").alias("med"), F.mode(F.col("user_id") % 3).isNotNull().alias("has_mode"))


@query("rel_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "orders").createOrReplaceTempView("tidemark_orders")
    return spark.sql("SELECT o_orderkey FROM tidemark_orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM tidemark_orders)")


@query("rel_recursive_cte", "WITH RECURSIVE r AS (SELECT 1 AS n, CAST(1 AS BIGINT) AS f UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
def recursive(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("WITH RECURSIVE r(n, f) AS (SELECT 1, 1L UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")


@query("rel_asof_join", "SELECT p.event_id, v.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def asof(spark: SparkSession, d: str) -> DataFrame:
    """The last view before each purchase, in one sort of both."""
    e = load(spark, d, "events").filter("event_type in ('purchase', 'view')")
    w = Window.partitionBy("user_id").orderBy("ts", F.desc("event_type")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), True).over(w)
    return e.withColumn("last_view", last).filter("event_type = 'purchase'").select("event_id", "last_view")


@query("stream_tumbling", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS w, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.unix_seconds("w.start").alias("w"), "event_type", "n")


@query("stream_sliding", "WITH b AS (SELECT epoch_us(ts) // 1000000 AS s FROM events), w AS (SELECT unnest(range((s // 900) * 900 - 2700, (s // 900) * 900 + 1, 900)) AS w FROM b) SELECT w, count(*) AS n FROM w GROUP BY w")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.unix_seconds("w.start").alias("w"), "n")


@query("stream_session", "WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nw FROM events), i AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT user_id, epoch_us(min(ts)) // 1000000 AS began, epoch_us(max(ts)) // 1000000 AS ended, count(*) AS n FROM i GROUP BY user_id, s")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with gaps of at most six hours; the end is the last event's."""
    e = load(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n"))
    return g.select("user_id", F.unix_seconds("a").alias("began"), F.unix_seconds("b").alias("ended"), "n")


def live(spark: SparkSession, d: str) -> DataFrame:
    """The events file as a stream."""
    return streaming.events_stream(spark, d, load(spark, d, "events").schema, only="events.parquet")


@query("stream_live_tumbling", ORACLE["stream_tumbling"])
def live_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The tumbling windows as Structured Streaming computes them, in complete mode."""
    return streaming.completed(streaming.tumbling_windows(live(spark, d)), scratch(spark, "out"), scratch(spark, "state"))


@query("stream_live_sessions", ORACLE["stream_session"])
def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The sessions as Structured Streaming computes them, in complete mode."""
    return streaming.completed(streaming.session_windows(live(spark, d)), scratch(spark, "out"), scratch(spark, "state"))
