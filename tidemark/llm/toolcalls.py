"""Op 2 [native]: linking tool calls to their results, in topological order, as canonical JSON.

Calls and results meet in a hash join by (conversation, call id). Arguments are parsed as variants and
checked against the tool's schema; their canonical JSON has sorted keys and no spaces. A call may name
earlier calls whose results it uses; levels of the dependency graph come from rounds over the unresolved
calls only, in which a call that waits for one other is skipped by those that wait for it: a chain of n calls
takes about log2(n) rounds. Calls are then numbered by level. Nothing is collected: a conversation of any
length is just rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: tool -> argument -> (variant type, required)
Schemas = dict[str, dict[str, tuple[str, bool]]]

SCHEMAS: Schemas = {
    "note": {"after": ("ARRAY", False), "body": ("STRING", True)},
    "search": {"after": ("ARRAY", False), "limit": ("BIGINT", False), "query": ("STRING", True)},
}


def _joined(parts: list[Column]) -> Column:
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def argument_errors(name: Column, parsed: Column, keys: Column, schemas: Schemas) -> Column:
    """Sorted errors `argument:missing|type|unknown` of parsed arguments; `arguments:invalid` if they are no JSON object, `tool:unknown` for an unknown tool."""
    errors = F.array(F.lit("tool:unknown"))
    for tool, arguments in sorted(schemas.items()):
        found = []
        for arg, (kind, required) in sorted(arguments.items()):
            value = F.try_variant_get(parsed, f"$.{arg}", "variant")
            has = F.array_contains(keys, arg)
            said = F.when(has & ~F.schema_of_variant(value).startswith(kind), f"{arg}:type")
            found.append(said.when(~has, f"{arg}:missing") if required else said)
        known = F.array(*(F.lit(a) for a in arguments)) if arguments else F.array().cast("array<string>")
        unknown = F.transform(F.array_except(keys, known), lambda k: F.concat(k, F.lit(":unknown")))
        errors = F.when(name == tool, F.array_sort(F.concat(_joined(found), unknown))).otherwise(errors)
    return F.when(parsed.isNull() | keys.isNull(), F.array(F.lit("arguments:invalid"))).otherwise(errors)


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, call_id, level of each call: 0 without dependencies, else one more than the highest it needs.

    Calls on a cycle, or that need one, have level null. Every waiting call has edges (needs, far): its level is
    the greatest of `base` and, over them, that of `needs` plus `far`. In a round an edge to a call that is done
    goes into the base; then an edge to a call y with a single edge left becomes that edge of y, with the sum of
    both distances, so distances double. A distance beyond the number of calls can only come from a cycle. Each
    round is written to spark.checkpoint.dir.
    """
    key = ["conv_id", "call_id"]
    n = calls.count()
    none = F.lit(0).cast("long")
    waiting = edges.select(*key, "needs", F.lit(1).cast("long").alias("far"), none.alias("base")).distinct().checkpoint()
    level = calls.select(*key).join(waiting.select(*key).distinct(), key, "left_anti").withColumn("level", none).checkpoint()
    done, before = [level], None
    while True:
        now = waiting.agg(F.count("*"), F.sum(F.xxhash64(*key, "needs", "far", "base").cast("decimal(38,0)"))).first()
        if not now[0] or now == before:  # all done, or what is left waits for a cycle
            break
        before = now
        met = waiting.join(level.select("conv_id", F.col("call_id").alias("needs"), "level"), ["conv_id", "needs"], "left")
        base = F.greatest("base", F.coalesce(F.col("level") + F.col("far"), none))
        met = met.select(*key, F.when(F.col("level").isNull(), F.col("needs")).alias("needs"), "far", base.alias("base"))
        met = met.groupBy(*key, "needs").agg(F.max("far").alias("far"), F.max("base").alias("base")).checkpoint()
        left = F.when(F.col("needs").isNotNull(), F.col("far"))
        per = met.groupBy(*key).agg(F.max("base").alias("base"), F.count("needs").alias("left"), F.max(left).alias("longest"), F.min("needs").alias("to"))
        per = per.filter((F.col("left") == 0) | (F.col("longest") <= n)).checkpoint()  # the others are on a cycle or wait for one
        # an edge that is left leads to a call that waits, or to one that is done as of now and is met in the next round
        level = per.filter("left = 0").select(*key, F.col("base").alias("level"))
        done.append(level)
        skip = per.filter("left = 1").select("conv_id", F.col("call_id").alias("needs"), "to", F.col("longest").alias("more"), F.col("base").alias("skipped"))
        edge = met.filter("needs is not null").drop("base").join(per.filter("left > 0").select(*key, "base"), key)
        edge = edge.join(skip, ["conv_id", "needs"], "left")
        base = F.greatest("base", F.coalesce(F.col("skipped") + F.col("far"), none))
        waiting = edge.select(*key, F.coalesce("to", "needs").alias("needs"), (F.col("far") + F.coalesce("more", none)).alias("far"), base.alias("base")).checkpoint()
    every = reduce(DataFrame.unionByName, done).select(*key, F.col("level").cast("int").alias("level"))
    return calls.select(*key).join(every, key, "left")


def positions(rows: DataFrame) -> DataFrame:
    """rows with position: the number of a call in its conversation, from 1, by level, turn and call_id; null where level is.

    All rows are range-sorted by conversation and those, so one conversation may lie in many tasks; what lies before a
    task's rows of a conversation is added from the counts of the tasks before.
    """
    order = ["conv_id", "level", "turn", "call_id"]
    called = rows.filter("level is not null")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    put = called.repartitionByRange(n, *order).sortWithinPartitions(*order)
    put = put.withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    per = put.groupBy("conv_id", "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("conv_id", "_task", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = put.join(per, ["conv_id", "_task"]).withColumn("position", F.col("_at") - F.col("_first") + F.col("_before") + 1)
    return placed.select(*rows.columns, "position").unionByName(rows.filter("level is null").withColumn("position", F.lit(None).cast("long")))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """A row for each call id and each orphan result, with its level, its position in topological order and its canonical record.

    calls: conv_id, turn, call_id, name, arguments (JSON text), needs (array of call ids).
    results: conv_id, call_id, content. Repeated call ids in one conversation: the call of the least
    (turn, name, arguments) stays and `repeats` counts the others; of repeated results the least content
    stays. A null call id links with nothing and is left out; a null content is a null result. needs that
    name no call of the conversation are errors (`needs:dangling`) and don't count for the order, as
    don't calls that need themselves.
    """
    key = ["conv_id", "call_id"]
    own = calls.filter(F.col("call_id").isNotNull()).groupBy(*key).agg(
        F.min(F.struct("turn", "name", "arguments", "needs")).alias("c"), (F.count("*") - 1).alias("repeats")
    )
    own = own.select(*key, "c.*", "repeats").checkpoint()
    got = results.filter(F.col("call_id").isNotNull()).groupBy(*key).agg(F.min("content").alias("content"), F.lit(True).alias("answered"))
    asked = own.select(*key, F.explode("needs").alias("needs")).filter("needs <> call_id").distinct()
    there = own.select("conv_id", F.col("call_id").alias("needs")).withColumn("there", F.lit(True))
    asked = asked.join(there, ["conv_id", "needs"], "left").checkpoint()
    level = levels(own, asked.filter("there"))
    dangling = asked.filter("there is null").select(*key).distinct().withColumn("dangling", F.lit(True))
    parsed = F.try_parse_json("arguments")
    rows = own.join(level, key, "left").join(dangling, key, "left").join(got, key, "full_outer")
    rows = rows.withColumn("parsed", parsed).withColumn("keys", F.json_object_keys("arguments"))
    orphan = F.col("turn").isNull() & F.col("name").isNull() & F.col("repeats").isNull()
    errors = F.concat(
        argument_errors(F.col("name"), F.col("parsed"), F.col("keys"), schemas),
        _joined([F.when(F.col("dangling"), "needs:dangling"), F.when(F.col("answered").isNull(), "result:missing"), F.when(F.col("level").isNull(), "needs:cycle")]),
    )
    errors = F.when(orphan, F.array(F.lit("call:missing"))).otherwise(errors)
    record = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("parsed"), F.lit("null")),
        F.lit(',"call_id":'), _string("call_id"),
        F.lit(',"errors":'), F.to_json(errors),
        F.lit(',"name":'), _string("name"),
        F.lit(',"result":'), _string("content"), F.lit("}"),
    )
    rows = rows.select("conv_id", "call_id", "turn", "level", "repeats", F.size(errors).alias("n_errors"), record.alias("record"))
    return positions(rows)


def _string(column: str) -> Column:
    """A string column as JSON: to_json has no bare strings, so an array of one is taken apart."""
    text = F.to_json(F.array(F.col(column)))
    return F.when(F.col(column).isNull(), "null").otherwise(F.substring(text, F.lit(2), F.length(text) - 2))


def from_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made of chat turns, for want of a table of tool calls.

    Every assistant turn is a call `c<conv>-<turn>`, every user turn the result of the call one turn
    before. The tool, the arguments and what is wrong with them follow from the length of the text; the
    text itself is an argument or a result, whole.
    """
    call = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    n, turn = F.length(F.coalesce("text", F.lit(""))), F.col("turn")
    name = F.when(n % 3 == 0, "search").otherwise("note")
    needs = F.array_compact(F.array(F.when(n % 2 == 0, call(turn - 2)), F.when(n % 7 == 3, call(turn - 4))))
    main = F.when(n % 3 == 0, "query").otherwise("body")
    text = F.to_json(F.array(F.coalesce("text", F.lit(""))))
    parts = F.array_compact(
        F.array(
            F.when(n % 13 != 0, F.concat(F.lit('"'), main, F.lit('": '), F.substring(text, F.lit(2), F.length(text) - 2))),
            F.when(n % 3 == 0, F.concat(F.lit('"limit": '), F.when(n % 5 == 0, F.lit('"all"')).otherwise((n % 50).cast("string")))),
            F.when(n % 11 == 0, F.lit('"extra": true')),
            F.concat(F.lit('"after": '), F.to_json(needs)),
        )
    )
    calls = rows.filter("role = 'assistant'").select("conv_id", "turn", call(turn).alias("call_id"), name.alias("name"), F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}")).alias("arguments"), needs.alias("needs"))
    results = rows.filter("role = 'user'").select("conv_id", call(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = from_conversations(table(spark, sf_dir, "conversations"))
    return link(calls, results, SCHEMAS)


OP2_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, text, length(coalesce(text, '')) AS n,
    'c' || CAST(conv_id AS VARCHAR) || '-' AS p FROM conversations
), own0 AS (
  SELECT conv_id, turn, p || CAST(turn AS VARCHAR) AS call_id, coalesce(text, '') AS text, n,
    CASE WHEN n % 3 = 0 THEN 'search' ELSE 'note' END AS name,
    list_filter([CASE WHEN n % 2 = 0 THEN p || CAST(turn - 2 AS VARCHAR) END, CASE WHEN n % 7 = 3 THEN p || CAST(turn - 4 AS VARCHAR) END], lambda x: x IS NOT NULL) AS needs
  FROM t WHERE role = 'assistant'
), own1 AS (
  SELECT *, '{' || array_to_string(list_filter([
      '"after":' || CAST(to_json(needs) AS VARCHAR),
      CASE WHEN n % 13 <> 0 AND name = 'note' THEN '"body":' || CAST(to_json(text) AS VARCHAR) END,
      CASE WHEN n % 11 = 0 THEN '"extra":true' END,
      CASE WHEN name = 'search' THEN '"limit":' || CASE WHEN n % 5 = 0 THEN '"all"' ELSE CAST(n % 50 AS VARCHAR) END END,
      CASE WHEN n % 13 <> 0 AND name = 'search' THEN '"query":' || CAST(to_json(text) AS VARCHAR) END
    ], lambda x: x IS NOT NULL), ',') || '}' AS arguments
  FROM own0
), own AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, name, arguments) AS rn,
      count(*) OVER (PARTITION BY conv_id, call_id) - 1 AS repeats FROM own1
  ) WHERE rn = 1
), got AS (
  SELECT conv_id, p || CAST(turn - 1 AS VARCHAR) AS call_id, min(text) AS content FROM t WHERE role = 'user' GROUP BY ALL
), asked AS (
  SELECT DISTINCT conv_id, call_id, needs FROM (SELECT conv_id, call_id, unnest(needs) AS needs FROM own)
), edges AS (
  SELECT a.conv_id, a.call_id, a.needs FROM asked a JOIN own o ON o.conv_id = a.conv_id AND o.call_id = a.needs
), walks AS (
  SELECT conv_id, call_id, 0 AS level FROM own
  UNION
  SELECT e.conv_id, e.call_id, w.level + 1 FROM walks w JOIN edges e ON e.conv_id = w.conv_id AND e.needs = w.call_id
), level AS (
  SELECT conv_id, call_id, max(level) AS level FROM walks GROUP BY ALL
), dangling AS (
  SELECT DISTINCT conv_id, call_id FROM asked a WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.conv_id = a.conv_id AND o.call_id = a.needs)
), r AS (
  SELECT coalesce(o.conv_id, g.conv_id) AS conv_id, coalesce(o.call_id, g.call_id) AS call_id, o.turn, l.level, o.repeats, o.arguments, o.name, g.content,
    CASE WHEN o.call_id IS NULL THEN ['call:missing'] ELSE list_filter([
      CASE WHEN o.n % 13 = 0 AND o.name = 'note' THEN 'body:missing' END,
      CASE WHEN o.n % 11 = 0 THEN 'extra:unknown' END,
      CASE WHEN o.name = 'search' AND o.n % 5 = 0 THEN 'limit:type' END,
      CASE WHEN o.n % 13 = 0 AND o.name = 'search' THEN 'query:missing' END,
      CASE WHEN d.call_id IS NOT NULL THEN 'needs:dangling' END,
      CASE WHEN g.call_id IS NULL THEN 'result:missing' END], lambda x: x IS NOT NULL) END AS errors
  FROM own o JOIN level l ON l.conv_id = o.conv_id AND l.call_id = o.call_id
  LEFT JOIN dangling d ON d.conv_id = o.conv_id AND d.call_id = o.call_id
  FULL JOIN got g ON g.conv_id = o.conv_id AND g.call_id = o.call_id
)
SELECT conv_id, call_id, turn, CAST(level AS INTEGER) AS level, CASE WHEN level IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, level IS NULL ORDER BY level, turn, call_id) END AS position, repeats, CAST(len(errors) AS INTEGER) AS n_errors,
  '{"arguments":' || coalesce(arguments, 'null') || ',"call_id":' || CAST(to_json(call_id) AS VARCHAR)
  || ',"errors":' || CAST(to_json(errors) AS VARCHAR) || ',"name":' || coalesce(CAST(to_json(name) AS VARCHAR), 'null')
  || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS record
FROM r
"""
