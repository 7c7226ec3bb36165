"""Op 11: a trie of conversation prefixes, by partition refinement.

A node is the class of all conversations that begin with the same turns. All conversations start in one class;
each round splits the classes that are still active, turn by turn, over a run of further turns. A conversation that
is alone in its class retires: the rest of it is a unary chain, which needs no grouping. What subtrees hold is then
folded back from the last round to the first. Runs double from round to round, up to LONGEST turns, so
conversations that share n turns take about log2(n) rounds, and n / LONGEST beyond.

A class is named by two 64-bit polynomial hashes of its turns, a node by (least member, depth). Turns are
range-sorted, so one conversation may lie in many tasks: each task gives running figures, to which one row a task
adds what the tasks before it hold of its first conversation. All exchanges of classes are aggregations that
combine before the shuffle, or equi-joins against one row a class.

Rows without conv_id belong to no conversation and are left out; a null role or text is an empty one; turns are
ordered by turn (null first), ties by the hash of role and text, then by length; a repeated row is a turn of its own.
An empty table has no node, not even the root. Further columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ranges, table, written

#: Turns of each conversation that the first round reads, and the most that a round reads.
FIRST, LONGEST = 8, 4096
#: Ids of one class that are joined before they are hashed.
PIECE = 50_000
#: Odd multipliers of the two polynomial hashes.
_BASES = (np.uint64(0x9E3779B97F4A7C17), np.uint64(0xC2B2AE3D27D4EB4B))
NONE_SHA256 = hashlib.sha256(b"").hexdigest()
_CLASS = ["depth", "k1", "k2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, h1, h2 (hash of role and text), n_bytes (of text): a row a turn."""
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    return conversations.filter("conv_id is not null").select("conv_id", "turn", *_hashes(), n_bytes)


def _hashes() -> list[Column]:
    """h1, h2: the halves of the md5 of role and text, the role's length before them."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return [F.conv(F.substring(said, at, 16), 16, -10).cast("long").alias(h) for h, at in (("h1", 1), ("h2", 17))]


def _powers(base: np.uint64, of: np.ndarray) -> np.ndarray:
    """base to the power of each of `of`, modulo 2^64."""
    out, square, left = np.ones(len(of), np.uint64), base, of.copy()
    with np.errstate(over="ignore"):
        while left.any():
            out = np.where(left & 1, out * square, out)
            square, left = square * square, left >> 1
    return out


def _running(x: np.ndarray, starts: np.ndarray, carried) -> np.ndarray:
    """Running sums of x that begin anew at each of `starts`; rows before the first start go on from carried."""
    with np.errstate(over="ignore"):
        sums = np.add.accumulate(x)
        base = np.zeros(len(x), x.dtype)
        if len(starts):
            base[starts[0] :] = np.repeat(np.where(starts > 0, sums[starts - 1], x.dtype.type(0)), np.diff(np.append(starts, len(x))))
        out = sums - base
        out[: starts[0] if len(starts) else len(x)] += carried
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and hashes of each row within its conversation's rows of a sorted task; last: its last row there."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    conv, at, sums = None, np.int64(0), [np.uint64(0), np.uint64(0)]
    held = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        new = np.append(conv is None or ids[0] != conv, ids[1:] != ids[:-1])
        starts = np.flatnonzero(new)
        place = _running(np.ones(n, np.int64), starts, at)
        halves = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (1, 2)]
        with np.errstate(over="ignore"):
            hashes = [_running(h * _powers(b, place), starts, s) for h, b, s in zip(halves, _BASES, sums, strict=True)]
        conv, at, sums = ids[-1], place[-1], [s[-1] for s in hashes]
        if held is not None:
            yield _ended(held, new[0])
        held = [*batch.columns, pa.array(np.full(n, task, np.int32)), pa.array(place), *(pa.array(s.view(np.int64)) for s in hashes)], new
    if held is not None:
        yield _ended(held, True)


def _ended(held: tuple[list[pa.Array], np.ndarray], end: bool) -> pa.RecordBatch:
    columns, new = held
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.append(new[1:], end))], ["conv_id", "h1", "h2", "n_bytes", "task", "at", "s1", "s2", "last"])


def placed(spark: SparkSession, rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (conv_id, h1, h2, n_bytes) with depth (place in the conversation by `order`, from 1), k1, k2 (hashes of the turns
    so far), p1, p2 (of those before) and last. Other columns go."""
    keys = ["conv_id", *order]
    put = rows.repartitionByRange(ranges(spark, None), *keys).sortWithinPartitions(*keys).select("conv_id", "h1", "h2", "n_bytes")
    run = written(spark, put.mapInArrow(_runs, "conv_id long, h1 long, h2 long, n_bytes long, task int, at long, s1 long, s2 long, last boolean"), "turns")
    ends = run.groupBy("task").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "at", "s1", "s2")).alias("end")).orderBy("task").collect()  # a row a task
    before: dict[int, tuple] = {}
    going: set[int] = set()
    conv, at, sums = None, 0, [0, 0]
    for i, e in enumerate(ends):
        if e.first == conv:
            before[e.task] = (conv, at, *sums)
            going.add(ends[i - 1].task)
        own = [e.end.s1 % 2**64, e.end.s2 % 2**64]
        if e.first == conv == e.end.conv_id:
            sums = [(s + pow(int(b), at, 2**64) * o) % 2**64 for s, b, o in zip(sums, _BASES, own, strict=True)]
            at += e.end.at
        else:
            conv, at, sums = e.end.conv_id, e.end.at, own

    final = {e.task: (e.end.conv_id, e.end.at) for e in ends}

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            ids, depth, last = get["conv_id"], get["at"].copy(), get["last"].copy()
            hashes = [get[c].view(np.uint64).copy() for c in ("s1", "s2")]
            with np.errstate(over="ignore"):
                for t in np.unique(get["task"]).tolist():
                    if t in going:
                        last[(get["task"] == t) & (ids == final[t][0]) & (get["at"] == final[t][1])] = False
                    if t in before:
                        c, more, *pre = before[t]
                        mine = (get["task"] == t) & (ids == c)
                        depth[mine] += more
                        for s, b, x in zip(hashes, _BASES, pre, strict=True):
                            s[mine] = s[mine] * np.uint64(pow(int(b), more, 2**64)) + np.uint64(x)
                earlier = [s - get[c].view(np.uint64) * _powers(b, depth) for s, c, b in zip(hashes, ("h1", "h2"), _BASES, strict=True)]
            out = [ids, get["h1"], get["h2"], get["n_bytes"], depth, *(x.view(np.int64) for x in (*hashes, *earlier)), last]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["conv_id", "h1", "h2", "n_bytes", "depth", "k1", "k2", "p1", "p2", "last"])

    return run.mapInArrow(joined, "conv_id long, h1 long, h2 long, n_bytes long, depth long, k1 long, k2 long, p1 long, p2 long, last boolean")


def _classes(rows: DataFrame) -> DataFrame:
    """A row for each class: its members, the least of them, whether that one ends here, and its last turn."""
    same = [F.max(c).alias(c) for c in ("p1", "p2", "h1", "h2", "n_bytes")]  # equal in all members
    return rows.groupBy(*_CLASS).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min_by("last", "conv_id").alias("last"), F.count_if("last").alias("n_ends"), *same)


def refine(spark: SparkSession, turns: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """(rows, classes) of each round, and the unary tails of conversations that retired before their last turns.

    turns: what `placed` gives. A round reads the next turns of active conversations only.
    """
    rounds, tails = [], []
    rest, end, run = turns, 0, FIRST
    while True:
        end += run
        rows = rest.filter(F.col("depth") <= end)
        classes = written(spark, _classes(rows), "classes")
        rounds.append((rows, classes))
        beyond = rest.filter(F.col("depth") > end)
        if beyond.isEmpty():
            break
        alone = classes.filter((F.col("depth") == end) & (F.col("n_convs") == 1)).select("conv_id")
        active = written(spark, rows.filter((F.col("depth") == end) & ~F.col("last")).select("conv_id").join(alone, "conv_id", "left_anti"), "active")
        if active.isEmpty():
            tails.append(beyond)
            break
        tails.append(beyond.join(active, "conv_id", "left_anti"))
        rest, run = written(spark, beyond.join(active, "conv_id", "left_semi"), "rest"), min(2 * run, LONGEST)
    return rounds, reduce(DataFrame.unionByName, tails) if tails else turns.limit(0)


def _digests(spark: SparkSession, ends: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of the classes' conv_ids: a task joins stretches of ids, then a class's stretches are hashed in order as a stream."""
    names = [*_CLASS, "part", "ids"]
    schema = "depth long, k1 long, k2 long, part long, ids string"

    def stretches(batches):
        from pyspark import TaskContext

        part, key, ids, out = TaskContext.get().partitionId() << 32, None, [], []
        for batch in batches:
            for *k, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key or len(ids) >= PIECE:
                    if ids:
                        out.append([*key, part, ",".join(map(str, ids))])
                    key, ids, part = k, [], part + 1
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, part, ",".join(map(str, ids)))], names)

    def hashed(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for *k, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if sha:
                        out.append([*key, sha.hexdigest()])
                    key, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*_CLASS, "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], [*_CLASS, "ends_sha256"])

    keys = [*_CLASS, "conv_id"]
    sorted_ = ends.select(*keys).repartitionByRange(ranges(spark, None), *keys).sortWithinPartitions(*keys)
    pieces = written(spark, sorted_.mapInArrow(stretches, schema), "ends")
    return pieces.repartition(*_CLASS).sortWithinPartitions(*_CLASS, "part").mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def fold(spark: SparkSession, rounds: list[tuple[DataFrame, DataFrame]], children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(depth, k1, k2, n_leaves, saved_tokens of each class; conv_id, leaves, saved of each conversation), from the last round to the first.

    A node belongs to its least member. Of a class's members all but the least own nodes only below it, and the least
    one those of a stretch of depths, so a subtree holds what its members own from this round on, without what the
    least one owns earlier in this round.
    """
    later, out = None, []
    for rows, classes in reversed(rounds):
        counted = classes.join(children, _CLASS, "left").withColumn("end", F.max("depth").over(Window.partitionBy("conv_id")))
        # alone, it ends in a leaf here or in its tail; its last node of this round stands for that
        leaf = F.when(F.col("n_convs") == 1, F.col("depth") == F.col("end")).otherwise(F.col("n_children").isNull())
        own = counted.select(*_CLASS, "conv_id", leaf.cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
        before = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
        own = written(spark, own.withColumn("above", F.coalesce(F.sum("saved").over(before), F.lit(0))), "own")
        sums = own.select("conv_id", "leaves", "saved")
        sums = (sums if later is None else sums.unionByName(later)).groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        later = written(spark, sums, "later")
        held = rows.select(*_CLASS, "conv_id").join(later, "conv_id").groupBy(*_CLASS).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        shared = own.join(classes.filter("n_convs > 1").select(*_CLASS), _CLASS, "left_semi")
        out.append(shared.select(*_CLASS, "above").join(held, _CLASS).select(*_CLASS, "n_leaves", (F.col("saved") - F.col("above")).alias("saved_tokens")))
    return reduce(DataFrame.unionByName, out), later


def build(spark: SparkSession, turns: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the trie of `turns` (as `placed` gives them), root included.

    members: conv_id of all conversations, each once, those without turns included. Columns: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and h1, h2, the hash of the node's last
    turn (`texts` gives its role and text).
    """
    members = written(spark, members, "members")
    top = members.agg(F.min("conv_id"), F.count("*")).first()
    rounds, tails = refine(spark, turns)
    classes = reduce(DataFrame.unionByName, (c for _, c in rounds))
    shared = classes.filter("n_convs > 1")
    children = written(spark, classes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children")), "children")
    totals, owned = fold(spark, rounds, children)
    ended = reduce(DataFrame.unionByName, (r.filter("last").select(*_CLASS, "conv_id") for r, _ in rounds))
    ended = ended.join(shared.filter("n_ends > 0").select(*_CLASS), _CLASS, "left_semi")
    none = F.lit(0).cast("long")
    turnless = members.join(turns.filter("depth = 1").select("conv_id"), "conv_id", "left_anti").select(none.alias("depth"), none.alias("k1"), none.alias("k2"), "conv_id")
    digests = written(spark, _digests(spark, ended.unionByName(turnless)), "digests")

    parent = shared.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    up = F.when(F.col("depth") == 1, F.lit(top[0])).otherwise(F.coalesce("parent_conv_id", "conv_id"))
    nodes = classes.join(parent, ["depth", "p1", "p2"], "left").withColumn("parent_conv_id", up)
    last = lambda is_: F.when(is_, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NONE_SHA256))
    keep = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "h1", "h2"]
    one = F.lit(1).cast("long")
    chain = lambda df: df.select(
        "conv_id", "depth", "parent_conv_id", one.alias("n_convs"), F.when(F.col("last"), none).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"), last(F.col("last")).alias("ends_sha256"), "h1", "h2",
    )
    many = nodes.filter("n_convs > 1").join(children, _CLASS, "left").join(totals, _CLASS, "left").join(digests, _CLASS, "left")
    many = many.withColumns({"n_children": F.coalesce("n_children", none), "ends_sha256": F.coalesce("ends_sha256", F.lit(NONE_SHA256))})
    root = owned.agg(F.coalesce(F.sum("leaves"), one).alias("n_leaves"), F.coalesce(F.sum("saved"), none).alias("saved_tokens"))
    root = root.join(children.filter("depth = 0").agg(F.coalesce(F.sum("n_children"), none).alias("n_children")))  # one row each
    root = root.join(digests.filter("depth = 0").agg(F.coalesce(F.max("ends_sha256"), F.lit(NONE_SHA256)).alias("ends_sha256"))).filter(F.lit(top[1] > 0))
    null = F.lit(None).cast("long")
    root = root.select(F.lit(top[0]).cast("long").alias("conv_id"), none.alias("depth"), null.alias("parent_conv_id"), F.lit(top[1]).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256", null.alias("h1"), null.alias("h2"))
    return root.unionByName(many.select(*keep)).unionByName(chain(nodes.filter("n_convs = 1"))).unionByName(chain(tails.withColumn("parent_conv_id", F.col("conv_id"))))


def texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """nodes with the role and the text of each node's last turn (null for the root)."""
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = conversations.select(*_hashes(), said.alias("said")).groupBy("h1", "h2").agg(F.first("said").alias("said"))
    return nodes.join(hashed, ["h1", "h2"], "left").select(*nodes.columns, "said.role", "said.text")


def rebuilt(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """conv_id, part, depth, h1, h2, n_bytes: conversation c takes the first h turns of conversation c - c % 5, then its own after its first h; h is crc32(c) % 9."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = turns.filter("depth = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    heads = turns.filter("depth <= 8").select(F.col("conv_id").alias("base"), "depth", "h1", "h2", "n_bytes")
    heads = heads.join(convs, "base").filter("depth <= h").select("conv_id", F.lit(0).alias("part"), "depth", "h1", "h2", "n_bytes")
    return heads.unionByName(turns.filter(F.col("depth") > h).select("conv_id", F.lit(1).alias("part"), "depth", "h1", "h2", "n_bytes"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = placed(spark, turns_of(table(spark, sf_dir, "conversations")), ["turn", "h1", "h2", "n_bytes"])
    again = placed(spark, rebuilt(spark, turns), ["part", "depth"])
    return build(spark, again, turns.filter("depth = 1").select("conv_id")).drop("h1", "h2")


#: Prefixes as md5 chains; what a subtree holds, by the nodes on the way of each member.
OP11_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT DISTINCT conv_id FROM t
), crc0 AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM ids
  UNION ALL
  SELECT conv_id, s, i + 1, {bit} FROM (
    SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(c, CAST(ord(s[CAST(i // 8 + 1 AS INTEGER)]) AS BIGINT)) ELSE c END AS c FROM crc0 WHERE i < 8 * length(s)
  )
), h AS (
  SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM crc0 WHERE i = 8 * length(s)
), r AS (
  SELECT h.conv_id, row_number() OVER (PARTITION BY h.conv_id ORDER BY part, pos) AS d, role, text
  FROM (
    SELECT h.conv_id, 0 AS part, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 AND t.pos <= h.h
    UNION ALL
    SELECT h.conv_id, 1, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h
  ) x JOIN h USING (conv_id)
), k AS (
  SELECT conv_id, d, strlen(text) AS n_bytes,
    md5(string_agg(md5(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS node,
    count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM r
  UNION ALL
  SELECT h.conv_id, 0, 0, '', (SELECT count(*) FROM r WHERE r.conv_id = h.conv_id) FROM h
), nodes AS (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = n_turns), '')) AS ends_sha256
  FROM k GROUP BY d, node
), up AS (
  SELECT n.*, b.node AS parent, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN k b ON b.conv_id = n.conv_id AND b.d = n.d - 1 LEFT JOIN nodes p ON p.d = b.d AND p.node = b.node
), c AS (
  SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM up WHERE d > 0 GROUP BY ALL
), full_ AS (
  SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN c USING (d, node)
), below AS (
  SELECT a.d, a.node, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.n_bytes) AS saved_tokens
  FROM full_ f JOIN k a ON a.conv_id = f.conv_id AND a.d <= f.d GROUP BY ALL
)
SELECT f.conv_id, f.d AS depth, f.parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_ f JOIN below USING (d, node)
""".replace("{bit}", "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END")
