"""Op 10: exact top-k inner products by a ball tree in each shard, with branch and bound.

Candidates are range-sorted along a Hilbert curve through three projections and cut into shards of bounded
size, so that a shard's balls are small; each shard builds a ball tree. Queries lie in files of the shared
folder, a block in each, and stream past every tree, so neither side is ever held whole. A query descends
from the root, into the child of the greater upper bound q.c + |q| r first, and enters no node whose bound is
below its current kth score. Shards share that score: the first wave searches each block in one shard, the
second in an eighth of the others, the third in the rest, and between waves every block's kth scores are
raised to the best found so far.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import filesystem, shared_dir, table, written
from tidemark.llm.packing import BITS, hilbert, projection

SHARD, BLOCK, LEAF = 8192, 1024, 64
FOUND = "block long, at long, query_id long, vec_id long, score long"


class BallTree:
    """Center, radius and either two children or the rows (at most LEAF, or equal ones) of every node."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors = ids, vectors
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        centers, radii = [], []
        stack: list[tuple[np.ndarray, int]] = [(np.arange(len(ids)), -1)]
        while stack:
            rows, parent = stack.pop()
            v = vectors[rows]
            center = v.mean(0)
            node = len(centers)
            centers.append(center)
            radii.append(float(np.sqrt(((v - center) ** 2).sum(1).max())))
            self.children.append(None)
            self.rows.append(None)
            if parent >= 0:
                self.children[parent] = (*(self.children[parent] or ()), node)
            if len(rows) <= leaf or not radii[-1]:
                self.rows[node] = rows
                continue
            a = v[((v - center) ** 2).sum(1).argmax()]  # the row farthest out, and the one farthest from it
            b = v[((v - a) ** 2).sum(1).argmax()]
            order = np.argsort(v @ (b - a), kind="stable")
            half = len(rows) // 2
            stack += [(rows[order[:half]], node), (rows[order[half:]], node)]
        self.centers, self.radii = np.array(centers), np.array(radii)
        self.sizes = np.sqrt((self.centers**2).sum(1))

    def search(self, qids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of each query's best k rows among those that reach its floor (others: -inf)."""
        n = len(qids)
        top, who = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        norms = np.sqrt((queries**2).sum(1))
        self.entered = 0

        def bound(node: int, q: np.ndarray) -> np.ndarray:
            """Rounded up."""
            ub = queries[q] @ self.centers[node] + norms[q] * self.radii[node]
            return ub + 1e-6 * (1 + np.abs(ub) + norms[q] * self.sizes[node])

        def least(q: np.ndarray) -> np.ndarray:
            return np.maximum(top[q, k - 1], floor[q])

        def look(rows: np.ndarray, q: np.ndarray) -> None:
            for lo in range(0, len(rows), 4096):
                ids = self.ids[rows[lo : lo + 4096]]
                got = queries[q] @ self.vectors[rows[lo : lo + 4096]].T
                got[qids[q][:, None] == ids] = -np.inf
                better = got.max(1) >= least(q)
                at, got = q[better], got[better]
                if len(at):
                    s = np.concatenate((top[at], got), axis=1)
                    w = np.concatenate((who[at], np.broadcast_to(ids, got.shape)), axis=1)
                    best = np.lexsort((w, -s), axis=1)[:, :k]
                    top[at], who[at] = np.take_along_axis(s, best, 1), np.take_along_axis(w, best, 1)

        def enter(node: int, q: np.ndarray) -> None:
            self.entered += len(q)
            if self.rows[node] is not None:
                look(self.rows[node], q)
                return
            left, right = self.children[node]
            l, r = bound(left, q), bound(right, q)
            first = l >= r
            for child, b, own in ((left, l, first), (right, r, ~first), (left, l, ~first), (right, r, first)):
                on = own & (b >= least(q))  # asked anew each time: the kth score may have risen meanwhile
                if on.any():
                    enter(child, q[on])

        q = np.arange(n)
        q = q[bound(0, q) >= floor]
        if len(q):
            enter(0, q)
        return top, who


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * component) of each component as double; rows that take no part are left out.

    Those are rows with a null id, and vectors that are null or empty or hold null, NaN or infinity.
    """
    v = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & whole)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def curve(rows: DataFrame) -> DataFrame:
    """rows with key: the place of v, scaled to length 1, on a Hilbert curve through three fixed projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.zeros(batch.num_rows, dtype=np.int64)
            dims = pc.list_value_length(batch.column(1)).to_numpy()
            for d in np.unique(dims).tolist():
                on = np.flatnonzero(dims == d)
                v = _matrix(batch.column(1).take(pa.array(on)))
                size = np.sqrt((v**2).sum(1, keepdims=True))
                at = (v / np.where(size, size, 1)) @ projection(d) * np.sqrt(d) / 3  # most lie within 3 / sqrt(d) of 0
                key[on] = hilbert(np.clip((at + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=["vec_id", "v", "key"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, key long")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates; ties go to the smaller vec_id.

    Both have vec_id and v (integers as doubles). A query doesn't meet rows of its own id, nor vectors of
    another length. Repeated candidates count as often as they are there, and a
    repeated query is answered as often. An empty side gives no rows. Sums of
    products must stay below 2**53, where doubles are exact; ValueError otherwise.
    """
    spark = queries.sparkSession
    folder = shared_dir(spark, "queries")
    n = candidates.count()
    shards = max(1, -(-n // SHARD))
    # equal vectors may fall into different shards, so copies don't crowd one
    dealt = curve(candidates).repartitionByRange(shards, "key", "vec_id", F.xxhash64("v"))
    dealt = written(spark, dealt.select("vec_id", "v", F.size("v").alias("dim"), F.spark_partition_id().alias("shard")), "shards")

    def put(fs, path: str, name: str, save, *values) -> None:
        out = io.BytesIO()
        save(out, *values)
        with fs.open_output_stream(f"{path}/{name}") as f:
            f.write(out.getvalue())

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, path = filesystem(folder)
        fs.create_dir(path)
        for i, batch in enumerate(batches):
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == d))
                for lo in range(0, some.num_rows, BLOCK):
                    part = some.slice(lo, BLOCK)
                    # an attempt's own name: a task that is run again needs to replace nothing
                    name = f"{TaskContext.get().partitionId():06d}-{i}-{d}-{lo}-{TaskContext.get().taskAttemptId()}"
                    put(fs, path, name, np.savez, part.column(0).to_numpy(), _matrix(part.column(1)))
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([d], pa.int32())], names=["name", "dim"])

    own = curve(queries).select("vec_id", "v", F.size("v").alias("dim"), "key")
    own = own.repartitionByRange(max(1, min(shards, queries.count() // BLOCK)), "key", "vec_id")  # fuller blocks, of near queries
    names = sorted((r.name, r.dim) for r in own.select("vec_id", "v", "dim").mapInArrow(save, "name string, dim int").collect())  # one for each block
    step = {0: 0} | {i: 1 if i % 8 == 1 else 2 for i in range(1, shards)}

    def wave(number: int, floors: dict[int, str]) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            shard, dim = table.column("shard")[0].as_py(), table.column("dim")[0].as_py()
            mine = [(i, name) for i, (name, d) in enumerate(names) if d == dim and step[(shard - i * shards // len(names)) % shards] == number]
            out = []
            if mine:
                tree = BallTree(table.column("vec_id").to_numpy(), np.vstack([_matrix(c) for c in table.column("v").chunks]))
                fs, path = filesystem(folder)
            for i, name in mine:
                with fs.open_input_file(f"{path}/{name}") as f:
                    block = np.load(io.BytesIO(f.read()))
                ids, v = block["arr_0"], block["arr_1"]
                if np.abs(v).max(initial=0) * np.abs(tree.vectors).max(initial=0) * dim >= 1 << 53:
                    raise ValueError("components too large for exact sums")
                floor = np.full(len(ids), -np.inf)
                if i in floors:
                    with fs.open_input_file(f"{path}/{floors[i]}") as f:
                        floor = np.load(io.BytesIO(f.read()))[: len(ids)]
                top, who = tree.search(ids, v, floor, k)
                on = top > -np.inf
                at = np.broadcast_to(np.arange(len(ids))[:, None], top.shape)
                out.append(pa.table({"block": np.full(int(on.sum()), i), "at": at[on], "query_id": np.broadcast_to(ids[:, None], top.shape)[on], "vec_id": who[on], "score": top[on].astype(np.int64)}))
            empty = pa.schema([(c, pa.int64()) for c in ("block", "at", "query_id", "vec_id", "score")]).empty_table()
            return pa.concat_tables(out) if out else empty

        return dealt.groupBy("shard", "dim").applyInArrow(run, FOUND)

    def raised(found: DataFrame) -> dict[int, str]:
        """Files of the blocks' kth scores so far."""

        def run(table: pa.Table) -> pa.Table:
            from pyspark import TaskContext

            i = table.column("block")[0].as_py()
            at, score = table.column("at").to_numpy(), table.column("score").to_numpy()
            order = np.lexsort((-score, at))
            at, score = at[order], score[order]
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            floor = np.full(BLOCK, -np.inf)
            floor[at[place == k - 1]] = score[place == k - 1]
            name = f"floor-{i}-{TaskContext.get().taskAttemptId()}"
            fs, path = filesystem(folder)
            put(fs, path, name, np.save, floor)
            return pa.table({"block": pa.array([i], pa.int64()), "name": [name]})

        return {r.block: r.name for r in found.groupBy("block").applyInArrow(run, "block long, name string").collect()}

    found = None
    for number in range(max(step.values()) + 1):
        made = wave(number, raised(found) if found is not None else {})
        made = written(spark, made, "wave") if number < max(step.values()) else made
        found = made if found is None else found.unionByName(made)
    best = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(rows.filter(F.col("vec_id") % 50 == 0), rows)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
