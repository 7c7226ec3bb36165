"""Op 4: exact join of documents on the Jaccard similarity of their word shingles, by PartEnum signatures.

Sets fall into bands of sizes; a set takes part in its own band and, if a partner there can be large
enough, in the next. In a band the feature domain is cut into parts by a hash, and similar sets differ in
at most k elements, so at most k of their projections on the parts differ. A signature is the projection on a
subset of the parts:

- k up to PAIRED: each pair of the parts is a subset, and k differences change d of them at most.
- beyond: each part is a subset (d = k), since pairs would take twice as many signatures for projections of
  the same size.

There are more subsets than d + 1. Any order of projections that both sets share makes one of the first d + 1
of each a common one, so those are enough. The order puts projections with many rare shingles first, so that a
passage or line that goes round doesn't bring its documents together, and an empty projection brings nobody
together unless it must.

Sets that share a signature are candidates. Groups of up to SMALL sets give all their pairs; of a larger
group first its star around one member is compared (within a block of texts before anything is shuffled, then
around the stars' centers). Members of large groups that then lie in more than one component meet again by
their rarest shingles: of two similar sets the larger one's rarest quarter and the smaller one's rarest seventh
share a shingle. Every candidate pair is verified on the whole sets. Copies (equal sets) count once throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WordHashes, blocks, mix, table, worker_cache, written
from tidemark.llm.graph import components

WORDS = 5
#: The similarity as a fraction.
OVER, UNDER = 3, 4
#: Ratio of the sizes in a band, and parts for each element that may differ.
BAND, PARTS = 1.8, 1.25
SMALL = 8
#: Differing elements up to which pairs of parts are enumerated.
PAIRED = 3
#: The most frequent shingles that only help to order projections; results don't depend on them.
FREQUENT = 100_000
#: Bytes of text that a task works on at once.
TEXT = 6 << 20
#: Signatures a bucket should hold.
BUCKET = 500_000
#: Sets of a block, of those that share a shingle; rows of a bucket of such blocks.
CROWD, MEMBERS = 1000, 20_000
#: Candidate documents up to which their ids are broadcast (16 bytes each).
BROADCAST = 500_000
_M, _SIX = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 48) - 1)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the word sequences of length 5; of a shorter text the whole one; of none none."""
    n = len(words)
    if not n:
        return words
    k = min(n, WORDS)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, k, dtype=np.uint64)
        for i in range(k):
            h = h * _M + words[i : n - k + 1 + i]
    return np.unique(mix(h))


@worker_cache
def words() -> WordHashes:
    return WordHashes()


def node_of(s: np.ndarray) -> int:
    """A set's name: 64 bits, as a signed integer."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(s.tobytes())
    return h - (1 << 64) if h >> 63 else h


@lru_cache(maxsize=1)
def bands() -> np.ndarray:
    """Least sizes of the bands."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(int(least[-1] * BAND) + 1)
    return np.array(least)


def instances(size: int) -> list[tuple[int, int, int]]:
    """(band, parts, differing elements) for each band that a set of this size takes part in."""
    least = bands()
    b = int(np.searchsorted(least, size, side="right")) - 1
    found = []
    for j in (b, b + 1):
        if j > b and size * UNDER < int(least[j]) * OVER:
            continue
        top = int(least[j + 1]) - 1
        # |x - y| is at most (|x| + |y|) (1 - t) / (1 + t), and |y| at most |x| / t
        most = top * 2 * (UNDER - OVER) // (UNDER + OVER)  # of two sets of this band
        if most <= PAIRED:
            found.append((j, max(2, 3 * most), most))
            continue
        k = (size + min(size * UNDER // OVER, top)) * (UNDER - OVER) // (UNDER + OVER)
        n = int(PARTS * 2 * top * (UNDER - OVER) / (UNDER + OVER)) + 1
        found.append((j, max(n, k + 1), k))
    return found


def signatures(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Signatures of a set, in each of its bands."""
    if not len(s):
        return s
    rare = np.ones(len(s), dtype=np.int64)
    if len(frequent):
        rare = (frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s).astype(np.int64)
    mixed = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(s ^ _M), dtype=np.uint64)))
    rares = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(rare)))
    out = []
    for band, n, k in instances(len(s)):
        at = np.searchsorted((s >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))
        h, count, few, changed = mixed[at[1:]] - mixed[at[:-1]], at[1:] - at[:-1], rares[at[1:]] - rares[at[:-1]], k
        if k <= PAIRED:
            i, j = np.triu_indices(n, 1)
            h, count, few, changed = h[i] + h[j], count[i] + count[j], few[i] + few[j], comb(n, 2) - comb(n - k, 2)
        h = mix(h ^ mix(np.arange(len(h), dtype=np.uint64) + np.uint64(band << 40)))
        if changed + 1 < len(h):
            top = np.uint64(1023)
            order = (top - np.minimum(few, 1023).astype(np.uint64)) << np.uint64(54) | (top - np.minimum(count, 1023).astype(np.uint64)) << np.uint64(44) | h >> np.uint64(20)
            h = h[np.argpartition(order, changed)[: changed + 1]]
        out.append(h)
    return np.concatenate(out)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Kind 0: a document's id, set size, set name (0 and null without words) and hash of its text. Kind 1: a shingle that is frequent within a block, and its count there."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words()
        for ids, texts, hashes in blocks(batches, 1, TEXT):
            sets: dict[int, np.ndarray] = {}
            sizes, nodes = [], []
            for t in texts:
                s = shingles(w.of(t))
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                if len(s):
                    sets[nodes[-1]] = s
            found, n = np.unique(np.concatenate(list(sets.values())), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = n >= 4
            found, n = found[often].view(np.int64), n[often]
            kind = pa.array(np.repeat([0, 1], [len(ids), len(found)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [kind, pa.array([*ids, *found.tolist()], pa.int64()), pa.array([*sizes, *n.tolist()], pa.int64()), pa.array([*nodes, *[None] * len(found)], pa.int64()), pa.array([*hashes, *[None] * len(found)], pa.int64())],
                names=["kind", "id", "n", "node", "text_hash"],
            )

    return rows.mapInArrow(run, "kind int, id long, n long, node long, text_hash long")


def candidates(docs: DataFrame, frequent: np.ndarray, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """grp, a, b: pairs of set names that share a signature (grp null), all pairs of small groups and the stars of large ones; besides for each large group its members (grp, a)."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)
    rows = docs.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words()
        for (texts,) in blocks(batches, 0, TEXT):
            seen: set[int] = set()
            found, names = [], []
            for t in texts:
                s = shingles(w.of(t))
                node = node_of(s) if len(s) else None
                if node is not None and node not in seen:
                    seen.add(node)
                    found.append(signatures(s, held.value))
                    names.append(node)
            if not found:
                continue
            sig = np.concatenate(found)
            node = np.repeat(np.array(names, dtype=np.int64), list(map(len, found)))
            bucket = (sig % np.uint64(buckets)).astype(np.int64)
            # six bytes tell a bucket's signatures apart; a chance match is one more candidate
            sig = (sig // np.uint64(buckets)) & _SIX
            order = np.lexsort((node, sig, bucket))
            bucket, sig, node = bucket[order], sig[order], node[order]
            first = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (bucket[1:] != bucket[:-1]))))
            size = np.diff(np.append(first, len(sig)))
            crowded = np.repeat(size > SMALL, size)
            center = np.zeros(len(sig), dtype=bool)
            center[first] = True
            # of a crowd only its center goes on to meet others; its members need no meeting and go anywhere
            inside = np.flatnonzero(crowded)
            away = np.full(len(inside), buckets + int(node[0]) % buckets)
            go = np.flatnonzero(~crowded | center)
            to = np.concatenate((bucket[go], away))
            names_ = np.concatenate((sig[go], groups(sig[inside], bucket[inside])))
            node = np.concatenate((node[go], node[inside]))
            many = np.concatenate((crowded[go], np.ones(len(inside), dtype=bool)))
            on, at = np.unique(to, return_index=True)
            ends = np.append(at[1:], len(to))
            six = names_.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            cut = lambda x: [x[a:b].tobytes() for a, b in zip(at, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(cut(six), pa.binary()), pa.array(cut(node), pa.binary()), pa.array([np.packbits(many[a:b]).tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())], names=["bucket", "sig", "node", "many"])

    def meet(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        raw = table.column("sig").to_pylist()
        sig = _set(b"".join(raw))
        node = np.frombuffer(b"".join(table.column("node").to_pylist()), dtype="<i8")
        if bucket >= buckets:  # crowds, each within one row and around its first member
            row = np.repeat(np.arange(len(raw)), [len(x) // 6 for x in raw])
            first = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (row[1:] != row[:-1]))))
            first_of = np.repeat(first, np.diff(np.append(first, len(sig))))
            a, b = node[first_of], node
            pairs, grp, inside = np.unique(np.stack((a, b))[:, a != b], axis=1), sig, np.arange(len(sig))
        else:
            many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(x) // 6) for m, x in zip(table.column("many").to_pylist(), raw, strict=True)])
            order = np.lexsort((node, sig))
            sig, node, many = sig[order], node[order], many[order].astype(bool)
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            crowd = np.logical_or.reduceat(many, first)
            keep = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
            sig, node = sig[keep], node[keep]
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            size = np.diff(np.append(first, len(sig)))
            large = np.repeat(crowd | (size > SMALL), size)
            end_of, first_of = np.repeat(first + size, size), np.repeat(first, size)
            left, right = [], []
            small = np.flatnonzero(~large)
            for d in range(1, SMALL):
                i = small[small + d < end_of[small]]
                left.append(node[i])
                right.append(node[i + d])
            others = np.flatnonzero(large & (first_of != np.arange(len(sig))))
            left.append(node[first_of[others]])
            right.append(node[others])
            pairs = np.unique(np.stack((np.concatenate(left), np.concatenate(right))), axis=1)
            inside = np.flatnonzero(large)
            grp = groups(sig[inside], np.full(len(inside), bucket))
        none = pa.nulls(pairs.shape[1], pa.int64())
        return pa.table({"grp": pa.concat_arrays([none, pa.array(grp.view(np.int64))]), "a": np.concatenate((pairs[0], node[inside])), "b": pa.concat_arrays([pa.array(pairs[1]), pa.nulls(len(inside), pa.int64())])})

    def groups(sig: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(sig * np.uint64(buckets) + bucket.astype(np.uint64)) & _SIX

    return rows.mapInArrow(sign, "bucket long, sig binary, node binary, many binary").groupBy("bucket").applyInArrow(meet, "grp long, a long, b long")


def sketch(s: np.ndarray) -> bytes:
    """Parity bits of a set: one bit flips for each element, in at least 4 bits an element.

    The bits in which two sketches of one length differ are at most as many as the elements in which the
    sets differ. A sketch is halved by xor of its halves.
    """
    size = 1 << max(6, int(4 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((mix(s) % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(bool)).tobytes()


def rarest(spark: SparkSession, open_: DataFrame) -> DataFrame:
    """e, node, root, n, few: those of each set's rarest quarter of shingles that another set has too, and whether they are of its rarest seventh.

    Rarity is counted among the open sets themselves: shingles that only one of them has come first and take up room.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, root, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                e = _set(raw).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e), *(pa.array(np.full(len(e), x)) for x in (node, root, n))], names=["e", "node", "root", "n"])

    every = written(spark, open_.select("node", "root", "n", "s").mapInArrow(run, "e long, node long, root long, n long"), "shingles")
    often = every.groupBy("e").agg(F.count("*").alias("often"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    # similar sets x, y with |x| >= |y| share OVER / UNDER of |x| at least, and 2 OVER / (UNDER + OVER) of |y|
    quarter, seventh = (F.col("n") - F.ceil(F.col("n") * over / under) + 1 for over, under in ((OVER, UNDER), (2 * OVER, UNDER + OVER)))
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "e"))
    own = F.sum((F.col("often") == 1).cast("long")).over(Window.partitionBy("node"))
    ranked = every.join(often, "e").withColumn("place", place).withColumn("own", own).filter((F.col("place") <= quarter) & (F.col("lo") != F.col("hi")))
    return ranked.select("e", "node", "root", "n", "own", (F.col("place") <= seventh).alias("few"))


def across(rare: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: pairs of different components that share one of their rarest shingles and that sizes, own shingles and sketches don't rule out.

    Sets that share a shingle are dealt into blocks of CROWD, and each pair of blocks is one unit of work, so a
    crowded shingle is spread over tasks; units are put together to buckets of MEMBERS rows. No pair is a row
    before it has passed. rare: a stored table.
    """
    parts = int(rare.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks_of = lambda n: F.ceil(F.col(n) / CROWD).cast("int")
    sizes = rare.groupBy("e").agg(F.count("*").alias("m"), F.count_if("few").alias("f")).filter("f > 0").select("e", blocks_of("m").alias("m"), blocks_of("f").alias("f"))
    rows = rare.join(sizes, "e").join(sets.select("node", "sketch"), "node")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["e", "node", "root", "n", "own", "sketch"]
    probe = rows.select(*kept, F.lit(False).alias("few"), mine("m").alias("i"), all_("f").alias("j"))
    index = rows.filter("few").select(*kept, F.lit(True).alias("few"), all_("m").alias("i"), mine("f").alias("j"))
    buckets = max(parts, -(-rare.count() // MEMBERS))
    units = probe.unionByName(index).withColumn("bucket", F.pmod(F.xxhash64("e", "i", "j"), F.lit(buckets)))

    def compare(table: pa.Table) -> pa.Table:
        key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("e", "i", "j")])
        node, root, n, own, few_ = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "n", "own", "few"))
        raw = table.column("sketch").to_pylist()
        order = np.lexsort(key)
        at = np.flatnonzero((np.diff(key[:, order], axis=1) != 0).any(0)) + 1
        found = [np.zeros((2, 0), np.int64)]
        for unit in np.split(order, at):
            x, y = unit[~few_[unit]], unit[few_[unit]]
            if not len(x) or not len(y):
                continue
            # what similar sets differ in is at most a seventh of both sizes, and what one has to itself is in the larger half of that
            both = n[x][:, None] + n[y][None, :]
            may = (root[x][:, None] != root[y][None, :]) & (n[y][None, :] <= n[x][:, None]) & (n[y][None, :] * UNDER >= n[x][:, None] * OVER)
            may &= ((n - own)[x][:, None] * (UNDER + OVER) >= OVER * both) & ((n - own)[y][None, :] * (UNDER + OVER) >= OVER * both)
            i, j = np.nonzero(may)
            if not len(i):
                continue
            least = min(min(len(raw[k]) for k in x.tolist()), min(len(raw[k]) for k in y.tolist()))
            u, v = (np.stack([np.bitwise_xor.reduce(np.frombuffer(raw[k], np.uint8).reshape(-1, least), axis=0) for k in side.tolist()]).view("<u8") for side in (x, y))
            for lo in range(0, len(i), 1 << 16):
                p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                ok = np.bitwise_count(u[p] ^ v[q]).sum(1, dtype=np.int64) * (UNDER + OVER) <= both[p, q] * (UNDER - OVER)
                one, two = node[x[p[ok]]], node[y[q[ok]]]
                found.append(np.unique(np.stack((np.minimum(one, two), np.maximum(one, two))), axis=1))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return units.groupBy("bucket").applyInArrow(compare, "a long, b long").distinct()


def few(ids: DataFrame) -> DataFrame:
    """ids for a join: broadcast if they are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST else ids


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, s (sorted hashes, their lower 6 bytes), n, sketch of the wanted (node, rep), made of the text of the document rep, or of one without an id if rep is null."""
    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words()
        for texts, nodes in blocks(batches, 0, 4 << 20):
            made = {}
            for t, node in zip(texts, nodes, strict=True):
                s = shingles(w.of(t))
                if len(s) and (name := node_of(s)) not in made and node in (None, name):  # an id may have other texts
                    made[name] = s
            low = [np.sort(s & _SIX).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in made.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(made), pa.int64()), pa.array(low, pa.binary()), pa.array(list(map(len, made.values())), pa.int64()), pa.array([sketch(s) for s in made.values()], pa.binary())],
                names=["node", "s", "n", "sketch"],
            )

    schema = "node long, s binary, n long, sketch binary"
    found = rows.join(few(wanted.filter("rep is not null")), "rep").select("text", "node").mapInArrow(make, schema)
    nameless = wanted.filter("rep is null").select("node")
    if nameless.isEmpty():
        return found
    other = rows.filter("rep is null and text is not null").select("text", F.lit(None).cast("long").alias("node")).mapInArrow(make, schema)
    return found.unionByName(other.join(few(nameless), "node", "left_semi"))


def _set(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def able(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that sizes and sketches don't rule out."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            on = []
            for i in range(len(a)):
                k = min(len(x[i]), len(y[i]))
                u, v = (np.bitwise_xor.reduce(np.frombuffer(z, np.uint8).reshape(-1, k), axis=0) for z in (x[i], y[i]))
                on.append(int(np.bitwise_count((u ^ v).view("<u8")).sum()) * (UNDER + OVER) <= (n[i] + m[i]) * (UNDER - OVER))
            yield batch.select([0, 1]).filter(pa.array(on, pa.bool_()))

    sized = sets.select("node", "n", "sketch")
    two = pairs.join(sized.withColumnsRenamed({"node": "a", "n": "n_a", "sketch": "x"}), "a").join(sized.withColumnsRenamed({"node": "b", "n": "n_b", "sketch": "y"}), "b")
    two = two.filter(F.least("n_a", "n_b") * UNDER >= F.greatest("n_a", "n_b") * OVER)
    return two.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(look, "a long, b long")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (of names) whose whole sets are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for i, j, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                u, v = _set(x), _set(y)
                at = np.searchsorted(u, v)
                both = int((u[np.minimum(at, len(u) - 1)] == v).sum())
                if both * UNDER >= (len(u) + len(v) - both) * OVER:
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    on = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = sets.select("node", "s").join(few(on), "node", "left_semi")
    left, right = (some.select(F.col("node").alias(c), F.col("s").alias(f"s_{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "s_a", "s_b").mapInArrow(compare, "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs; see `groups`."""
    return groups(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, component (its name, also where ids recur; null without words) and text_hash of every row of docs.

    component_id is the least id that links lead to, the row's own included. Rows without words (null,
    empty or blank texts) are linked with nothing and are their own component. Rows with equal sets are
    linked. A row with a null id links like any other; its component is that of the rows it reaches, and
    null if none of them has an id. Repeated rows stay.
    """
    spark = docs.sparkSession
    made = written(spark, features(docs, id_col, text_col), "features")
    own = made.filter("kind = 0")
    often = made.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).filter("n >= 16").orderBy(F.desc("n"), "id").limit(FREQUENT)
    frequent = np.sort(np.array([r.id for r in often.select("id").collect()], dtype=np.int64).view(np.uint64))
    names = written(spark, own.filter("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "names")
    total = own.agg(F.sum("n")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = written(spark, candidates(docs, frequent, max(4 * parts, int(total * 0.5) // BUCKET), id_col, text_col), "near")
    pairs = written(spark, near.filter("grp is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(names.select("node", "rep"), "node")
    sets = written(spark, sets_of(docs, written(spark, wanted, "wanted"), id_col, text_col), "sets")
    if not sets.groupBy("node").count().filter("count > 1").isEmpty():  # an id may stand on several rows
        sets = written(spark, sets.dropDuplicates(["node"]), "sets")
    able_ = written(spark, able(pairs, sets), "able")

    def labels(roots: DataFrame) -> DataFrame:
        label = names.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        return written(spark, label, "label")

    # one pair of each set first; then, of the other pairs, those that aren't in one component yet
    forest = written(spark, able_.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "forest")
    roots = components(spark, similar(forest, sets))
    label = labels(roots)
    rest = able_.join(forest, ["a", "b"], "left_anti").join(label.withColumnsRenamed({"node": "a", "root": "root_a"}), "a").join(label.withColumnsRenamed({"node": "b", "root": "root_b"}), "b")
    rest = written(spark, rest.filter("root_a <> root_b").select("a", "b"), "rest")
    if not rest.isEmpty():
        roots = components(spark, roots.unionByName(similar(rest, sets)))
        label = labels(roots)
    # large groups whose members aren't in one component yet: those members meet by their rarest shingles
    members = written(spark, near.filter("grp is not null").select("grp", F.col("a").alias("node")).distinct().join(label, "node"), "members")
    mixed = members.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("grp")
    open_ = written(spark, members.join(mixed, "grp").select("node", "root").distinct(), "open")
    if not open_.isEmpty():
        rare = written(spark, rarest(spark, open_.join(sets.select("node", "n", "s"), "node")), "rarest")
        more = written(spark, across(rare, sets).join(pairs, ["a", "b"], "left_anti"), "more")
        roots = components(spark, roots.unionByName(similar(more, sets)))
    all_ = roots.unionByName(roots.select(F.col("b").alias("a"), "b").distinct()).withColumnRenamed("a", "node")
    least = names.join(all_, "node").groupBy("b").agg(F.min("rep").alias("component"))
    linked = all_.join(least, "b").select("node", "component", F.col("b").alias("root"))
    copied = names.filter("copies > 1").join(all_, "node", "left_anti").select("node", F.col("rep").alias("component"), F.col("node").alias("root"))
    named = written(spark, linked.unionByName(copied), "components")
    return own.join(named, "node", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce("root", "node").alias("component"), "text_hash")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
