"""Op 13: how far the sources of a language diverge, by term-block dense matrices.

Every language's kept terms are dealt out in blocks. A block's counts become one dense int64 matrix of groups (the
language's sources, its total last) by terms; the probabilities of all pairs of groups are broadcast against each
other, in pieces of bounded size, and summed over the block's terms. A task sums the pair matrices of its blocks and
keeps a heap of the foremost terms of each group; Spark sums the partial matrices and merges the heaps.

All arithmetic is exact on integers, for counts below 2**53. A null text, lang or source is an empty string. A language
of G sources has G * (G - 1) rows of pairs by definition; lists of G sources (never of documents or terms) are held in
one row. An empty table gives no rows, a group without terms has pairs but no terms, repeated rows count again, and
further columns aren't read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, table, written

#: Documents of a language that a kept term stands in, and terms a group reports.
MIN_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: Cells of a dense matrix of groups by terms, cells of a broadcast piece of pairs by terms, and cells of pair matrices that a task holds before it sends them on.
TILE, PIECE, HELD = 1 << 16, 1 << 20, 1 << 22
#: (lang, source, term) counts that a task holds before it sends them on.
COUNTS = 400_000

_BREAKS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of letters A-Z and of characters beyond ASCII, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_BREAKS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs; a group also gets a row of the empty term, so that it is known if it has none."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (counts, docs) in held.items():
            found = list(counts)
            n = np.fromiter(counts.values(), np.int64, len(found))
            seen = np.fromiter((docs[t] for t in found), np.int64, len(found))
            for at in range(0, len(found), 50_000):
                part = pa.array(found[at : at + 50_000], pa.binary()).cast(pa.string())
                same = [pa.repeat(pa.scalar(x, pa.string()), len(part)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, part, pa.array(n[at : at + 50_000]), pa.array(seen[at : at + 50_000])], ["lang", "source", "term", "n", "docs"])

    size = 0
    for lang, source, text in blocks(batches, 2, 4 << 20):
        for group, t in zip(zip(lang, source, strict=True), text, strict=True):
            counts, docs = held.setdefault(group, (Counter({b"": 0}), Counter()))
            found = terms(t)
            size -= len(counts)
            counts.update(found)
            docs.update(set(found))
            size += len(counts)
            if size > COUNTS:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def shares(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * n / of), digit by digit, so that nothing overflows; n <= of."""
    out, left = np.zeros(np.broadcast_shapes(n.shape, of.shape), np.int64), n
    for _ in range(3):
        digit, left = np.divmod(left * 1000, of)
        out = out * 1000 + digit
    return out + 1


def pair_sums(p: np.ndarray) -> np.ndarray:
    """Of every two rows of p, floor((p - q)^2 / (p + q)) summed over the columns."""
    g, width = p.shape
    out = np.zeros((g, g), np.int64)
    for at in range(g):
        step = max(1, PIECE // max(1, width))
        for to in range(at + 1, g, step):
            q = p[to : to + step]
            d = q - p[at]
            out[at, to : to + step] = (d * d // (q + p[at])).sum(axis=1)
    return out + out.T


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, lang, source, item, value of a task's blocks: partial sums of pairs, and the foremost terms of each group."""
    names = ["part", "lang", "source", "item", "value"]
    sums: dict[str, tuple[list[str], np.ndarray]] = {}
    heaps: dict[tuple[str, str], list[tuple[int, bytes]]] = {}

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 4 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))], names)

    def pairs():
        for lang, (sources, matrix) in sums.items():
            for i, s in enumerate(sources):
                if len(sources) > 1:
                    yield batch([("pair", lang, s, o, int(v)) for j, (o, v) in enumerate(zip(sources, matrix[i], strict=True)) if j != i])

    for b in batches:
        for lang, sources, totals, v, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
            place = {s: i for i, s in enumerate(sources)}
            n = np.zeros((len(sources) + 1, len(words)), np.int64)
            for j, w in enumerate(words):
                for x in w["counts"]:
                    n[place[x["source"]], j] = x["n"]
            n[-1] = n.sum(axis=0)
            total = np.array([*totals, sum(totals)], np.int64)
            p = shares(n + 2, (total + 2 * v)[:, None])
            if lang not in sums and sum(m.size for _, m in sums.values()) + len(sources) ** 2 > HELD:
                yield from pairs()
                sums = {}
            held = sums.setdefault(lang, (sources, np.zeros((len(sources), len(sources)), np.int64)))
            held[1][:] += pair_sums(p[:-1])
            value = (p[:-1] - p[-1]) ** 2 // (p[:-1] + p[-1])
            value[(n[:-1] == 0) | (p[:-1] <= p[-1])] = -1
            for i, s in enumerate(sources):
                kth = np.sort(value[i])[-min(TOP, len(words))]
                best = [(-int(value[i, j]), words[j]["term"].encode()) for j in np.flatnonzero(value[i] >= max(kth, 0))]  # ties of the last one stay
                heaps[lang, s] = heapq.nsmallest(TOP, heaps.get((lang, s), []) + best)
    yield from pairs()
    top = [("term", lang, s, t.decode(), -v) for (lang, s), heap in heaps.items() for v, t in heap]
    for at in range(0, len(top), 10_000):
        yield batch(top[at : at + 10_000])


def audit(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: see op13 of the README; docs has text, lang and source."""
    none = F.lit("")
    read = docs.select(*(F.coalesce(c, none).alias(c) for c in ("lang", "source", "text")))
    counted = read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counted = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a term's counts by source: one row a source of the language at most
    by_term = counted.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("counts"), F.sum("docs").alias("docs"))
    by_term = written(spark, by_term.filter(F.col("term").eqNullSafe("") | (F.col("docs") >= min_docs)).select("lang", "term", "counts"), "terms")
    kept = by_term.filter("term <> ''")
    per = by_term.select("lang", F.explode("counts").alias("c"), (F.col("term") != "").cast("long").alias("kept")).groupBy("lang", "c.source").agg(F.sum(F.col("c.n") * F.col("kept")).alias("total"))
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = per.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("g"), F.count("*").alias("n_groups"))
    groups = written(spark, groups.join(size, "lang", "left").select("lang", "g", "n_groups", F.coalesce("v", F.lit(0)).alias("v")), "groups")
    # blocks of a language: as many as its matrix needs, of equal size but for the hash
    tiles = F.greatest(F.lit(1), F.ceil(F.col("v") * (F.col("n_groups") + 1) / F.lit(TILE)))
    dealt = kept.join(groups.select("lang", tiles.alias("tiles")), "lang").withColumn("tile", F.pmod(F.xxhash64("term"), "tiles"))
    tiled = dealt.groupBy("lang", "tile").agg(F.collect_list(F.struct("term", "counts")).alias("words"))
    tiled = tiled.join(groups, "lang").select("lang", "g.source", "g.total", "v", "words")
    found = written(spark, tiled.mapInArrow(_tiles, "part string, lang string, source string, item string, value long"), "parts")
    # every group meets the others of its language, also where the language keeps no term
    bare = groups.filter("v = 0").select("lang", "g.source", F.col("g.source").alias("items")).withColumn("source", F.explode("source"))
    bare = bare.select(F.lit("pair").alias("part"), "lang", "source", F.explode("items").alias("item"), F.lit(0).cast("long").alias("value")).filter("source <> item")
    pairs = found.filter("part = 'pair'").groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(bare)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    words = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return pairs.select("lang", "source", "part", "item", "value", "rank").unionByName(words.select("lang", "source", "part", "item", "value", "rank"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 10
), v AS (
  SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY ALL
), g AS (
  SELECT d.lang, d.source, coalesce((SELECT sum(c.n) FROM c JOIN kept k ON k.lang = c.lang AND k.term = c.term WHERE c.lang = d.lang AND c.source = d.source), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) d
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT // (g.total + 2 * v.v) AS p,
    1 + 1000000000 * (k.n + 2) // (v.total + 2 * v.v) AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 10
"""
