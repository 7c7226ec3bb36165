"""Op 9: digests of improbable features, held in chained Bloom filters.

A text is taken with 31 zero bytes before and after it, so that one of any size has windows of 32 bytes that
show its ends. Every window has an entropy from 0 to 1000; entropies that are rare among all windows of the
corpus make a window improbable. A window is selected if it is the most improbable one in at least 8 of the
32 neighbourhoods of 32 windows that it lies in. Selected windows are hashed into Bloom filters of 2048 bits,
160 windows to a filter, then the next filter begins. Two digests are alike as far as their filters share
more bits than chance would have it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, mix, ranges, table, written

#: Bytes of a window; windows of a neighbourhood (no more than bytes); neighbourhoods that a window must win.
WINDOW, NEAR, LEAST_SCORE = 32, 32, 8
BITS, HASHES, FILTER_FEATURES = 2048, 5, 160
#: Entropies below this mark runs of few characters: rare, but nobody's own.
LEAST_ENTROPY = 100
#: Share of the room between chance and full overlap that counts as chance.
CHANCE = 0.15
#: Bytes that the kernel works on at once; longer texts are cut into parts that overlap by what a selection depends on.
CHUNK = 1 << 20
#: Words of 64 bits that a comparison of two chains looks at together.
COMPARED = 1 << 21
_ONE = 1 << 20  # of the fixed-point entropies: sums are exact, so a text's digest doesn't depend on its neighbours


def _weights() -> np.ndarray:
    c = np.arange(WINDOW + 1, dtype=float)
    return np.rint(c * np.log2(np.maximum(c, 1)) * _ONE).astype(np.int64)


def levels(raw: np.ndarray) -> np.ndarray:
    """Entropy, from 0 to 1000, of the window that starts at each byte (but the last 31), in time linear in the bytes.

    It changes by the byte that enters and the byte that leaves; how often each stands in the window follows
    from the positions of equal bytes.
    """
    n = len(raw)
    order = np.argsort(raw, kind="stable")
    key = raw[order].astype(np.int64) * (n + 2 * WINDOW) + order
    lo = np.searchsorted(key, key - (WINDOW - 1))
    q = np.arange(n)
    w = _weights()
    gain = w[1:] - w[:-1]
    enter, leave = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    enter[order] = gain[q - lo]
    leave[order] = gain[np.cumsum(np.bincount(lo, minlength=n)) - 1 - q]
    total = np.cumsum(enter)
    total[WINDOW:] -= np.cumsum(leave)[:-WINDOW]
    most = w[WINDOW]  # of a window of one byte value
    return np.clip((most - total[WINDOW - 1 :]) * 1000 // most, 0, 1000)


class Parts:
    """Texts between zero bytes, joined to one array of at most about CHUNK bytes; `first` and `last` bound the windows of each part.

    A part of a long text has the windows `core` for its own, and those around them that their selection depends on.
    """

    def __init__(self, parts: list[tuple[int, int, bytes, int, int]]):
        self.text = np.array([p[0] for p in parts])
        self.at = np.array([p[1] for p in parts])  # number, in its text, of a part's first window
        self.raw = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8)
        size = np.array([len(p[2]) for p in parts])
        self.first = np.cumsum(size) - size
        self.last = self.first + size - WINDOW + 1
        self.core = self.first + np.array([p[3] for p in parts]), self.first + np.array([p[4] for p in parts])

    def own(self, of: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Which windows lie in the bounds."""
        edge = np.zeros(len(self.raw) + 1, dtype=np.int64)
        np.add.at(edge, of[0], 1)
        np.add.at(edge, of[1], -1)
        return np.cumsum(edge)[: len(self.raw) - WINDOW + 1] > 0


def cut(texts: list[bytes]) -> Iterator[Parts]:
    """All windows of all texts that aren't empty, each once among the cores."""
    pad = bytes(WINDOW - 1)
    held: list[tuple[int, int, bytes, int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        windows = len(t) + WINDOW - 1 if t else 0
        whole = pad + t + pad
        for u in range(0, windows, CHUNK):
            v = min(windows, u + CHUNK)
            lo, hi = max(0, u - NEAR + 1), min(windows, v + NEAR - 1)
            if held and size + hi - lo > CHUNK:
                yield Parts(held)
                held, size = [], 0
            held.append((i, lo, whole[lo : hi + WINDOW - 1], u - lo, v - lo))
            size += hi - lo + WINDOW - 1
    if held:
        yield Parts(held)


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """For each entropy its rank by rarity among all windows of all whole texts (0: the rarest); low entropies come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1001, dtype=np.int64)
        for (texts,) in blocks(batches, 0, CHUNK):
            for parts in cut([t.encode("utf-8", "surrogatepass") for t in texts]):
                total += np.bincount(levels(parts.raw)[parts.own(parts.core)], minlength=1001)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(total[on], pa.int64())], names=["level", "n"])

    counts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))
    seen = np.zeros(1001, dtype=np.int64)
    for r in counts.collect():  # at most 1001 rows
        seen[r.level] = r.n
    order = np.lexsort((np.arange(1001), seen))
    rank = np.empty(1001, dtype=np.int64)
    rank[order] = np.arange(1001)
    rank[:LEAST_ENTROPY] = 1001
    return rank


def features(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the selected windows of each text, in order.

    A text in which none is selected gives its most improbable window, an empty one nothing.
    """
    found: list[list[np.ndarray]] = [[] for _ in texts]
    best: dict[int, tuple[int, int, bytes]] = {}
    for parts in cut(texts):
        ranks = rank[levels(parts.raw)]
        n = len(ranks)
        ranks[~parts.own((parts.first, parts.last))] = 2000  # a window across two parts
        keyed = (ranks << 32) | np.arange(n)
        pad = np.full(NEAR - 1, 2001 << 32)
        least = np.concatenate((pad, keyed, pad))
        step = 1
        while step < NEAR:  # least of each neighbourhood, by doubling; the leftmost of equals
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = least[least < 2000 << 32] & 0xFFFFFFFF
        score = np.bincount(least, minlength=n)
        picked = np.flatnonzero((score >= LEAST_SCORE) & (ranks <= 1000) & parts.own(parts.core))
        h = _hashes(parts.raw, picked)
        cuts = np.searchsorted(picked, np.stack(parts.core))
        for j, (i, a, b) in enumerate(zip(parts.text.tolist(), cuts[0].tolist(), cuts[1].tolist(), strict=True)):
            if a < b:
                found[i].append(h[a:b])
            elif not found[i]:
                own = keyed[parts.core[0][j] : parts.core[1][j]]
                at = int(own.argmin() + parts.core[0][j])
                best[i] = min(best.get(i, (9999, 0, b"")), (int(ranks[at]), at - int(parts.first[j]) + int(parts.at[j]), parts.raw[at : at + WINDOW].tobytes()))
    for i, (_, _, window) in best.items():
        if not found[i]:
            found[i].append(_hashes(np.frombuffer(window, dtype=np.uint8), np.zeros(1, dtype=np.int64)))
    return [np.concatenate(f) if f else np.zeros(0, dtype=np.uint64) for f in found]


def _hashes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    view = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[at]).view("<u8")
    h = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW // 8):
            h = mix((h + np.uint64(0x9E3779B97F4A7C15)) ^ view[:, i])
    return h


class Digest:
    """Chained Bloom filters: bits (rows of 256 bytes) and the number of features in each."""

    def __init__(self, hashes: np.ndarray):
        if len(hashes):
            _, first = np.unique(hashes, return_index=True)  # a repeated window counts once
            hashes = hashes[np.sort(first)]
        n = -(-len(hashes) // FILTER_FEATURES)
        on = np.zeros((n, BITS), dtype=bool)
        row = np.arange(len(hashes)) // FILTER_FEATURES
        for i in range(HASHES):
            on[row, ((hashes >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        self.bits = np.packbits(on, axis=1)
        self.counts = np.bincount(row, minlength=n).astype(np.int64)
        self.ones = on.sum(1)

    def __str__(self) -> str:
        return ".".join(map(str, self.counts.tolist())) + ":" + base64.b64encode(self.bits.tobytes()).decode()

    def likeness(self, other: Digest) -> float:
        """From 0 to 1: for each filter of the shorter chain its best overlap in the other, weighed by features.

        Two empty digests are alike, an empty one and another are not.
        """
        a, b = sorted((self, other), key=lambda d: (len(d.counts), d.counts.sum(), d.bits.tobytes()))
        if not len(a.counts) or not len(b.counts):
            return float(len(a.counts) == len(b.counts))
        best = np.zeros(len(a.counts))
        p = 1 - 1 / BITS
        x, y = a.bits.view("<u8"), b.bits.view("<u8")
        each = max(1, COMPARED // y.size)
        for i in range(0, len(x), each):
            both = np.bitwise_count(x[i : i + each, None, :] & y[None, :, :]).sum(2, dtype=np.int64)
            n, m = a.counts[i : i + each, None], b.counts[None, :]
            most = np.minimum(a.ones[i : i + each, None], b.ones[None, :])
            by_chance = BITS * (1 - p ** (HASHES * n) - p ** (HASHES * m) + p ** (HASHES * (n + m)))
            least = by_chance + CHANCE * np.maximum(most - by_chance, 0)
            score = np.where(both >= most, 1.0, np.clip((both - least) / np.maximum(most - least, 1e-9), 0, 1))
            best[i : i + each] = score.max(1)
        return float((best * a.counts).sum() / a.counts.sum())


def digests(texts: list[str], rank: np.ndarray) -> list[Digest]:
    return [Digest(h) for h in features([t.encode("utf-8", "surrogatepass") for t in texts], rank)]


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the start of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _made(ids: list, texts: list[str], following: list[str], own: list[Digest], after: list[Digest], rank: np.ndarray) -> list[list]:
    new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    changed = digests(new, rank)
    return [
        ids,
        [len(t) for t in texts],
        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
        [str(d) for d in own],
        [str(d) for d in changed],
        [a.likeness(b) for a, b in zip(own, changed, strict=True)],
        [a.likeness(b) for a, b in zip(own, after, strict=True)],
    ]


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def arrays(columns: list[list]) -> list[pa.Array]:
    return [pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of each text, of its edit, and likenesses; the next document is that of the next smaller id.

    After the last comes the first. Rows of one id follow each other by a hash of their text; null ids come
    last; a null text is empty. A table of one row is its own next. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rank = rarity(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    n = ranges(spark, docs.agg(F.sum(F.octet_length(text_col))).first()[0])
    order = [F.desc_nulls_last("id"), F.col("h")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finished rows; besides, for each range its first row (edge 1) and its last (edge 2), whose next lies in another."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = [*_NAMES, "edge", "part", "text"]

        def edge(kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
            none = [[doc_id], [0], [""], [""], [""], [0.0], [0.0]]
            return pa.RecordBatch.from_arrays([*arrays(none), pa.array([kind], pa.int32()), pa.array([part], pa.int64()), pa.array([text], pa.string())], names=names)

        held: tuple | None = None
        for ids, texts in blocks(batches, 1, 8 * CHUNK):
            own = digests(texts, rank)
            if held is None:
                yield edge(1, ids[0], texts[0])
            else:
                ids, texts, own = [held[0], *ids], [held[1], *texts], [held[2], *own]
            held = (ids[-1], texts[-1], own[-1])
            done = _made(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:], rank)
            k = len(ids) - 1
            if k:
                yield pa.RecordBatch.from_arrays([*arrays(done), pa.array([0] * k, pa.int32()), pa.array([part] * k, pa.int64()), pa.array([""] * k, pa.string())], names=names)
        if held is not None:
            yield edge(2, held[0], held[1])

    made = written(spark, rows.mapInArrow(run, COLUMNS + ", edge int, part long, text string"), "digests", "zstd")
    parts = sorted(r.part for r in made.filter("edge = 1").select("part").collect())  # a number for each range
    follow = dict(zip(parts, parts[1:] + parts[:1], strict=True))
    pairs = spark.createDataFrame(list(follow.items()), "part long, then long")
    last = made.filter("edge = 2").select("doc_id", "part", "text").join(pairs, "part")
    first = made.filter("edge = 1").select(F.col("part").alias("then"), F.col("text").alias("following"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, following in (b for batch in batches for b in [[c.to_pylist() for c in batch.columns]]):
            yield pa.RecordBatch.from_arrays(arrays(_made(ids, texts, following, digests(texts, rank), digests(following, rank), rank)), names=_NAMES)

    rest = last.join(first, "then").select("doc_id", "text", "following").mapInArrow(join, COLUMNS)
    return made.filter("edge = 0").select(*_NAMES).unionByName(rest)


def op9_rare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
