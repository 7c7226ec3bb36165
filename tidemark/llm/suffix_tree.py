"""Op 8: scoring by a probabilistic suffix tree over words.

The tree grows by a word at a time, to contexts of DEPTH words at most. A context is tried if it occurs
MIN_COUNT times in the training tokens, however many those are, if its suffix (without the first word) is
retained, and if its prefix (without the last word) was tried. It is retained if coding what follows it by
its own distribution saves bits over its longest retained suffix, by leave-one-out counts: the divergence that
would also hold for unseen text. Its distribution is smoothed towards that of the same suffix (Witten-Bell),
at the root by adding one to each count and one unknown word. A token is scored in the longest retained suffix
of what precedes it in its document.

The corpus is coded once, in blocks of documents: distinct words as hashes, tokens as indices. For each
depth every block sends its distinct (context, word) keys with their counts, and the probability in the
suffix (in 256ths of a bit), to hash-range buckets. A context of up to HEAVY occurrences has all its keys in
one bucket, which decides on it; of the others, at most SPREAD, the keys are spread and the buckets' sums are
added. Blocks get back each key's total, the number of words seen after its context and
whether that is retained. The total of n words is also the count of the context that they make for the next
depth. No table of words or contexts is held whole anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, eager, fold, mix, shared_dir, table

DEPTH = 4
MIN_COUNT = 16
#: Bits a token that a context must save to be retained.
MIN_GAIN = 0.01
#: Occurrences beyond which a context's keys are spread over the buckets.
HEAVY = 1 << 17
#: Contexts that may be so spread, at most: beyond this many times HEAVY tokens, HEAVY rises. Every task knows them.
SPREAD = 1_000_000
#: Tokens a bucket.
BUCKET = 1_000_000
#: Text bytes of a block.
BYTES = 10 << 20
END = 0xE4D0F7E47E4D5EED
BLOCKS = "block long, ids array<long>, held array<boolean>, lengths array<long>, vocab binary, codes binary, train long, tokens long"
SENT = "bucket long, block long, n long, groups long, keys binary, counts binary, contexts binary, runs binary, below binary, heavy binary"
REPLIES = "kind int, block long, bucket long, n long, totals binary, kinds binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(x: np.ndarray) -> bytes:
    """The array's bytes plane by plane, compressed."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int, kind: str) -> np.ndarray:
    k = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * k, codec="zstd", asbytes=True), dtype=np.uint8).reshape(k, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def shortened(keys: np.ndarray) -> bytes:
    """The lower six bytes of each, which tell the keys of a bucket apart."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def lengthened(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, hashes of the distinct ones (the most frequent first), and for each token which of them it is. Words are as in WordHashes.of."""
    import xxhash

    words = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    flat = words.flatten()
    some = pc.binary_length(flat).to_numpy() > 0  # around outer white space the split leaves empty words
    before = np.concatenate(([0], np.cumsum(some)))[words.offsets.to_numpy()]
    found = flat.filter(pa.array(some)).dictionary_encode()
    distinct = found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    vocab = np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct)), np.uint64(END))
    lengths = np.diff(before) + 1
    codes, ends = np.full(len(found) + len(texts), len(distinct)), np.cumsum(lengths) - 1
    inner = np.ones(len(codes), dtype=bool)
    inner[ends] = False
    codes[inner] = found.indices.to_numpy()
    rank = np.argsort(-np.bincount(codes), kind="stable")  # small codes for frequent words compress better
    code = np.empty(len(vocab), dtype=np.int64)
    code[rank] = np.arange(len(vocab))
    return lengths, vocab[rank], code[codes]


def coded(docs: DataFrame, id_col: str, text_col: str, held_out: str) -> DataFrame:
    """One row a block: ids, held, lengths (tokens of each document), vocab (hashes, the most frequent first), codes, train."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(held_out), F.lit(False)).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for i, (ids, held, texts) in enumerate(blocks(batches, 2, BYTES)):
            lengths, vocab, codes = _coded(texts)
            train = int(lengths[~np.array(held, dtype=bool)].sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() << 24 | i], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([vocab.tobytes()], pa.binary()), pa.array([packed(codes.astype("<u4"))], pa.binary()), pa.array([train], pa.int64()), pa.array([len(codes)], pa.int64())],
                names=["block", "ids", "held", "lengths", "vocab", "codes", "train", "tokens"],
            )

    return rows.mapInArrow(run, BLOCKS)


@dataclass
class Model:
    """What every task gets: totals, the least count of a context, and by depth the contexts of over `heavy` occurrences (sorted), their numbers of distinct followers, and whether they are retained."""

    tokens: int
    words: int
    least: int
    heavy: int
    contexts: list[np.ndarray]
    kinds: list[np.ndarray]
    retained: list[np.ndarray]


def _ordered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the numbers (none negative) in their order, equal ones as they stand, and the numbers so ordered.

    Where a number and its place fit 63 bits they are sorted as one, which takes a fraction of the time.
    """
    bits = len(x).bit_length()
    if int(x.max(initial=0)).bit_length() + bits <= 63:
        both = x.astype(np.int64) << bits | np.arange(len(x))
        both.sort()
        return both & (1 << bits) - 1, both >> bits
    order = np.argsort(x, kind="stable")
    return order, x[order].astype(np.int64)


class Block:
    """A block's tokens, walked depth by depth: deepen() finds the keys, take() gives them what the buckets replied."""

    def __init__(self, row: dict, m: Model):
        self.m, self.ids, self.held = m, row["ids"], np.array(row["held"], dtype=bool)
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words = self.keys = np.frombuffer(row["vocab"], dtype="<u8")
        self.codes = unpacked(row["codes"], row["tokens"], "<u4")
        #: for the places of this depth, which of the distinct keys they have
        self.at, self.which = np.arange(len(self.codes)), self.codes
        self.train = np.repeat(~self.held, self.lengths)
        self.inner = np.ones(len(self.codes), dtype=bool)
        self.inner[self.starts] = False
        self.depth = 0
        self._deal(self.keys)

    def _deal(self, group: np.ndarray) -> None:
        """Puts the keys in the order of the upper halves of their groups, by which buckets are dealt."""
        self.order, self.group = _ordered(group >> np.uint64(32))

    def deepen(self) -> None:
        """On to contexts of one word more: those before a place that are to be tried."""
        on = self.at if not self.depth else self.at[self.on]
        often = np.zeros(len(self.codes), dtype=bool)
        often[self.at] = (self.total >= self.m.least)[self.which]
        own = np.empty(len(self.codes), dtype=np.uint32)
        own[self.at] = self.which
        self.at = on[often[on - 1] & self.inner[on]]
        # a key is a context, by its number at the depth before, and a word
        order, pairs = _ordered(own[self.at - 1].astype(np.int64) * len(self.words) + self.codes[self.at])
        new = np.diff(pairs, prepend=-1) != 0
        self.which = np.empty(len(self.at), dtype=np.uint32)
        self.which[order] = np.cumsum(new) - 1
        before, word = np.divmod(pairs[new], max(len(self.words), 1))
        self.contexts, self.size = self.keys[before], self.total[before]
        self.below = self.best[self.at[order[new]]]  # all places of a key have the same context and suffix
        with np.errstate(over="ignore"):
            self.keys = mix(self.contexts * np.uint64(0x9E3779B97F4A7C15) ^ self.words[word])
        self.spread = self.size > self.m.heavy
        self._deal(np.where(self.spread, self.keys, self.contexts))
        self.depth += 1

    def take(self, totals: np.ndarray, kinds: np.ndarray) -> None:
        """Totals of the keys, and twice the followers of their contexts plus one if retained, both in the order sent."""
        m, self.total = self.m, np.empty(len(self.keys), dtype=np.int64)
        self.total[self.order] = totals
        if self.depth:
            both = np.empty(len(self.keys), dtype=np.int64)
            both[self.order] = kinds
            own = m.contexts[self.depth - 1]
            if self.spread.any():
                n = np.searchsorted(own, self.contexts[self.spread])
                both[self.spread] = m.kinds[self.depth - 1][n] * 2 + m.retained[self.depth - 1][n]
            k = (both >> 1).astype(float)
            p = (self.total + k * self.below) / (self.size + k)
            #: places of this depth whose context is retained
            self.on = (both & 1).astype(bool)[self.which]
            self.best[self.at[self.on]] = p[self.which[self.on]]
        else:
            #: by word: probability at the root, and whether it is known
            self.base, self.known = (self.total + 1.0) / (m.tokens + m.words + 1), self.total > 0
            self.best = self.base[self.codes]

    def sent(self, block: int, buckets: int) -> pa.RecordBatch:
        """A row for each bucket that this depth's keys go to: equal ranges of the upper half of their groups."""
        cuts = np.searchsorted(self.group.astype(np.uint64) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        on = np.flatnonzero(cuts[1:] > cuts[:-1])
        cut = lambda x, f: pa.array([f(x[cuts[i] : cuts[i + 1]]) for i in on.tolist()], pa.binary())
        counts = np.bincount(self.which[self.train[self.at]], minlength=len(self.keys)).astype("<u4")
        groups, columns = [0] * len(on), [pa.nulls(len(on), pa.binary())] * 4
        if self.depth:  # keys of one context follow each other, so a context is said once, with their number
            contexts = self.contexts[self.order]
            first = np.concatenate(([True], contexts[1:] != contexts[:-1]))[: len(contexts)]
            first[cuts[:-1][on]] = True
            first = np.flatnonzero(first)
            runs = np.diff(np.append(first, len(contexts))).astype("<u4")
            own = np.searchsorted(first, cuts)
            groups = (own[1:] - own[:-1])[on].tolist()
            part = lambda x: pa.array([packed(x[own[i] : own[i + 1]]) for i in on.tolist()], pa.binary())
            below = np.clip(np.rint(-256 * np.log2(self.below)), 0, 65535).astype("<u2")
            columns = [part(contexts[first]), part(runs), cut(below[self.order], packed), cut(self.spread[self.order], packed)]
        n = [pa.array(on), pa.array([block] * len(on), pa.int64()), pa.array((cuts[1:] - cuts[:-1])[on]), pa.array(groups, pa.int64())]
        return pa.RecordBatch.from_arrays([*n, cut(self.keys[self.order], shortened), cut(counts[self.order], packed), *columns], names=[c.split()[0] for c in SENT.split(", ")])


def _bits(total: np.ndarray, below: np.ndarray, size: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Bits that a context saves over its suffix where a word follows that did so total times, by counts without the place itself."""
    return total * np.log2((total - 1 + kinds * below) / np.maximum(size - 1 + kinds, 1) / below)


def added(depth: int):
    """The work on a bucket, which makes its replies. Kind 0: to a block. Kind 1: a spread context, its followers here (n), their totals and probabilities below. Kind 2 (depth 0): distinct words."""

    def add(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in table.column_names}
        n = col["n"]
        get = lambda c, kind: np.concatenate([unpacked(x, k, kind) for x, k in zip(col[c], n, strict=True)])
        keys, which = np.unique(np.concatenate([lengthened(k) for k in col["keys"]]), return_inverse=True)
        total = np.bincount(which, get("counts", "<u4"), len(keys)).astype(np.int64)
        both = np.zeros(len(keys), dtype=np.int64)
        more: list[tuple[int, int, int, bytes | None, bytes | None]] = []
        if depth:
            contexts, below, spread = np.empty(len(keys), dtype=np.uint64), np.empty(len(keys)), np.empty(len(keys), dtype=bool)
            got = [np.repeat(unpacked(c, k, "<u8"), unpacked(r, k, "<u4")) for c, r, k in zip(col["contexts"], col["runs"], col["groups"], strict=True)]
            contexts[which], below[which], spread[which] = np.concatenate(got), np.exp2(get("below", "<u2") / -256.0), get("heavy", "?")
            own, place = np.unique(contexts, return_inverse=True)
            on = total > 0
            kinds, size = np.bincount(place[on], minlength=len(own)), np.bincount(place, total, len(own))
            gain = np.bincount(place[on], _bits(total[on], below[on], size[place[on]], kinds[place[on]]), len(own))
            both = (2 * kinds + (gain > MIN_GAIN * size))[place]
            both[spread] = 0
            far = np.flatnonzero(spread & on)
            far = far[np.argsort(place[far], kind="stable")]
            cuts = np.flatnonzero(np.diff(place[far], prepend=-1, append=-1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                some = far[a:b]
                more.append((1, int(contexts[some[0]].view(np.int64)), b - a, total[some].astype("<u4").tobytes(), below[some].astype("<f4").tobytes()))
        else:
            more.append((2, 0, int((total > 0).sum()), None, None))
        ends = np.cumsum(n)
        cut = lambda x: [packed(x[which[b - k : b]].astype("<u4")) for k, b in zip(n, ends.tolist(), strict=True)]
        return pa.table(
            {
                "kind": pa.array([0] * len(n) + [x[0] for x in more], pa.int32()),
                "block": pa.array(col["block"] + [x[1] for x in more], pa.int64()),
                "bucket": pa.array(col["bucket"] + col["bucket"][:1] * len(more), pa.int64()),
                "n": pa.array(n + [x[2] for x in more], pa.int64()),
                "totals": pa.array(cut(total) + [x[3] for x in more], pa.binary()),
                "kinds": pa.array(cut(both) + [x[4] for x in more], pa.binary()),
            }
        )

    return add


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    for i in range(table.num_rows):
        yield table.slice(i, 1).to_pylist()[0]


def _with_replies(blocks_: DataFrame, replies: list[DataFrame], model: Model, work, schema: str) -> DataFrame:
    """work(block, its number) of every block after it took its replies of all depths so far."""
    back = reduce(DataFrame.unionByName, [r.filter("kind = 0").select("block", "bucket", "n", "totals", "kinds", F.lit(d).alias("depth")) for d, r in enumerate(replies)])
    depths = len(replies)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = next(_rows(left))
        b = Block(row, model)
        parts: list[list[tuple]] = [[] for _ in range(depths)]
        for d, *x in zip(*(right.column(c).to_pylist() for c in ("depth", "bucket", "n", "totals", "kinds")), strict=True):
            parts[d].append(tuple(x))
        for d, p in enumerate(parts):
            if d:
                b.deepen()
            p.sort(key=lambda x: x[0])
            b.take(*(np.concatenate([np.zeros(0, "<u4"), *(unpacked(x[i], x[1], "<u4") for x in p)]) for i in (2, 3)))
        return work(b, row["block"])

    return blocks_.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, schema)


def _spread(reply: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the contexts whose keys were spread (at most SPREAD): keys in order, numbers of followers, whether retained."""
    far = reply.filter("kind = 1")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [int(np.frombuffer(x, "<u4").sum(dtype=np.int64)) for x in batch.column("totals").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("n"), pa.array(size, pa.int64())], names=["block", "n", "size"])

    found = far.select("block", "n", "totals").mapInArrow(sizes, "block long, n long, size long").groupBy("block").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()
    of = {r.block: (r.n, r.size) for r in found}

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gain = [float(_bits(np.frombuffer(t, "<u4").astype(float), np.frombuffer(p, "<f4").astype(float), of[c][1], of[c][0]).sum()) for c, t, p in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(gain, pa.float64())], names=["block", "gain"])

    gain = {r.block: r.gain for r in far.select("block", "totals", "kinds").mapInArrow(gains, "block long, gain double").groupBy("block").agg(F.sum("gain").alias("gain")).collect()} if of else {}
    order = sorted(of, key=lambda c: c % (1 << 64))
    return np.array(order, dtype=np.int64).view(np.uint64), np.array([of[c][0] for c in order], dtype=np.int64), np.array([gain[c] > MIN_GAIN * of[c][1] for c in order], dtype=bool)


def score(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Rows whose held_out is true are scored but not learned from (null: learned from). A null text is empty
    and has its end alone. Ids may repeat or be null. Without training rows every token has probability 1
    under the base (N and V are 0), and the score is the base.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "coded")
    with eager(spark):
        coded(docs, id_col, text_col, held_out).write.option("compression", "zstd").parquet(path)
    blocks_ = spark.read.schema(BLOCKS).parquet(path)
    sums = blocks_.agg(F.sum("train"), F.sum("tokens")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (sums[1] or 0) // BUCKET)
    heavy = max(HEAVY, (sums[0] or 0) // SPREAD)
    model = Model(sums[0] or 0, 0, MIN_COUNT, heavy, [], [], [])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield Block(row, model).sent(row["block"], buckets)

    def further(b: Block, block: int) -> pa.Table:
        b.deepen()
        return pa.Table.from_batches([b.sent(block, buckets)])

    replies: list[DataFrame] = []
    for depth in range(DEPTH + 1):
        path = shared_dir(spark, f"totals{depth}")
        asked = _with_replies(blocks_, replies, model, further, SENT) if depth else blocks_.mapInArrow(first, SENT)
        with eager(spark):
            asked.groupBy("bucket").applyInArrow(added(depth), REPLIES).write.option("compression", "zstd").parquet(path)
        replies.append(spark.read.schema(REPLIES).parquet(path))
        if depth:
            for held, x in zip((model.contexts, model.kinds, model.retained), _spread(replies[-1]), strict=True):
                held.append(x)
        else:
            model.words = replies[0].filter("kind = 2").agg(F.sum("n")).first()[0] or 0

    def scored(b: Block, _: int) -> pa.Table:
        add = lambda x: np.add.reduceat(x, b.starts)
        k = len(b.ids)
        return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "held_out": b.held, "n_tokens": b.lengths, "n_known": add(b.known.astype(np.int64)[b.codes]), "train_tokens": np.full(k, b.m.tokens), "base_score": add(np.log10(b.base)[b.codes]), "score": add(np.log10(b.best))})

    return _with_replies(blocks_, replies, model, scored, SCORES)


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held"))
    return score(docs, "held")
