"""Op 7: packing documents into fixed-length sequences in the order of a space-filling curve.

A document's ids are hashed to a vector of 64 signed counts, which is scaled to length 1 and projected
to three dimensions; the cell of a grid there gives a Hilbert key. Documents are range-sorted by that
key, and each range is packed on its own: neighbours along the curve share sequences. What is left at
the end of a range is cut into sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, mix, ranges, table, written
from tidemark.llm.tokens import pieces

FEATURES, DIMENSIONS, BITS = 64, 3, 16
#: Ids in a row on their way to their place on the curve, at most.
CUT = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distances along the Hilbert curve of integer cells (rows of n coordinates below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    m = 1 << (bits - 1)
    q = m
    while q > 1:  # undo the excess work of the axes, from the top bit down
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = m
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection(features: int = FEATURES, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A fixed matrix of about normal entries, made from hashes of its places."""
    h = mix(np.arange(features * dimensions * 12, dtype=np.uint64) + np.uint64(1))
    return ((h >> np.uint64(11)).astype(float) / (1 << 53)).reshape(features, dimensions, 12).sum(2) - 6


def keys(ids: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """Hilbert keys of documents given by their ids (an empty one lies at the origin)."""
    h = mix(np.arange(vocabulary, dtype=np.uint64))
    place, sign = (h % np.uint64(FEATURES)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
    v = np.stack([np.bincount(place[x], sign[x], FEATURES) for x in ids])
    length = np.linalg.norm(v, axis=1, keepdims=True)
    points = (v / np.where(length, length, 1)) @ projection()
    unit = np.vectorize(lambda z: (1 + erf(z / 2**0.5)) / 2)(points)
    return hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", held: int | None = None) -> DataFrame:
    """id, h (a hash of the text, for ties), key (on the curve), start, total, ids (little-endian, with the end id).

    A long document gives a row for each CUT ids (start: those before), so that rows of one range are about
    equal in size: long documents lie close together on the curve.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = pieces(tokenizer, held)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        size = enc.tokenizer.get_vocab_size()
        for ids, texts, h in blocks(batches, 1, 12 << 20):
            got = enc.encode(texts)
            key = keys([np.frombuffer(x, enc.dtype) for x in got], size)
            got = [x + end for x in got]
            size_ = [len(x) // enc.width for x in got]
            parts = [(i, at) for i, n in enumerate(size_) for at in range(0, n, CUT)]
            of = np.array([i for i, _ in parts])
            take = lambda x: pa.array([x[i] for i, _ in parts], pa.int64())
            cut = [got[i][at * enc.width : (at + CUT) * enc.width] for i, at in parts]
            yield pa.RecordBatch.from_arrays([take(ids), take(h), pa.array(key[of]), pa.array([at for _, at in parts], pa.int64()), take(size_), pa.array(cut, pa.binary()), pa.array([enc.width] * len(parts), pa.int32())], names=["id", "h", "key", "start", "total", "ids", "width"])

    return rows.select("id", "text", "h").mapInArrow(encode, "id long, h long, key long, start long, total long, ids binary, width int")


class Packer:
    """Lays ids into sequences one after the other; `done` cuts the open one into powers of two."""

    def __init__(self, first: int, length: int):
        self.sequence, self.length, self.used = first, length, 0
        self.open: list[list] = []
        self.out: list[list] = []

    def add(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> None:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.length - self.used)
            self.open.append([doc_id, start + at, n, ids[at : at + n], total, self.sequence, self.used])
            at += n
            self.used += n
            if self.used == self.length:
                self._close()

    def _close(self) -> None:
        self.out += self.open
        self.open, self.used = [], 0
        self.sequence += 1

    def done(self) -> None:
        held, left = self.open, self.used
        self.open, self.used = [], 0
        whole = self.length
        for doc_id, start, n, ids, total, _, _ in held:
            at = 0
            while at < n:
                room = 1 << (left.bit_length() - 1)  # of the sequence that is open now
                self.length = room
                k = min(n - at, room - self.used)
                self.open.append([doc_id, start + at, k, ids[at : at + k], total, self.sequence, self.used])
                at += k
                self.used += k
                if self.used == room:
                    self._close()
                    left -= room
        self.length = whole

    def taken(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        column = lambda i: pa.array([r[i] for r in rows], pa.int64())
        crc = pa.array([zlib.crc32(r[3].astype("<u4").tobytes()) for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays([column(0), column(1), column(2), crc, column(4), column(5), column(6)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(encoded_docs: DataFrame, length: int = 1024) -> DataFrame:
    """One row a piece: which ids of which document lie where in which sequence.

    `encoded_docs` must be a stored table (it is read twice, once for the ranges). Equal keys are
    ordered by id and text hash and may fall into different ranges, so copies don't crowd one task.
    A null id stays null; every document has its end id at least, so each gives a piece.
    """
    n = ranges(encoded_docs.sparkSession, encoded_docs.agg(F.sum(F.octet_length("ids"))).first()[0])
    order = ["key", F.asc_nulls_first("id"), "h", "start"]
    rows = encoded_docs.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "start", "total", "ids", "width")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId() << 40, length)
        for batch in batches:
            for doc_id, start, total, ids, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packer.add(doc_id, start, np.frombuffer(ids, f"<u{width}"), total)
                if len(packer.out) >= 5000:
                    yield packer.taken()
        packer.done()
        yield packer.taken()

    return rows.mapInArrow(lay, PIECES)


def pack_texts(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, held: int | None = None) -> DataFrame:
    """Pieces of all documents; see `pack`. A null text is empty. `held`: text pieces whose ids a worker keeps, about 200 bytes each."""
    return pack(written(spark, encoded(docs, tokenizer, end_id, held=held), "encoded"), length)


def op7_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_texts(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
