"""Op 1: token ids as length-delimited binary records with masked checksums and an offset index.

A data file is a row of records

    u64 length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload

and a payload is ``u8 width | u8 has_id | i64 doc_id | ids``, ids of `width` bytes each; everything is
little-endian. Beside each data file ``part-N-A.bin`` (A: the attempt that wrote it) lies ``part-N-A.idx``: 8
magic bytes, then for each record u64 offset, u64 length of the frame, u64 ids before it in this file, u32
number of ids, u32 zero. `read` walks through the records, `shuffled` seeks them by the index in random order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, eager, filesystem, ranges, shared_dir, table
from tidemark.llm.tokens import pieces

MAGIC = b"TMIDX001"
INDEX = np.dtype([("offset", "<u8"), ("size", "<u8"), ("before", "<u8"), ("count", "<u4"), ("zero", "<u4")])
_HEAD, _BODY, _CRC = struct.Struct("<Q"), struct.Struct("<BBq"), struct.Struct("<I")
#: Added to a rotated checksum, so that a checksum of data that holds checksums stays useful. A fixed value.
_DELTA = 0xA282EAD8


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = _HEAD.pack(len(payload))
    return b"".join((head, _CRC.pack(masked(head)), payload, _CRC.pack(masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one frame; ValueError if a length or checksum is wrong."""
    if len(data) < 16 or _CRC.unpack_from(data, 8)[0] != masked(data[:8]):
        raise ValueError("damaged record length")
    n = _HEAD.unpack_from(data)[0]
    payload = data[12 : 12 + n]
    if len(data) != n + 16 or _CRC.unpack_from(data, 12 + n)[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


def payload_of(doc_id: int | None, width: int, ids: bytes) -> bytes:
    return _BODY.pack(width, doc_id is not None, doc_id or 0) + ids


def ids_of(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, has, doc_id = _BODY.unpack_from(payload)
    return (doc_id if has else None), np.frombuffer(payload, dtype=f"<u{width}", offset=_BODY.size)


@dataclass(frozen=True)
class Shards:
    """What `write` left: the folder, and for each file its number, name, records, ids and bytes."""

    folder: str
    files: tuple[tuple[int, str, int, int, int], ...]


#: Index entries that are read or written at once.
ENTRIES = 1000


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> Shards:
    """Encode every whole text and write the ids, in ascending (id, text) order over the files in turn.

    A null text is empty (its record holds the end id alone); null ids come first; equal ids follow
    each other in the order of their texts' hashes, so one id may hold any share of the rows. An
    empty table gives no file. Other columns are ignored. Every attempt of a task writes files of its own,
    and those of the attempts that ended well are what is returned: nothing need be renamed or replaced.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    spark = docs.sparkSession
    n = ranges(spark, docs.agg(F.sum(F.octet_length(text_col))).first()[0])
    rows = rows.repartitionByRange(n, F.asc_nulls_first("id"), "h").sortWithinPartitions(F.asc_nulls_first("id"), "h")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        enc = pieces(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        fs, path = filesystem(folder)
        fs.create_dir(path)
        name = f"part-{part:05d}-{attempt}"
        out = beside = None
        at = before = records = 0
        for ids, texts, _ in blocks(batches, 1, 12 << 20):
            if out is None:
                out, beside = fs.open_output_stream(f"{path}/{name}.bin"), fs.open_output_stream(f"{path}/{name}.idx")
                beside.write(MAGIC)
            index = []
            for doc_id, got in zip(ids, enc.encode(texts), strict=True):
                made = frame(payload_of(doc_id, enc.width, got + end))
                out.write(made)
                count = len(got) // enc.width + 1
                index.append((at, len(made), before, count, 0))
                at += len(made)
                before += count
            beside.write(np.array(index, dtype=INDEX).tobytes())
            records += len(index)
        if out is None:
            return
        out.close()
        beside.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "records": [records], "ids": [before], "size": [at]})

    with eager(spark):
        made = rows.mapInArrow(save, "part long, name string, records long, ids long, size long").collect()  # a row for each file
    return Shards(folder, tuple(sorted((r.part, r.name, r.records, r.ids, r.size) for r in made)))


def _index(fs, path: str, name: str) -> Iterator[np.ndarray]:
    """Entries of a file's index, ENTRIES at a time."""
    with fs.open_input_file(f"{path}/{name}.idx") as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"not an index: {name}")
        while raw := f.read(INDEX.itemsize * ENTRIES):
            yield np.frombuffer(raw, dtype=INDEX)


def read(spark: SparkSession, shards: Shards) -> DataFrame:
    """Per record: doc_id, start (ids of all records before it), n_tokens, ids_crc32, shard, byte_offset.

    Every frame's checksums are verified; a damaged one fails the task.
    """
    begins, total = [], 0
    for part, name, _, ids, _ in shards.files:
        begins.append((part, name, total))
        total += ids
    folder = shards.folder

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            for part, name, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{path}/{name}.bin") as f:
                    for some in _index(fs, path, name):
                        ids, counts, crcs = [], [], []
                        for offset, size, _, count, _ in some.tolist():
                            doc_id, got = ids_of(unframe(f.read_at(size, offset)))
                            if len(got) != count:
                                raise ValueError("the index doesn't fit its file")
                            ids.append(doc_id)
                            counts.append(len(got))
                            crcs.append(zlib.crc32(got.astype("<u4").tobytes()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, pa.int64()), pa.array(some["before"].astype("i8") + begin), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array([part] * len(ids), pa.int64()), pa.array(some["offset"].astype("i8"))],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "byte_offset"],
                        )

    files = spark.createDataFrame(begins, "part long, name string, begin long")
    if begins:
        files = files.repartition(len(begins))
    return files.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, byte_offset long")


def shuffled(spark: SparkSession, shards: Shards, seed: int) -> DataFrame:
    """doc_id and ids (array of int) of every record, in an order that follows from the seed.

    Only the index entries are sorted, by a hash of seed, file and offset; each task then seeks its records. The
    rows of partition i come before those of partition i + 1.
    """
    folder = shards.folder

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            for part, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for some in _index(fs, path, name):
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int64()), pa.array([name] * len(some)), pa.array(some["offset"].astype("i8")), pa.array(some["size"].astype("i8"))], names=["part", "name", "offset", "size"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        open_: dict[str, pa.NativeFile] = {}
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for lo in range(0, len(rows), 100):
                got = []
                for name, offset, size in rows[lo : lo + 100]:
                    if name not in open_:
                        if len(open_) >= 64:
                            open_.pop(next(iter(open_))).close()
                        open_[name] = fs.open_input_file(f"{path}/{name}.bin")
                    got.append(ids_of(unframe(open_[name].read_at(size, offset))))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array([x.astype("i4") for _, x in got], pa.list_(pa.int32()))], names=["doc_id", "ids"])
        for f in open_.values():
            f.close()

    files = spark.createDataFrame([(part, name) for part, name, *_ in shards.files], "part long, name string")
    index = files.repartition(max(1, len(shards.files))).mapInArrow(entries, "part long, name string, offset long, size long")
    order = [F.xxhash64(F.lit(seed), "part", "offset"), F.col("part"), F.col("offset")]
    index = index.repartitionByRange(ranges(spark, sum(f[4] for f in shards.files)), *order).sortWithinPartitions(*order)
    return index.select("name", "offset", "size").mapInArrow(fetch, "doc_id long, ids array<int>")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = write(table(spark, sf_dir, "documents"), shared_dir(spark, "records"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read(spark, shards)
