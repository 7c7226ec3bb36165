"""Shared plumbing of the llm operators: tables, the shared folder, batches and hashes."""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch as shared_dir

#: Text bytes that a Python task gathers before it works on them as one block.
BLOCK_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Text bytes a range of a range sort should hold.
RANGE_BYTES = 128 << 20


def ranges(spark: SparkSession, size: int | None) -> int:
    """Ranges for so many bytes: the session's shuffle partitions, or more where those would grow too large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // RANGE_BYTES))


#: What holds while an operator stores a table: Arrow batches of fewer rows, as a batch of texts is held several
#: times over on its way to Python, and shuffle files that go as soon as the table is there.
EAGER = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_lock = threading.Lock()
_inside: dict[SparkSession, tuple[int, dict[str, str | None]]] = {}


@contextmanager
def eager(spark: SparkSession):
    """Sets EAGER for what runs inside; threads of one session may be inside together, and the last one out restores."""
    with _lock:
        n, before = _inside.get(spark, (0, {}))
        if not n:
            before = {k: spark.conf.get(k, None) for k in EAGER}
            for k, v in EAGER.items():
                spark.conf.set(k, v)
        _inside[spark] = n + 1, before
    try:
        yield
    finally:
        with _lock:
            n, before = _inside.pop(spark)
            if n > 1:
                _inside[spark] = n - 1, before
            else:
                for k, v in before.items():
                    spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def written(spark: SparkSession, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read again: the lineage is cut, and columns prune."""
    path = shared_dir(spark, name)
    with eager(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder's URI, as shared_dir gives it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def trim() -> None:
    """Gives memory that earlier tasks of this Python worker have freed back to the system, which allocators keep for themselves."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: int, most: int = BLOCK_BYTES) -> Iterator[list[list]]:
    """The columns of the batches as Python lists, cut or joined so that texts (column number text) come to about `most` bytes."""
    trim()
    held: list[list] | None = None
    size = 0
    for batch in batches:
        column = batch.column(text)
        lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(batch.num_rows, max(at + 1, int(np.searchsorted(ends, before + most - size, side="right"))))
            part = [c.to_pylist() for c in batch.slice(at, to - at).columns]
            held = part if held is None else [a + b for a, b in zip(held, part, strict=True)]
            size += int(ends[to - 1]) - before
            at = to
            if size >= most or at < batch.num_rows:
                yield held
                held, size = None, 0
    if held is not None:
        yield held


_held: list = []


def worker_cache(make):
    """Keeps what make(*arguments) gave last, for later tasks of the same Python worker.

    A call drops what the other functions so marked hold: a worker serves one operator at a time, and a
    reused one mustn't pile up the tables of all that it has served.
    """
    own = lru_cache(maxsize=1)(make)
    _held.append(own)

    @wraps(make)
    def get(*arguments):
        if any(other.cache_info().currsize for other in _held if other is not own):
            for other in _held:
                if other is not own:
                    other.cache_clear()
            trim()
        return own(*arguments)

    return get


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, computed once a word and held up to a fixed number of words of bounded size."""

    LIMIT, LONGEST = 400_000, 128

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            self[word] = h
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words [^\\x20\\x09-\\x0D]+ of the text, A-Z in lower case."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def fold(column: str, parts: int):
    """crc32 of the column's decimal text, modulo parts."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))
