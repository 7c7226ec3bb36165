"""Op 6: byte-level BPE by replaying all merges over a corpus of distinct words.

The distinct words (pre-tokens) of a block of documents lie in one array of symbols with links to the
next and the previous symbol. An inverted index leads from a pair of tokens to the places where it
stands. Merges are taken in rank order; each is applied to all its places at once, and only the two
neighbours of a place are touched: they enter the index with the pairs that they now form. Then every
document's ids are looked up word by word.

Blocks are all of a task's documents, 16 MB of text at a time, so memory is bounded and nothing moves
between tasks; a word's ids don't depend on the block it is met in.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, table, worker_cache


class Merges:
    """Encoding and decoding by a file of ranked byte strings."""

    #: Words whose ids are held between blocks.
    LIMIT = 300_000

    def __init__(self, path: str, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {r: t for t, r in self.rank.items()}
        top = max(self.bytes, default=0) + 1
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        self.top = top
        pairs: dict[int, int] = {}
        unsafe = set()
        for token, r in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * top + b] = r
                    unsafe.update(x for x in (a, b) if x > r)  # merging x can open a merge of lower rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.unsafe = unsafe
        self.words: dict[str, tuple[int, ...]] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair merges to, or -1."""
        k = a * self.top + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.merged[at], -1)

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word, by all merges in rank order."""
        if not words:
            return []
        if not len(self.keys):
            return [tuple(self.byte[list(w)].tolist()) for w in words]
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = len(raw)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        symbol = self.byte[raw]
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        ends = np.cumsum(lengths) - 1
        after[ends] = n  # no symbol of the same word follows
        before[np.concatenate(([0], ends[:-1] + 1))] = -1
        symbol = np.append(symbol, -1)  # the place n, which pairs with nothing
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            """Places whose pair merges to ranks; the index is keyed by what a pair merges to."""
            ok = ranks >= 0
            places, ranks = places[ok], ranks[ok]
            if not len(places):
                return
            if len(places) == 1:
                groups = [(int(ranks[0]), places)]
            else:
                order = np.argsort(ranks, kind="stable")
                places, ranks = places[order], ranks[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                groups = list(zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts), strict=True))
            for r, p in groups:
                if (held := index.get(r)) is None:
                    index[r] = [p]
                    heapq.heappush(queue, r)
                else:
                    held.append(p)

        inner = np.flatnonzero(after[:n] < n)
        enter(inner, self._ranks(symbol[inner], symbol[after[inner]]))
        while queue:
            r = heapq.heappop(queue)
            found = index.pop(r)
            places = found[0] if len(found) == 1 else np.concatenate(found)
            left = symbol[places]
            follow = after[places]
            right = np.where(left >= 0, symbol[follow], -1)
            places = places[(left >= 0) & (right >= 0) & (self._ranks(left, right) == r)]  # others have changed since
            if not len(places):
                continue
            if len(places) > 1:
                places = np.unique(places)
            if r in self.unsafe:  # the leftmost of each word now, the others when what it opens is done
                first = np.concatenate(([True], word[places][1:] != word[places][:-1]))
                if not first.all():
                    enter(places[~first], np.full(int((~first).sum()), r))
                    places = places[first]
            elif len(places) > 1:
                follow = after[places]
                hit = follow[:-1] == places[1:]  # overlaps, as in "aaa": every second of such a run
                if hit.any():
                    run = np.concatenate(([False], hit))
                    start = np.flatnonzero(~run)
                    rank_in_run = np.arange(len(places)) - np.repeat(start, np.diff(np.append(start, len(places))))
                    places = places[rank_in_run % 2 == 0]
            gone = after[places]
            then = after[gone]
            symbol[places] = r
            symbol[gone] = -1
            after[places] = then
            inside = then < n
            before[then[inside]] = places[inside]
            prior = before[places]
            prior = prior[prior >= 0]
            touched = np.concatenate((places[inside], prior))
            if len(touched):
                enter(touched, self._ranks(symbol[touched], symbol[after[touched]]))
        kept = symbol[:n] >= 0
        ids = symbol[:n][kept].tolist()
        cuts = np.concatenate(([0], np.cumsum(np.bincount(word[kept], minlength=len(words))))).tolist()
        return [tuple(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; the block's distinct words that aren't held yet are replayed together."""
        split = [self.find(t) for t in texts]
        if len(self.words) > self.LIMIT:
            self.words = {}
        new = list(set(chain.from_iterable(split)).difference(self.words))
        todo = []
        for w in new:
            b = w.encode("utf-8", "surrogatepass")
            whole = self.rank.get(b)  # a word that is a token is that token, however its merges go
            if whole is None:
                todo.append((w, b))
            else:
                self.words[w] = (whole,)
        for (w, _), ids in zip(todo, self.replay([b for _, b in todo]), strict=True):
            self.words[w] = ids
        get = self.words.__getitem__
        return [list(chain.from_iterable(map(get, s))) for s in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@worker_cache
def merges(path: str, pattern: str) -> Merges:
    return Merges(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (bytes of the decoded ids) for each row.

    A null text is empty and has no ids. Ids may repeat or be null; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(path, pattern)
        for ids, texts in blocks(batches, 1):
            got = m.encode(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got, pa.list_(pa.int32())), pa.array([m.decode(x) for x in got], pa.binary())], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `encode`, with a count and hashes in place of ids and bytes, made where the ids are."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(path, pattern)
        names = {r: str(r) for r in m.bytes}
        for ids, texts in blocks(batches, 1):
            got = m.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(x) for x in got], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(names.__getitem__, x)).encode()).hexdigest() for x in got]),
                    pa.array([hashlib.sha256(m.decode(x)).hexdigest() for x in got]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
