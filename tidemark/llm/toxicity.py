"""Op 12: toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are hashed n-grams of characters (case folded to lower, white space runs as one space, one at each end); a
feature's value is its rate in the text, up to a ceiling, so that neither length nor one repeated word decides. Values are
integers, so sums over any partitioning are equal. The log-count ratios are sums over every labelled text to learn
from; the logistic weights on the scaled features are fitted on a bounded sample of them (SAMPLE texts a class, the
least hashes of doc_id, and SAMPLE_VALUES values), whose classes weigh what they weigh among all. Model and ratios are
of fixed size.

A null text is an empty one, and has a score as any other. Rows of labels without doc_id or toxic are left out; of several
rows of one doc_id a toxic one counts. Labels of no document count for nothing; each of a document's repeated rows is
learned from and scored. If the labels to learn from are of one kind only, every score is that kind; without any, 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, fold, mix, table, written

#: Lengths of n-grams, features (a power of two), and characters that are hashed at a time.
GRAMS, BITS, STRETCH = (3, 4, 5), 18, 1 << 19
#: A value is UNIT times the occurrences in 1000 characters, CEILING * UNIT at most; PAD characters are added to every text.
UNIT, CEILING, PAD = 1024, 3, 100
#: Texts a class and values in all that the weights are fitted on, the penalty on their squares, and steps at most.
SAMPLE, SAMPLE_VALUES, PENALTY, STEPS = 4000, 16_000_000, 1e-3, 80
#: Labelled ids up to which a join with them is a broadcast.
BROADCAST = 500_000
_CHUNK = 1 << 12
_SPACE = re.compile(r"\s+")


def values(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features in ascending order, their integer values) of a text."""
    text = text or ""
    words = " ".join(text.split()) if len(text) <= STRETCH else _SPACE.sub(" ", text).strip()
    chars = f" {words.lower()} "
    counts, n = None, 0
    for at in range(0, max(1, len(chars) - 2), STRETCH):  # stretches overlap by what the longest n-gram needs
        c = np.frombuffer(chars[at : at + STRETCH + GRAMS[-1] - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        hashes, h = [], c
        for size in range(2, GRAMS[-1] + 1):
            if len(c) < size:
                break
            with np.errstate(over="ignore"):
                h = h[: len(c) - size + 1] * np.uint64(0x9E3779B97F4A7C15) + c[size - 1 :]
            if size in GRAMS:
                hashes.append((mix(h[:STRETCH] + np.uint64(size)) >> np.uint64(64 - BITS)).astype(np.int64))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
        n += len(flat)
        if len(chars) <= STRETCH:
            found, times = np.unique(flat, return_counts=True)
            break
        counts = np.bincount(flat, minlength=1 << BITS) + (0 if counts is None else counts)
    else:
        found = np.flatnonzero(counts)
        times = counts[found]
    per = n + len(GRAMS) * PAD
    return found, np.minimum(CEILING * UNIT, times * (UNIT * 1000 * len(GRAMS)) // per)


@dataclass(frozen=True)
class Model:
    """score = logistic(bias + sum of weights * values); kind instead, if there was nothing to tell apart."""

    weights: np.ndarray
    bias: float
    kind: float | None = None

    def score(self, text: str | None) -> float:
        if self.kind is not None:
            return self.kind
        found, v = values(text)
        z = self.bias + float(np.dot(self.weights[found], v / UNIT))
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def labelled(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """doc_id, text, toxic of the documents that have a label and are to learn from."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).filter(learn)
    known = written(docs.sparkSession, known, "labels")
    if known.count() <= BROADCAST:
        known = F.broadcast(known)
    return docs.select("doc_id", "text").join(known, "doc_id")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, sums: a task's values by class (clean, toxic), in chunks of _CHUNK features, and its texts by class as chunk -1."""
    total, texts = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for text, toxic in blocks(batches, 0):
        for t, y in zip(text, toxic, strict=True):
            found, v = values(t)
            total[y][found] += v
            texts[y] += 1
    if texts.any():
        parts = [total[:, at : at + _CHUNK].tobytes() for at in range(0, 1 << BITS, _CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(parts)), pa.int32()), pa.array([texts.tobytes(), *parts], pa.binary())], ["chunk", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(sums, np.int64)
            held[chunk] = held[chunk] + own if chunk in held else own
    for chunk, sums in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["chunk", "sums"])


def ratios(spark: SparkSession, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(log-count ratio of each feature, texts by class) over all rows of `labelled`; one is added to every sum."""
    sums = rows.select("text", "toxic").mapInArrow(_sums, "chunk int, sums binary")
    found = {r.chunk: np.frombuffer(r.sums, np.int64) for r in sums.repartition("chunk").mapInArrow(_added, "chunk int, sums binary").collect()}  # of fixed size
    if not found:
        return np.zeros(1 << BITS), np.zeros(2, np.int64)
    total = np.concatenate([found[c].reshape(2, -1) for c in range((1 << BITS) // _CHUNK)], axis=1) + UNIT
    clean, toxic = np.log(total) - np.log(total.sum(axis=1, keepdims=True))
    return toxic - clean, found[-1]


def minimum(f, x: np.ndarray, steps: int = STEPS, memory: int = 8) -> np.ndarray:
    """Where f (giving value and gradient) is least, by limited-memory BFGS with backtracking."""
    value, grad = f(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, back = -grad, []
        for s, t in reversed(moves):
            back.append(s @ d / (s @ t))
            d = d - back[-1] * t
        if moves:
            s, t = moves[-1]
            d = d * (s @ t / (t @ t))
        else:
            d = d / max(1.0, float(np.linalg.norm(d)))
        for (s, t), a in zip(moves, reversed(back), strict=True):
            d = d + (a - t @ d / (s @ t)) * s
        step, slope = 1.0, grad @ d
        while (new := f(x + step * d))[0] > value + 1e-4 * step * slope and step > 1e-9:
            step /= 2
        s, t = step * d, new[1] - grad
        x, done = x + s, value - new[0] < 1e-8
        value, grad = new
        if s @ t > 1e-12:
            moves = [*moves, (s, t)][-memory:]
        if done:
            break
    return x


def weigh(features: list[np.ndarray], scaled: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """(weights, bias) of the penalised logistic regression on sparse rows."""
    used, at = np.unique(np.concatenate(features), return_inverse=True)
    v = np.concatenate(scaled).astype(np.float32)
    at = at.astype(np.int32)
    ends = np.cumsum([len(f) for f in features])
    # groups of rows of bounded size, each worked on at once
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], 1_000_000)), len(ends)))
    cuts = np.unique(np.append(0, cuts))
    y, weight = 2.0 * toxic - 1, weight / weight.sum()
    starts = np.append(0, ends)

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, total, grad = x[:-1], 0.5 * PENALTY * float(x[:-1] @ x[:-1]), np.append(PENALTY * x[:-1], 0.0)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi, n = starts[a], starts[b], np.diff(starts[a : b + 1])
            row = np.repeat(np.arange(b - a), n)
            m = y[a:b] * (np.bincount(row, w[at[lo:hi]] * v[lo:hi], b - a) + x[-1])
            total += float(weight[a:b] @ np.logaddexp(0, -m))
            g = -weight[a:b] * y[a:b] / (1 + np.exp(np.clip(m, -700, 700)))
            grad[:-1] += np.bincount(at[lo:hi], g[row] * v[lo:hi], len(w))
            grad[-1] += g.sum()
        return total, grad

    x = minimum(f, np.zeros(len(used) + 1))
    out = np.zeros(size)
    out[used] = x[:-1]
    return out, float(x[-1])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """The model of the labelled documents of which `learn` (a condition on doc_id) is true."""
    rows = labelled(docs, labels, learn)
    scale, texts = ratios(spark, rows)
    if not texts.all():
        return Model(np.zeros(1), 0.0, float(texts[1] > 0))
    first = ["h", "doc_id", "text_hash"]
    named = rows.select("toxic", F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text").alias("text_hash"))
    ids = [named.filter(F.col("toxic") == y).orderBy(*first).limit(SAMPLE).distinct() for y in (0, 1)]
    chosen = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(ids[0].unionByName(ids[1]).drop("doc_id")), ["toxic", "h", "text_hash"])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, scaled, toxic, size = [], [], [], 0
        for batch in batches:
            for text, y in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic")), strict=True):
                found, v = values(text)
                if size + len(found) > SAMPLE_VALUES and {0, 1} <= {*toxic, y}:
                    continue
                size += len(found)
                features.append(found.astype(np.int32))
                scaled.append((v / UNIT * scale[found]).astype(np.float32))
                toxic.append(y)
        y = np.array(toxic)
        share = texts / np.bincount(y, minlength=2)  # a class weighs what it weighs among all
        w, bias = weigh(features, scaled, y, share[y], 1 << BITS)
        yield pa.RecordBatch.from_arrays([pa.array([(w * scale).tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    # classes take turns in the order of hashes, so that a bound on values cuts both alike
    order = F.row_number().over(Window.partitionBy("toxic").orderBy("h", "text_hash"))
    one = chosen.withColumn("turn", order).repartition(1).sortWithinPartitions("turn", "toxic").select("text", "toxic")
    got = one.mapInArrow(weighed, "weights binary, bias double").first()
    return Model(np.frombuffer(bytes(got.weights)), got.bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(spark, docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
