"""Top-k with quotas, even samples, budgets and order-preserving distinct."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key (S4, K3, SO6). Spark prunes groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def quota_top_k(df: DataFrame, query: list[str], kind: str, order: list[Column], k: int, share: float) -> DataFrame:
    """k rows a query, of which no kind has more than max(1, round(k * share)) unless rows are left over (K2).

    All rows if there are at most k, plain top-k if there is one kind. Adds `pos`: capped picks first.
    """
    cap = max(1, round(k * share))
    w = Window.partitionBy(*query)
    ranked = df.withColumn("_rank", F.row_number().over(w.orderBy(*order)))
    ranked = ranked.withColumn("_in", F.row_number().over(Window.partitionBy(*query, kind).orderBy("_rank")))
    ranked = ranked.withColumns({"_n": F.count("*").over(w), "_lo": F.min(kind).over(w), "_hi": F.max(kind).over(w)})
    over = F.when((F.col("_n") <= k) | (F.col("_lo") == F.col("_hi")), False).otherwise(F.col("_in") > cap)
    out = ranked.withColumn("pos", F.row_number().over(w.orderBy(over, "_rank"))).filter(F.col("pos") <= k)
    return out.drop("_rank", "_in", "_n", "_lo", "_hi")


def spread(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Rows at positions floor(i * n / k), i below k; all rows if there are at most k (K4)."""
    w = Window.partitionBy(*keys)
    r = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    # position p is taken if some i has floor(i n / k) = p
    i = F.ceil(F.col("_i") * k / F.col("_n"))
    hit = (F.floor(i * F.col("_n") / k) == F.col("_i")) & (i < k)
    return r.filter((F.col("_n") <= k) | hit).drop("_i", "_n")


def budget(df: DataFrame, keys: list[str], priority: Column, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows a key, filled by priority (K6)."""
    return first_per(df, keys, [priority, *order], most)


def distinct_in_order(df: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Values of each key once, with the position of their first occurrence (SO2)."""
    return df.groupBy(*keys, value).agg(F.min(pos).alias(pos))


#: Rows of a block of requirements and of candidates whose vectors are multiplied at once.
BLOCK = 1024


def _best(k: int):
    """Of each requirement of a block the k best candidates of the other block, and of equals the first."""

    def unit(side: pa.Table) -> np.ndarray:
        m = side["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(side), -1)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def run(reqs: pa.Table, cands: pa.Table) -> pa.Table:
        if not len(reqs) or not len(cands):
            return pa.table({"req": reqs["req"][:0], "cand": cands["cand"][:0], "at": cands["at"][:0], "score": pa.array([], pa.float64())})
        score = np.round(unit(reqs) @ unit(cands).T, 6) + 0.0
        rank = np.empty(len(cands), np.int64)
        rank[pa.compute.sort_indices(cands.select(["at", "cand"]), [("at", "ascending"), ("cand", "ascending")]).to_numpy()] = np.arange(len(cands))
        rows, best = [], []
        for i, row in enumerate(score):
            near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))  # ties of the last one stay
            best.append(near[np.lexsort((rank[near], -row[near]))][:k])
            rows.append(np.full(len(best[-1]), i))
        at, of = np.concatenate(rows), np.concatenate(best)
        return pa.table({"req": reqs["req"].take(pa.array(at)), "cand": cands["cand"].take(pa.array(of)), "at": cands["at"].take(pa.array(of)), "score": pa.array(score[at, of])})

    return run


def semantic_rank(requirements: DataFrame, candidates: DataFrame, hints: DataFrame, k: int) -> DataFrame:
    """req, cand, score, by, rank: k candidates of each requirement of its key.

    requirements: key, req, v (vector). candidates: key, cand, at, v. hints: req, cand, score of those that a hint hits. `by` is
    `hint` where any of a requirement's candidates is hit (score, then earliest), `all` where there are k at most, in
    their order, else `meaning`: likeness of vectors, in six decimals. Only those are compared, block against block, and
    of each pair of blocks k candidates a requirement leave the task. Null vectors take no part.
    """
    requirements, candidates = (df.filter("key is not null and v is not null") for df in (requirements, candidates))
    n = candidates.groupBy("key").agg(F.count("*").alias("n"))
    hit = hints.filter("score > 0").join(candidates.select("key", "cand", "at"), "cand").join(requirements.select("key", "req"), ["key", "req"])
    reqs = requirements.join(n, "key").join(hit.select("req").distinct().withColumn("hit", F.lit(True)), "req", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    by_hint = hit.select("req", "cand", "at", F.col("score").cast("double").alias("score"), F.lit("hint").alias("by"))
    few = reqs.filter(~F.col("hit") & (F.col("n") <= k)).select("key", "req").join(candidates, "key").select("req", "cand", "at", F.lit(0.0).alias("score"), F.lit("all").alias("by"))

    block = lambda name, number: F.pmod(F.xxhash64(name), F.greatest(F.lit(1), F.ceil(number / BLOCK)))
    every = lambda number: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(number / BLOCK)) - 1))
    own = lambda c: F.col(c).alias(c)  # noqa: E731 - both sides may come from one table, whose columns cogroup can't tell apart
    open_ = reqs.filter(~F.col("hit") & (F.col("n") > k))
    sizes = open_.groupBy("key", "n").agg(F.count("*").alias("m"))
    # a pair of blocks is a group of its own: a task holds one at a time, and all pairs are dealt over all tasks
    x = open_.join(sizes.select("key", "m"), "key").select(own("key"), block("req", F.col("m")).alias("left"), every(F.col("n")).alias("right"), own("req"), own("v"))
    y = candidates.join(sizes, "key").select(own("key"), every(F.col("m")).alias("left"), block("cand", F.col("n")).alias("right"), own("cand"), own("at"), own("v"))
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema} | {"req": requirements.schema["req"].dataType.simpleString()}
    pair = ["key", "left", "right"]
    found = x.groupBy(*pair).cogroup(y.groupBy(*pair)).applyInArrow(_best(k), f"req {kinds['req']}, cand {kinds['cand']}, at {kinds['at']}, score double").withColumn("by", F.lit("meaning"))
    order = Window.partitionBy("req").orderBy(F.desc("score"), "at", "cand")
    ranked = by_hint.unionByName(few).unionByName(found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("req", "cand", "score", "by", "rank")


# Samples of a video by its length, below so many milliseconds; the last for all others.
TIERS = [(10_000, 24), (30_000, 40), (60_000, 60), (180_000, 90)]
MOST_SAMPLES = 120


def sampling_plan(videos: DataFrame, cuts: DataFrame, window: int = 5000, step: int = 250, settle: int = 150, most: int = 48) -> DataFrame:
    """video, reason, at (ms): where to look at each video (K9).

    videos: video, dur. cuts: video, cut. Mid-points of equal bins by the tier of the length; every `step` of the
    first and the last `window`; `settle` after each cut, and of more than `most` cuts an even choice, so that the
    end of a video keeps its share. Nothing lies beyond the video's end.
    """
    tier = F.lit(MOST_SAMPLES)
    for below, n in reversed(TIERS):
        tier = F.when(F.col("dur") < below, n).otherwise(tier)
    v = videos.select("video", F.col("dur").cast("long").alias("dur"), tier.cast("long").alias("n")).filter("dur > 0")
    put = lambda reason, at: v.select("video", F.lit(reason).alias("reason"), F.explode(F.expr(at)).alias("at"))
    bins = put("uniform", "transform(sequence(0L, n - 1), i -> (2 * i + 1) * dur div (2 * n))")
    hook = put("hook_window", f"sequence(0L, least({window}L, dur), {step}L)")
    end = put("cta_window", f"sequence(greatest(0L, dur - {window}), dur, {step}L)")
    w = Window.partitionBy("video")
    c = cuts.select("video", "cut").distinct().withColumns({"i": F.row_number().over(w.orderBy("cut")) - 1, "m": F.count("*").over(w)})
    even = F.expr(f"exists(sequence(0, {most - 1}), j -> cast(bround(cast(j * (m - 1) as double) / {most - 1}, 0) as bigint) = i)")
    scene = c.filter((F.col("m") <= most) | even).join(v.select("video", "dur"), "video").filter(F.col("cut") + settle <= F.col("dur"))
    return bins.unionByName(hook).unionByName(end).unionByName(scene.select("video", F.lit("scene_change").alias("reason"), (F.col("cut") + settle).alias("at")))
