"""Words without their spaces (F14) and texts that aren't words (F15), by the words of a corpus.

A word costs the logarithm of its rank in the corpus, so the cheapest way through a run of letters is its likeliest
split. Ranks come from a histogram of counts, not from a sort of all words; a run meets the words that it holds by an
inverted index on its substrings, and its own few words travel with it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx
from tidemark.functions import text as tx
from tidemark.operators import matching

#: Characters of the longest word that a run is split into.
LONGEST = 24


def word_costs(words: DataFrame, word: str = "w") -> DataFrame:
    """w, n, rank, cost of each distinct word: rank is 1 and the number of words that are more frequent, cost is ln(rank * ln(words))."""
    counts = words.select(F.col(word).alias("w")).filter("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("n").agg(F.count("*").alias("k"))  # as many rows as there are different counts
    more = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = kinds.select("n", (F.coalesce(F.sum("k").over(more), F.lit(0)) + 1).alias("rank"), F.sum("k").over(Window.partitionBy()).alias("all"))
    cost = F.log(F.col("rank") * F.log(F.greatest(F.col("all"), F.lit(3)).cast("double")))
    return counts.join(ranks, "n").select("w", "n", "rank", cost.alias("cost"))


def split_run(run: Column, costs: Column) -> Column:
    """Words of the cheapest split of a letter run by a map of word to cost, with the run's case; null if there is none. Of equally cheap splits the first in the alphabet."""
    none = F.lit(None).cast("double")
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<string>").alias("words")))

    def step(best: Column, i: Column) -> Column:
        def ending(j: Column) -> Column:
            word = F.substring(run, j + 1, i - j)
            cost = F.get(best, j)["cost"] + F.try_element_at(costs, F.lower(word))
            return F.when(cost.isNotNull(), F.struct(cost.alias("cost"), F.concat(F.get(best, j)["words"], F.array(word)).alias("words")))

        made = F.array_min(F.array_compact(F.transform(F.sequence(F.greatest(i - LONGEST, F.lit(0)), i - 1), ending)))
        dead = F.struct(none.alias("cost"), F.array().cast("array<string>").alias("words"))
        return F.concat(best, F.array(F.coalesce(made, dead)))

    whole = F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(run)), start, step), -1)
    return F.when(whole["cost"].isNotNull(), whole["words"])


def restored(spark: SparkSession, texts: DataFrame, key: str, text: str, costs: DataFrame, phrases: list[str] = lx.RUN_TOGETHER, least: int = 8, short: float = 0.5, mean: float = 2.6) -> DataFrame:
    """key, text, restored: white space as single spaces, and long runs of letters split.

    Known phrases are split at any length, other runs from `least` letters on at their cheapest split. It is rejected
    if more than `short` of its words have one or two letters, or if words have under `mean` letters on average: names
    and garbled logos stay whole. Only tokens that are letters for 0.6 at least are touched; digits, marks and case stay.
    Equal texts are worked on once; null stays null.
    """
    calls = spark.createDataFrame([(p.replace(" ", ""), [len(w) for w in p.split()]) for p in phrases], "run string, lengths array<int>")
    gate = min(least, *(len(p.replace(" ", "")) for p in phrases))
    kinds = texts.select(F.col(text).alias("t")).filter("t is not null").distinct()
    tokens = kinds.select("t", F.posexplode(F.filter(F.split("t", r"\s+"), lambda x: x != "")).alias("at", "token"))
    long = (F.length("token") >= gate) & (F.regexp_count("token", F.lit("[A-Za-z]")) >= F.length("token") * 0.6)
    parts = tokens.withColumn("parts", F.when(long, F.regexp_extract_all("token", F.lit("([A-Za-z]+|[^A-Za-z]+)"), 1)).otherwise(F.array("token")))
    parts = parts.select("t", "at", long.alias("long"), F.posexplode("parts").alias("place", "part"))
    runs = parts.filter("long").select(F.col("part").alias("run")).filter("run rlike '^[A-Za-z]+$'").distinct()
    free = runs.filter(F.length("run") >= least).join(F.broadcast(calls.select(F.col("run").alias("known"))), F.lower("run") == F.col("known"), "left_anti")
    words = costs.filter(F.length("w") <= LONGEST)
    each = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.length("run"), F.lit(LONGEST))), lambda n: matching.substrings(F.lower("run"), n))))
    held = free.select("run", F.explode(each).alias("w")).join(words, "w").groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("w", "cost"))).alias("costs"))
    made = held.select("run", split_run(F.col("run"), F.col("costs")).alias("words")).filter("words is not null")
    few = F.size(F.filter("words", lambda w: F.length(w) <= 2)) <= F.size("words") * short
    made = made.filter(few & (F.length("run") >= F.size("words") * mean))
    sliced = F.transform("lengths", lambda n, i: F.substring("whole", F.aggregate(F.slice("lengths", F.lit(1), i), F.lit(1), lambda a, x: a + x), n))
    called = runs.withColumnRenamed("run", "whole").join(F.broadcast(calls), F.lower("whole") == F.col("run")).select(F.col("whole").alias("run"), sliced.alias("words"))
    split = called.unionByName(made).select(F.col("run").alias("part"), F.array_join("words", " ").alias("split"))
    done = parts.join(split, "part", "left").groupBy("t", "at").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("split", "part").alias("x")))).alias("x"))
    done = done.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("at", F.array_join("x.x", "").alias("x")))).alias("x")).select("t", F.array_join("x.x", " ").alias("restored"))
    out = texts.select(key, F.col(text).alias("text")).join(done, F.col("text") == F.col("t"), "left")
    return out.select(key, "text", F.when(F.col("text").isNotNull(), F.coalesce("restored", F.lit(""))).alias("restored"))


def readability(texts: DataFrame, key: str, text: str, known: DataFrame, phrases: list[str] = lx.RUN_TOGETHER, least: int = 40, lone: int = 8) -> DataFrame:
    """key, n_tokens, score, verdict of each row (F15): the share of a text's words of three letters or more that are known.

    known: w, each word once. Digits and marks go from words first. A text with fewer than two such words is too short to
    judge, unless its one word has `lone` letters; a text with a known phrase is readable whatever its words. key names rows.
    """
    def read(plain: Column) -> Column:
        words = F.filter(F.transform(F.split(plain, " "), lambda w: F.regexp_replace(w, "[^a-z]", "")), lambda w: F.length(w) >= 3)
        return F.struct(words.alias("words"), reduce(or_, (F.contains(plain, F.lit(p)) for p in phrases), F.lit(False)).alias("called"))

    rows = texts.select(key, tx.bound(tx.normalize_text(F.col(text)), read).alias("x")).select(key, "x.*")
    n = F.coalesce(F.size("words"), F.lit(0))
    rows = rows.select(key, "words", "called", F.when(n < 0, 0).otherwise(n).alias("n_tokens"), ((n >= 2) | (n == 1) & (F.length(F.get("words", F.lit(0))) >= lone)).alias("judged"))
    each = rows.filter("judged and not called").select(key, F.explode("words").alias("w")).groupBy(key, "w").agg(F.count("*").alias("c"))
    hits = each.join(known.select("w", F.lit(True).alias("is_word")), "w", "left").groupBy(key).agg(F.sum(F.when(F.col("is_word"), F.col("c")).otherwise(0)).alias("hits"))
    score = F.when(F.col("judged"), F.when(F.col("called"), 100).otherwise(F.bround(100.0 * F.col("hits") / F.col("n_tokens")).cast("int")))
    out = rows.join(hits, key, "left").select(key, "n_tokens", score.alias("score"))
    verdict = F.when(F.col("score").isNull(), "too_short_to_judge").when(F.col("score") >= least, "readable").otherwise("unreadable")
    return out.withColumn("verdict", verdict)
