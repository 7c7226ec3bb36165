"""First kept wins: what a loop over ordered rows keeps if a row goes that is like one kept before.

Which rows stay is the lexicographically first maximal independent set of the links. A row stays if none of the
earlier rows that it is linked with stays. That is a conjunction of literals on other rows, and rounds simplify all
of them at once: decided rows drop out, and a row that hangs on a single other one is an alias of it or of its
opposite, which others use in its place. A chain of n rows so takes about log2(n) rounds and not n / 2.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import matching


def first_kept(ids: DataFrame, links: DataFrame) -> DataFrame:
    """id, kept_by of each id (a distinct, ordered column `id`): itself if it stays, else the first kept row that it is linked with.

    links: a, b, in any order and number; links of a row with itself, or to what isn't in ids, count for nothing. Each
    round's tables are checkpoints, and a join has one side with a row an id, so that a crowded id can be split.
    """
    nodes = ids.select("id").distinct()
    pairs = links.select(F.least("a", "b").alias("t"), F.greatest("a", "b").alias("x")).filter("t < x").distinct()
    pairs = pairs.join(nodes.select(F.col("id").alias("x")), "x", "left_semi").join(nodes.select(F.col("id").alias("t")), "t", "left_semi").checkpoint()
    # x stays if for each of its rows (t, stays) it is so that t stays or doesn't
    needs = pairs.select("x", "t", F.lit(False).alias("stays"))
    done = [nodes.join(pairs.select(F.col("x").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(True).alias("kept")).checkpoint()]
    while True:
        known = done[-1].select(F.col("id").alias("t"), "kept")
        met = needs.join(known, "t", "left").select("x", "t", "stays", (F.col("kept") == F.col("stays")).alias("holds"))
        per = met.groupBy("x").agg(F.min("holds").alias("all_hold"), F.count_if(F.col("holds").isNull()).alias("open"), F.count_distinct(F.when(F.col("holds").isNull(), F.col("t"))).alias("on"), F.max(F.when(F.col("holds").isNull(), F.struct("t", "stays"))).alias("one"))
        per = per.checkpoint()
        no, yes = F.coalesce(~F.col("all_hold"), F.lit(False)) | (F.col("open") > F.col("on")), F.col("open") == 0  # open > on: a row and its opposite
        new = per.filter(no | yes).select(F.col("x").alias("id"), (~no).alias("kept")).checkpoint()
        left = per.filter(~no & ~yes)
        if left.isEmpty():
            done.append(new)
            break
        done.append(new)
        alias = left.filter("open = 1").select(F.col("x").alias("t"), F.col("one.t").alias("far"), F.col("one.stays").alias("same"))
        rest = met.filter("holds is null").select("x", "t", "stays").join(left.select("x"), "x", "left_semi").join(alias, "t", "left")
        needs = rest.select("x", F.coalesce("far", "t").alias("t"), F.when(F.col("far").isNull(), F.col("stays")).otherwise(F.col("same") == F.col("stays")).alias("stays")).distinct().checkpoint()
    kept = reduce(DataFrame.unionByName, done).filter("kept").select(F.col("id").alias("t")).checkpoint()
    by = pairs.join(kept, "t", "left_semi").join(kept.withColumnRenamed("t", "x"), "x", "left_anti").groupBy("x").agg(F.min("t").alias("kept_by"))
    return nodes.join(by.withColumnRenamed("x", "id"), "id", "left").select("id", F.coalesce("kept_by", "id").alias("kept_by"))


# Which of two modes asks for more, and what a priority weighs.
MODE_RANK = {"any": 0, "speech_or_text": 1, "ocr_only": 2, "visual_only": 2, "speech_only": 2, "visual_and_speech": 3}
PRIORITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}


def similar_requirements(rows: DataFrame, least: float = 88, jaccard: float = 0.8) -> DataFrame:
    """a, b: ids of requirements of one brief and kind whose texts are alike in letters or in content tokens; members of a choice are alike to nothing."""
    free = rows.filter("choice is null").select("brief", "id", "kind", F.lower("text").alias("low"), "text")
    letters = matching.alike(free, "low", free, "low", least).select("a", "b")
    words = matching.token_jaccard(free, "text", free, "text", jaccard).select("a", "b")
    # equal texts of a brief and kind are one node: the first of them stands for all
    lead = free.groupBy("brief", "kind", "text", "low").agg(F.min("id").alias("lead"))
    side = lambda c, text: lead.select("brief", "kind", F.col(text).alias(c), F.col("lead").alias(f"id_{c}"))
    near = [side("a", t).join(p, "a").join(side("b", t), ["brief", "kind", "b"]).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")) for p, t in ((letters, "low"), (words, "text"))]
    same = free.join(lead, ["brief", "kind", "text"]).select(F.col("lead").alias("a"), F.col("id").alias("b"))
    return near[0].unionByName(near[1]).unionByName(same).filter("a <> b").distinct()


def merge_requirements(rows: DataFrame, least: float = 88, jaccard: float = 0.8) -> DataFrame:
    """Requirements with near duplicates merged into the first one that stays, without loss.

    rows: brief, id (in order, unique), kind, text, choice (null, or the group of alternatives), priority, mode, deadline,
    window (null if none), hints, criteria, classes (arrays of text). What stays takes the higher priority, the mode
    that asks for more (the first of equals), the earliest deadline, the first window, and all hints, criteria and classes in
    order; `merged` lists what it took in. A choice with one member is none: `alone`. ordinal counts a brief's rows.
    """
    rows = rows.checkpoint()  # asked for once a use below: what makes them is not run again for each
    links = similar_requirements(rows, least, jaccard)
    # a copy of a row that went is like what that one was like
    lead = rows.filter("choice is null").groupBy("brief", "kind", "text").agg(F.min("id").alias("lead"))
    by = first_kept(lead.select(F.col("lead").alias("id")), links)
    named = rows.join(lead, ["brief", "kind", "text"], "left").join(by.withColumnRenamed("id", "lead"), "lead", "left")
    named = named.withColumn("into", F.when(F.col("choice").isNull(), F.col("kept_by")).otherwise(F.col("id")))
    rank = lambda c, ranks: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col(c)), F.lit(0))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id")))
    own = lambda c: F.max(F.when(F.col("id") == F.col("into"), F.col(c)))
    strict = F.struct(rank("mode", MODE_RANK), -F.col("id"))
    merged = named.groupBy("brief", F.col("into").alias("id")).agg(
        own("kind").alias("kind"), own("text").alias("text"), own("choice").alias("choice"),
        F.max_by("priority", F.struct(rank("priority", PRIORITY_RANK), -F.col("id"))).alias("priority"), F.max_by("mode", strict).alias("mode"),
        F.min("deadline").alias("deadline"), first("window").alias("window"),
        *(_in_order(c).alias(c) for c in ("hints", "criteria", "classes")),
        F.array_sort(F.collect_list(F.when(F.col("id") != F.col("into"), F.col("id")))).alias("merged"),
    )
    members = merged.filter("choice is not null").groupBy("brief", "choice").agg(F.count("*").alias("members"))
    out = merged.join(members, ["brief", "choice"], "left").withColumn("alone", F.coalesce(F.col("members") == 1, F.lit(False)))
    ordinal = F.row_number().over(Window.partitionBy("brief").orderBy("id"))
    return out.withColumn("choice", F.when(~F.col("alone"), F.col("choice"))).drop("members").withColumn("ordinal", ordinal)


def _in_order(c: str) -> Column:
    """The distinct elements of the rows' arrays, in the order of rows."""
    return F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct("id", F.coalesce(c, F.array().cast("array<string>")).alias("x"))))["x"]))
