"""Queries beyond one SQL pass: P5, F5-F10, F14, F32, J4, J5, J13, J16, J17, K7, R33, W2, W3, W9, X3, X7, S10 box grouping."""

from __future__ import annotations

import zlib
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import cues, fuzzy, hashing, spoken
from tidemark.functions import text as tx
from tidemark.operators import matching, selection, wording
from tidemark.operators import sequential as sq
from tidemark.plans.text import inferred
from tidemark.registry import query
from tidemark.tables import TIMELINE, asks, load, per_text, spread, timeline


@query("p5_compression_ratio")
def p5(spark: SparkSession, d: str) -> DataFrame:
    """Bytes over zlib bytes of each text; null for an empty one."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: len(t.encode()) / len(zlib.compress(t.encode())) if t else None)

    return load(spark, d, "documents").select("doc_id", run("text").alias("ratio"))


@query("f5_phrase_ratio")
def f5(spark: SparkSession, d: str) -> DataFrame:
    """Names that are alike at 80 (F5), with the other likenesses of each pair."""
    n = load(spark, d, "part").select("p_name")
    pairs = matching.alike(n, "p_name", n, "p_name", 80).filter("a < b")
    out = {"robust": fuzzy.robust_ratio, "contains": fuzzy.contains_ratio, "token_set": fuzzy.token_set_ratio, "token_sort": fuzzy.token_sort_ratio, "same": fuzzy.same_word}
    return pairs.select("a", "b", F.col("score").alias("ratio"), *(fuzzy.column(f, F.col("a"), F.col("b")).alias(k) for k, f in out.items()))


def captioned(a: Column, b: Column) -> Column:
    """struct(score, method) of fuzzy.caption_similarity (F9); null if either is null."""

    @F.pandas_udf("score int, method string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if p is None or q is None else fuzzy.caption_similarity(p, q) for p, q in zip(x, y, strict=True)], columns=["score", "method"])

    return run(a, b)


@query("f9_caption_similarity")
def f9(spark: SparkSession, d: str) -> DataFrame:
    """Every ask against the plain form of the same part's ask: the best of four likenesses and which it is."""
    other = F.concat(F.lit("you see "), F.replace(tx.normalize_text(F.col("text")), F.lit("the "), F.lit("this ")))
    a = per_text(asks(spark, d), "text", lambda t: t.withColumn("other", other).withColumn("s", captioned(F.col("text"), F.col("other"))))
    return a.select("id", "text", "other", "s.*")


@query("j4_phrase_ocr")
def j4(spark: SparkSession, d: str) -> DataFrame:
    """The phrases that each shown text holds at 85 or more and whose numbers it has, the best one of each text."""
    shown = asks(spark, d).select("id", tx.normalize_text(F.col("text")).alias("hay")).filter("id % 3 = 1")
    phrases = load(spark, d, "part").select(F.concat_ws(" ", F.element_at(F.split("p_name", " "), -1), F.when(F.col("p_partkey") % 7 == 0, "close up")).alias("needle"))
    phrases = phrases.unionByName(spark.createDataFrame([("shop now",), ("20% off",), ("close up",), ("link in bio",), ("hydrating serum",)], "needle string"))
    best = matching.holding(phrases, "needle", shown, "hay", 85).groupBy("hay").agg(F.max(F.struct("score", "needle")).alias("x"))
    return shown.join(best.select("hay", "x.score", "x.needle"), "hay").select("id", "hay", "needle", "score")


@query("j5_caption_speech")
def j5(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn as a caption against every window of what the assistant says from 1.5 turns before it to 1.5 after: is it readable, long enough to compare, and derived from speech (J5)?"""
    c = spread(load(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "text", tx.normalize_text(F.col("text")).alias("t"), (F.col("turn") * 1.0).alias("at"))
    known = wording.word_costs(c.select(F.explode(tx.tokens(F.col("text"))).alias("w"))).filter("n >= 2").select("w")
    u = c.filter("role = 'user'").select("conv_id", "turn", "text", "t", "at", F.concat_ws(":", "conv_id", "turn").alias("id"))
    judged = wording.readability(u, "id", "text", known).select("id", "verdict")
    near = u.select("id", "conv_id", "at", F.explode(F.sequence(F.floor(F.col("at") - 1.5).cast("long"), F.ceil(F.col("at") + 1.5).cast("long"))).alias("bin"))
    s = c.filter("role = 'assistant'").select("conv_id", F.col("t").alias("said"), F.col("at").cast("long").alias("bin"), F.col("at").alias("at_b"))
    heard = near.join(s, ["conv_id", "bin"]).filter("abs(at - at_b) <= 1.5")  # three turns at most
    heard = heard.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at_b", "said")))["said"], " ").alias("speech"))
    rows = u.join(judged, "id").join(heard, "id", "left")
    short = (F.length("t") < spoken.LEAST_CHARS) | (F.size(F.split("t", " ")) < spoken.LEAST_WORDS)
    silent = F.coalesce(F.trim("speech"), F.lit("")) == ""
    state = F.when(F.col("verdict") == "unreadable", "unreadable").when(short, "unknown").when(silent, "confirmed_independent")

    @F.pandas_udf("score int, method string, window string")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = iter(spoken.best_windows([(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None], begin=spoken.every_start))
        return pd.DataFrame([(None, None, None) if x is None or y is None else next(found) or (None, None, None) for x, y in zip(a, b, strict=True)], columns=["score", "method", "window"])

    scored = spread(rows.withColumn("state", state), "id").withColumn("x", run(F.when(F.col("state").isNull(), F.col("t")), F.col("speech")))
    score = F.when(silent & (F.col("state") == "confirmed_independent"), 0).otherwise(F.col("x.score"))
    derived = F.when(F.col("x.score") >= spoken.DERIVED, "derived_from_speech").otherwise("confirmed_independent")
    return scored.select("conv_id", "turn", F.coalesce("state", derived).alias("independence"), score.alias("score"), "x.method", "x.window")


@query("j16_fingerprint_components")
def j16(spark: SparkSession, d: str) -> DataFrame:
    """Part names in components of token_set_ratio from 88 on, by rounds of least labels."""
    n = load(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    e = matching.alike(n, "a", n, "a", 88, "token_set").filter("a <> b").select("a", "b").checkpoint()
    label = n.withColumn("label", F.col("a"))
    while True:
        best = e.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        new = label.join(best, "a", "left").select("a", F.least("label", F.coalesce("m", "label")).alias("label")).checkpoint()
        if new.join(label.withColumnRenamed("label", "old"), "a").filter("label <> old").isEmpty():
            return new
        label = new


@query("j17_contradicting_topics")
def j17(spark: SparkSession, d: str) -> DataFrame:
    """The first part name that an off-topic name resembles from 82 on."""
    n = load(spark, d, "part").select("p_name", "p_type")
    s = matching.alike(n.filter("p_type = 'ECONOMY'"), "p_name", n.filter("p_type <> 'ECONOMY'"), "p_name", 82, "token_set").filter("a <> b")
    return s.groupBy(F.col("a").alias("missing")).agg(F.min("b").alias("passed"))


def _alike(least: float, a: str, b: str) -> bool:
    return fuzzy.ratio(a, b) >= least


@query("w2_event_merge")
def w2(spark: SparkSession, d: str) -> DataFrame:
    """Adjacent events of a kind that bring no new fact, a day apart at most."""
    said = F.get(F.array(*map(F.lit, SEEN)), F.col("k") % len(SEEN))
    t = timeline(spark, d).select("video", F.col("event_id").alias("id"), F.col("t0").alias("start"), F.col("t1").alias("end"), F.lit("held").alias("kind"), said.alias("text"))
    return sq.streamed(t, ["video"], ["start", "id"], lambda rows: sq.merge_events(rows, 86_400_000), "video long, id long, start long, end long, kind string, text string, n long")


SEEN = ["a woman holds the white jar", "the woman is holding the jar", "she continues holding the white jar", "she turns the jar to show the label", "the label is shown"]
CAPTIONS = ["save", "save now", "save now 20", "save now 30", "s ave now"]


def one_caption(a: dict, b: dict) -> bool:
    return sq.one_caption(a["text"], (a["x0"], 0, a["x1"], 10), b["text"], (b["x0"], 0, b["x1"], 10))


@query("w3_text_intervals")
def w3(spark: SparkSession, d: str) -> DataFrame:
    """Sightings of captions as intervals; several may be open at once, some grow, some only differ by a number."""
    text, x0 = F.get(F.array(*map(F.lit, CAPTIONS)), F.col("k") % len(CAPTIONS)), (F.col("event_id") % 3 * 4).cast("double")
    t = timeline(spark, d).select("video", "event_id", F.col("t0").alias("t"), text.alias("text"), (F.col("value") / 500).alias("confidence"), x0.alias("x0"), (x0 + F.length(text) * 5).alias("x1"))
    made = sq.streamed(t, ["video"], ["t", "text", "event_id"], lambda rows: ({k: v for k, v in o.items() if k != "event_id"} for o in sq.text_intervals(rows, 86_400_000 * 3, one_caption)), "video long, start long, end long, text string, x0 double, x1 double, n long, best double")
    number = F.row_number().over(Window.partitionBy("video").orderBy("start", "end", "text", "x0"))
    return made.select("video", number.alias("number"), "start", "end", "text", "n", "best")


@query("w3_exact_text", f"""WITH {TIMELINE}, f AS (SELECT *, CASE WHEN t0 - lag(t0) OVER (PARTITION BY video, modality ORDER BY t0) <= 259200000 THEN 0 ELSE 1 END AS nw FROM tl), i AS (SELECT *, sum(nw) OVER (PARTITION BY video, modality ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS g FROM f)
    SELECT video, modality, min(t0) AS start, max(t0) AS finish, count(*) AS n FROM i GROUP BY video, modality, g HAVING count(*) >= 2 OR max(value) >= 425""")
def w3_exact(spark: SparkSession, d: str) -> DataFrame:
    """The relational case of W3: equal texts only."""
    from tidemark.operators import intervals as iv

    i = iv.islands(timeline(spark, d).withColumn("te", F.col("t0")), ["video", "modality"], "t0", "te", 259_200_000)
    g = i.groupBy("video", "modality", "island").agg(F.min("t0").alias("start"), F.max("t0").alias("finish"), F.count("*").alias("n"), F.max("value").alias("best"))
    return g.filter("n >= 2 or best >= 425").drop("island", "best")


def _near(a: list, b: list) -> bool:
    return sum(abs(x - y) >= 0.15 for x, y in zip(a, b, strict=True)) < 40


@query("w9_duplicate_run_cap")
def w9(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a label as frames: like the last read one they are skipped, three times in a row at most."""
    e = load(spark, d, "embeddings").select("label", F.col("vec_id").alias("idx"), F.col("embedding").alias("frame"))
    return sq.streamed(e, ["label"], ["idx"], lambda rows: sq.read_frames(rows, _near), "label int, idx long, read boolean")


@query("x7_near_duplicate", "SELECT vec_id, len(list_filter(list_zip(embedding, nxt), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE) >= 0.15)) AS changed FROM (SELECT vec_id, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings) WHERE nxt IS NOT NULL")
def x7(spark: SparkSession, d: str) -> DataFrame:
    """How many components change to the next vector of a label."""
    e = load(spark, d, "embeddings").withColumn("nxt", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).filter("nxt is not null")
    diff = F.zip_with("embedding", "nxt", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    return e.select("vec_id", F.size(F.filter(diff, lambda x: x >= 0.15)).alias("changed"))


@query("k7_shot_coverage")
def k7(spark: SparkSession, d: str) -> DataFrame:
    """Forty records a video: critical windows, uncovered shots, an even fill."""
    from tidemark.operators import intervals as iv

    t = iv.islands(timeline(spark, d), ["video"], "t0", "t1", 3_600_000)
    t = t.select("video", F.col("event_id").alias("idx"), F.col("t0").alias("t"), F.col("island").alias("shot"), F.when(F.col("modality") == "signup", "scene_change").otherwise("uniform").alias("reason"), F.when(F.col("t0") < 172_800_000, "hook").alias("critical"))

    def run(rows: list[dict]) -> list[dict]:
        return [{"video": rows[0]["video"]} | r for r in sq.cover_shots(rows, 5, 40)]

    return sq.per_key(t, ["video"], run, "video long, idx long, why string")


@query("j13_option_inventory")
def j13(spark: SparkSession, d: str) -> DataFrame:
    """Names of a brand claim like names of its type's list, one to one; unclaimed ones are added."""
    p = load(spark, d, "part").select("p_brand", "p_name", F.col("p_partkey").alias("pos"), (F.col("p_partkey") % 2 == 0).alias("wanted"))

    def run(rows: list[dict]) -> list[dict]:
        side = lambda on: [{"pos": r["pos"], "text": r["p_name"]} for r in rows if r["wanted"] == on]
        return [{"p_brand": rows[0]["p_brand"]} | r for r in sq.claim_options(side(True), side(False), partial(_alike, 90))]

    return sq.per_key(p, ["p_brand"], run, "p_brand string, text string, option string, added boolean")


@query("r33_rule_merge")
def r33(spark: SparkSession, d: str) -> DataFrame:
    """Prohibitions of a brief that share 60 % of the smaller hint set, or are about figures of one claim class, merge."""
    t = F.col("text")
    made = {"hints": cues.match_hints(t), "classes": cues.claim_classes(t), "figures": F.exists(tx.figures(t), lambda f: f.unit != "")}
    a = inferred(spark, d, made).filter("polarity = 'forbidden' or id % 3 = 0").select((F.col("id") % 4).alias("grp"), "id", "text", *made)
    return sq.streamed(a.withColumn("size", -F.length("text")), ["grp"], ["size", "id"], sq.merge_rules, "grp long, id long, text string, hints string, merged long")


@query("box_lines")
def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Word boxes of a brand's parts grouped into lines."""
    p = load(spark, d, "part").select("p_brand", F.col("p_partkey").alias("id"), (F.col("p_size") * 1.0).alias("x0"), (F.col("p_partkey") % 7 * 10.0).alias("y0"), (F.col("p_size") + 3.0).alias("x1"), (F.col("p_partkey") % 7 * 10 + 8.0).alias("y1"))
    return sq.streamed(p, ["p_brand"], ["x0", "y0", "id"], sq.box_lines, "p_brand string, id long, line long")


@query("f14_restore_spaces")
def f14(spark: SparkSession, d: str) -> DataFrame:
    """Names and calls without their spaces, split again by known phrases, else at the cheapest split by the corpus's own words."""
    p = load(spark, d, "part")
    costs = wording.word_costs(p.select(F.explode(F.split("p_name", " ")).alias("w")))
    joined = F.regexp_replace("p_name", " ", "")
    run = F.when(F.col("p_partkey") % 11 == 0, "LINKinBIO now").when(F.col("p_partkey") % 7 == 0, F.concat(F.initcap(joined), F.lit("-20%off"))).otherwise(joined)
    return wording.restored(spark, p.select("p_partkey", run.alias("run")), "p_partkey", "run", costs).withColumnRenamed("text", "run")


@query("f32_brand_correction")
def f32(spark: SparkSession, d: str) -> DataFrame:
    """A misspelt name with the best known name from 85 on, the text itself kept."""
    p = load(spark, d, "part")
    said = p.select("p_partkey", F.regexp_replace("p_name", "i", "1").alias("said"))
    best = matching.alike(said, "said", p, "p_name", 85).groupBy("a").agg(F.max_by("b", F.struct("score", "b")).alias("term"), F.max("score").alias("score"))
    return said.join(best.withColumnRenamed("a", "said"), "said").select("p_partkey", "said", "term", "score")


@query("x3_stage_keys", "SELECT doc_id, substr(sha256('{\"config\":{\"lang\":\"' || lang || '\",\"n\":' || n_chars || '},\"inputs\":[\"a' || doc_id || '\",\"b' || doc_id || '\"],\"stage\":\"text\",\"version\":\"1.0\"}'), 1, 16) AS key FROM documents")
def x3(spark: SparkSession, d: str) -> DataFrame:
    """16-digit keys of a stage over its sorted inputs and canonical configuration."""
    config = F.struct(F.col("lang"), F.col("n_chars").alias("n"))
    inputs = F.array(F.concat(F.lit("b"), F.col("doc_id").cast("string")), F.concat(F.lit("a"), F.col("doc_id").cast("string")))
    return load(spark, d, "documents").select("doc_id", hashing.stage_key("text", "1.0", inputs, config).alias("key"))


@query("j15_requirement_merge")
def j15(spark: SparkSession, d: str) -> DataFrame:
    """Requirements of a brief that are alike at 88 or share 0.8 of their content tokens merge into the first that stays; alternatives of a choice don't."""
    t, at = F.col("text"), F.col("id")
    a = inferred(spark, d, {"hints": cues.match_hints(t), "classes": cues.claim_classes(t)}).select(
        F.expr("id div 120").alias("brief"), "id", "kind", "text", F.when(at % 13 == 0, F.concat(F.lit("c"), (at % 39).cast("string"))).alias("choice"), "priority", F.coalesce("mode", F.lit("any")).alias("mode"),
        F.when(at % 5 == 0, at % 30 + 3).alias("deadline"), F.when(at % 7 == 3, F.concat(F.lit("0-"), (at % 9).cast("string"))).alias("window"),
        "hints", F.array(F.concat_ws(" ", F.lit("see"), F.col("kind"))).alias("criteria"), "classes",
    )
    m = selection.merge_requirements(a)
    return m.select("brief", "id", "ordinal", "choice", "alone", "priority", "mode", "deadline", "window", *(F.array_join(c, ",").alias(c) for c in ("hints", "criteria", "classes", "merged")))
