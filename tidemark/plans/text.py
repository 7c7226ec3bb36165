"""Text: F1, F2, F4, F12, F13, F15, F16, F18, F20, F25, F29, F31, F33, P3, P4, P6, P7, P13, P14, P16-P18, P20, A22, A24, W4, W10, W14, J3, J12, J14, J15, S14, S16, SO2, SO3, SO6, X13-X16, X33."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import cues, phrases, structure
from tidemark.functions import lexicon as lx
from tidemark.functions import text as tx
from tidemark.operators import matching, ranking, wording
from tidemark.registry import query
from tidemark.tables import ASKS_SQL, BRIEF_LINES_SQL, asks, brief_lines, load, per_text, spread

PUNCT = r"""[!"#''()*,./:;<=>?@\[\\\]^_`{|}~-]"""


def tok(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '{PUNCT}', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({tok(x)}, ' '), lambda z: z <> '')"


STOP = "['" + "','".join(lx.STOP_WORDS) + "']"


def content(x: str) -> str:
    """Content tokens of an expression that is normalised text."""
    return f"list_filter(string_split({x}, ' '), lambda z: regexp_matches(z, '[0-9]') OR (length(z) >= 3 AND NOT list_contains({STOP}, z)))"


_ONES = "['one','two','three','four','five','six','seven','eight','nine']"
_TENS = "['twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety']"
_BELOW = "['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen']"


def norm(name: str, source: str) -> str:
    """A table of that name: the columns of `source`, with its column x as normalised text `norm`."""
    tens, ones = "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety", "one|two|three|four|five|six|seven|eight|nine"
    ten = lambda z: f"(10 + 10 * list_position({_TENS}, {z}))"
    one = lambda z: f"list_position({_ONES}, {z})"
    return f"""{name}_w AS (SELECT * EXCLUDE (x), string_split({tok("regexp_replace(x, '[-‐‑–—]', ' ', 'g')")}, ' ') AS w FROM ({source})),
    {name} AS (SELECT * EXCLUDE (w), trim(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(w, lambda z, i: CASE
      WHEN list_contains({_ONES}, z) AND list_contains({_TENS}, w[i - 1]) THEN NULL
      WHEN z = 'hundred' AND list_contains({_ONES}, w[i - 1]) AND NOT (i > 2 AND coalesce(list_contains({_TENS}, w[i - 2]), false)) THEN NULL
      WHEN list_contains({_TENS}, z) AND list_contains({_ONES}, w[i + 1]) THEN CAST({ten('z')} + {one('w[i + 1]')} AS VARCHAR)
      WHEN list_contains({_ONES}, z) AND w[i + 1] = 'hundred' THEN CAST(100 * {one('z')} AS VARCHAR)
      WHEN regexp_full_match(z, '({tens})({ones})') THEN CAST({ten(f"regexp_extract(z, '^({tens})', 1)")} + {one(f"regexp_extract(z, '({ones})$', 1)")} AS VARCHAR)
      WHEN list_contains({_BELOW}, z) THEN CAST(list_position({_BELOW}, z) - 1 AS VARCHAR) WHEN list_contains({_TENS}, z) THEN CAST({ten('z')} AS VARCHAR) WHEN z = 'hundred' THEN '100' ELSE z END),
      lambda z: z IS NOT NULL), ' '), '([0-9]) +%', '\\1%', 'g'), '\\$ +([0-9])', '$\\1', 'g')) AS norm FROM {name}_w)"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents")


@query("f1_normalize_token", f"SELECT doc_id, md5({tok('text')}) AS h FROM documents")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5(tx.normalize_token(F.col("text"))).alias("h"))


NUMBERS = " twenty-five % off, $ 5 for two hundred or three; 20 % fortytwo, ninety nine hundred and zero - seventy"


@query("f2_normalize_text", f"WITH {norm('n', f"SELECT item_id, text || '{NUMBERS}' AS x FROM benchmark")} SELECT item_id, norm FROM n")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark").select("item_id", tx.normalize_text(F.concat("text", F.lit(NUMBERS))).alias("norm"))


@query("f4_despace", "SELECT doc_id, length(regexp_replace(text, '[ \\t\\n\\r]+', '', 'g')) AS n FROM documents")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.length(tx.despace(F.col("text"))).alias("n"))


@query("f12_content_tokens", f"WITH {norm('n', 'SELECT doc_id, text AS x FROM documents')}, c AS (SELECT doc_id, {content('norm')} AS c FROM n) SELECT doc_id, len(c) AS n, len(list_distinct(c)) AS kinds FROM c")
def f12(spark: SparkSession, d: str) -> DataFrame:
    both = tx.bound(tx.content_tokens(F.col("text")), lambda c: F.struct(F.size(c).alias("n"), F.size(F.array_distinct(c)).alias("kinds")))
    return docs(spark, d).select("doc_id", both.alias("x")).select("doc_id", "x.*")


@query(
    "f13_digits",
    f"""WITH {ASKS_SQL}, r AS (SELECT id, text, regexp_extract_all(text, '[0-9]+') AS have, regexp_extract_all('20% off use code save30', '[0-9]+') AS offer FROM asks)
    SELECT id, array_to_string(have, ',') AS runs, len(have) > 0 AND have <> offer AS conflict, len(list_filter(have, lambda x: NOT list_contains(offer, x))) > 0 AS missing FROM r""",
)
def f13(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of an ask; whether an offer has others, and whether it lacks one that is asked for."""
    offer, t = F.lit("20% off use code save30"), F.col("text")
    return asks(spark, d).select("id", F.array_join(tx.digit_runs(t), ",").alias("runs"), tx.digits_conflict(t, offer).alias("conflict"), tx.digits_missing(t, offer).alias("missing"))


TERMS = ["heal", "27.5", "20%", "premium", "score", "$ 5", "cure"]


def _word_sql(term: str, hay: str) -> str:
    import re

    return f"regexp_matches(' ' || {hay}, '{'' if not term[0].isalnum() else '[^a-z0-9_]'}{re.escape(term)}(s|es|ed|d|ing)?([^a-z0-9_]|$)')"


@query("f16_term_hit", f"WITH {ASKS_SQL} SELECT id, " + ", ".join(f"{_word_sql(t, 'lower(text)')} AS t{i}" for i, t in enumerate(TERMS) if t[0] != "$") + " FROM asks")
def f16(spark: SparkSession, d: str) -> DataFrame:
    """Terms as words with a plain inflection: heal is in heals and healing, not in healthy."""
    return asks(spark, d).select("id", *(tx.word_hit(F.lower("text"), F.lit(t)).alias(f"t{i}") for i, t in enumerate(TERMS) if t[0] != "$"))


FIG = r"'([0-9]+(?:[.,][0-9]+)?)\s*(?:(%)|(percent|pct|days?|weeks?|months?|years?|hours?|minutes?|times?|x)\b)?'"
UNIT_SQL = "CASE WHEN u IN ('%', 'percent', 'pct') THEN 'pct' WHEN u = 'x' OR u = 'times' THEN 'times' WHEN u = 'time' THEN '' WHEN u = '' THEN '' WHEN u LIKE '%s' THEN u ELSE u || 's' END"


def figures_sql(name: str, source: str) -> str:
    """A table of that name: the columns of `source`, with a row of pos, value and unit for each figure in its column x."""
    return f"""{name}_r AS (SELECT * EXCLUDE (x), unnest(regexp_extract_all(lower(x), {FIG}, 1)) AS v, unnest(regexp_extract_all(lower(x), {FIG}, 2)) AS s, unnest(regexp_extract_all(lower(x), {FIG}, 3)) AS n, generate_subscripts(regexp_extract_all(lower(x), {FIG}, 1), 1) AS pos FROM ({source})),
    {name} AS (SELECT * EXCLUDE (v, s, n, u), CAST(replace(v, ',', '') AS DOUBLE) AS value, {UNIT_SQL} AS unit FROM (SELECT *, coalesce(s, '') || coalesce(n, '') AS u FROM {name}_r))"""


@query("f18_figures", f"WITH {ASKS_SQL}, {figures_sql('f', 'SELECT id, text AS x FROM asks')} SELECT id, CAST(pos AS INTEGER) AS pos, value, unit FROM f")
def f18(spark: SparkSession, d: str) -> DataFrame:
    """Figures of an ask in order, with canonical units."""
    f = asks(spark, d).select("id", F.posexplode(tx.figures(F.col("text"))).alias("pos", "f"))
    return f.select("id", (F.col("pos") + 1).alias("pos"), "f.value", "f.unit")


@query("f20_strip_markdown", r"""SELECT page_id, url || ' a b is c x_y 2 * 3' AS t FROM pages""")
def f20(spark: SparkSession, d: str) -> DataFrame:
    """Marks go, their texts stay; what isn't a pair of marks is left (the SQL states the plain text)."""
    made = F.concat(F.lit(" **"), "url", F.lit("** [a `b`]("), "url", F.lit(") __is__ *c* x_y 2 * 3"))
    return load(spark, d, "pages").select("page_id", tx.strip_markdown(made).alias("t"))


@query("f25_reference_links", """WITH x AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages), y AS (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS pos FROM x) SELECT page_id, link, CAST(min(pos) AS INTEGER) AS pos FROM y GROUP BY ALL""")
def f25(spark: SparkSession, d: str) -> DataFrame:
    """Links of a page once each, with the place of the first."""
    x = load(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "link"))
    return ranking.distinct_in_order(x, ["page_id"], "link", "pos").withColumn("pos", F.col("pos") + 1)


def _has(patterns: list[str], x: str = "text") -> str:
    return f"regexp_matches({x}, '{lx.any_of(patterns).replace("'", "''")}')"


_MODE = f"""CASE WHEN {_has(lx.SPEECH)} THEN CASE WHEN {_has(lx.VISUAL)} THEN 'visual_and_speech' WHEN {_has(lx.WRITTEN)} THEN 'speech_or_text' ELSE 'speech_only' END
  WHEN {_has(lx.WRITTEN)} THEN 'ocr_only' WHEN {_has(lx.VISUAL)} THEN CASE WHEN {_has(lx.READABLE)} THEN 'speech_or_text' ELSE 'visual_only' END END"""
_POLARITY = f"CASE WHEN {_has(lx.NEGATION)} AND NOT ({_has(lx.NOT_NEGATION)} AND NOT {_has([x for x in lx.NEGATION if 'no claims' not in x])}) THEN 'forbidden' ELSE 'required' END"
_TYPE = (
    "CASE "
    + " ".join(f"WHEN {_has(ps, f"regexp_replace(text, '(?i){lx.TO_CAMERA}', ' ', 'g')" if k == 'audience' else 'text')} THEN '{k}'" for k, ps in lx.TYPES.items())
    + " WHEN mode = 'speech_only' THEN 'speech' WHEN mode = 'visual_only' THEN 'visual' WHEN mode IN ('ocr_only', 'speech_or_text') THEN 'speech_or_text' WHEN mode = 'visual_and_speech' THEN 'demonstration' ELSE 'other' END"
)
_PRIORITY = f"""CASE WHEN {_has(lx.IMPERATIVE)} THEN CASE WHEN kind = 'policy' OR polarity = 'forbidden' THEN 'critical' ELSE 'high' END WHEN {_has(lx.SOFTENED)} THEN 'low' WHEN {_has(lx.PREFERENCE)} THEN 'medium'
  WHEN kind = 'policy' OR polarity = 'forbidden' THEN 'critical' WHEN kind IN ('hook', 'cta', 'visual', 'demonstration') THEN 'high' ELSE 'medium' END"""
_CHECK = f"NOT {_has(lx.VAGUE)} OR {_has([*lx.READABLE, '[0-9]', '"[^"]+"', '“[^”]+”'])} OR kind IN ('visual', 'demonstration', 'speech', 'speech_or_text', 'cta', 'policy')"
INFERRED = f"{ASKS_SQL}, m AS (SELECT *, {_MODE} AS mode, {_POLARITY} AS polarity FROM asks), t AS (SELECT *, {_TYPE} AS kind FROM m), inferred AS (SELECT *, {_PRIORITY} AS priority, {_CHECK} AS checkable FROM t)"


def inferred(spark: SparkSession, d: str, more: dict[str, Column] | None = None) -> DataFrame:
    """Asks with mode, polarity, kind, priority and checkable, and what `more` makes of these and the text: once a distinct text."""
    t = F.col("text")

    def of(x: DataFrame) -> DataFrame:
        x = x.withColumns({"mode": cues.evidence_mode(t), "polarity": cues.polarity(t)}).withColumn("kind", cues.requirement_type(t, F.col("mode")))
        x = x.withColumns({"priority": cues.priority(t, F.col("kind"), F.col("polarity")), "checkable": cues.machine_checkable(t, F.col("kind"))})
        return x.withColumns(more or {})

    return per_text(asks(spark, d), "text", of)


@query("f29_infer_type", f"WITH {INFERRED} SELECT id, mode, polarity, kind, priority, array_to_string(CASE WHEN len(cs) = 0 THEN ['other'] ELSE cs END, ',') AS claims FROM (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {_has(ps)} THEN '{k}' END" for k, ps in lx.CLAIM_CLASSES.items()) + "], lambda x: x IS NOT NULL) AS cs FROM inferred)")
def f29(spark: SparkSession, d: str) -> DataFrame:
    """Mode, polarity, type, priority and claim classes by ladders of cues."""
    return inferred(spark, d, {"claims": F.array_join(cues.claim_classes(F.col("text")), ",")}).select("id", "mode", "polarity", "kind", "priority", "claims")


@query("f31_html_guard", """SELECT page_id, regexp_matches(lower(substr(trim(html), 1, 200)), '^<!doctype html|^<html|<head>') AS is_html, length(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS n, (page_id // 60) || ':' || lpad(CAST(page_id % 60 AS VARCHAR), 2, '0') AS clock FROM pages""")
def f31(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", tx.looks_like_html(F.col("html")).alias("is_html"), F.length(tx.escape_html(F.col("html"))).alias("n"), tx.clock(F.col("page_id")).alias("clock"))


@query("f33_hash_ids", "SELECT doc_id, 'r_' || substr(sha256(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), 1, 8) AS rid FROM documents")
def f33(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.concat(F.lit("r_"), F.substring(F.sha2(F.regexp_replace("text", r"[ \t\n\r]+", " "), 256), 1, 8)).alias("rid"))


@query("p3_preflight", "SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars > 8000 THEN 'TOO_LONG' END, CASE WHEN n_chars < 300 THEN 'TOO_SHORT' END, CASE WHEN lang <> 'en' THEN 'NOT_ENGLISH' END, CASE WHEN length(text) <> n_chars THEN 'LENGTH_MISMATCH' END], lambda x: x IS NOT NULL), ',') AS codes FROM documents")
def p3(spark: SparkSession, d: str) -> DataFrame:
    """All failed checks of a document, in order."""
    c = [F.when(F.col("n_chars") > 8000, "TOO_LONG"), F.when(F.col("n_chars") < 300, "TOO_SHORT"), F.when(F.col("lang") != "en", "NOT_ENGLISH"), F.when(F.length("text") != F.col("n_chars"), "LENGTH_MISMATCH")]
    return docs(spark, d).select("doc_id", F.array_join(F.array_compact(F.array(*c)), ",").alias("codes"))


REASON = "CASE WHEN length(trim(text)) = 0 THEN 'EMPTY' WHEN doc_id % 17 = 0 THEN 'NO_SPEECH_PROB' WHEN n_chars < 100 THEN 'LOW_LOGPROB' WHEN n_chars > 15000 THEN 'HIGH_COMPRESSION' END"


@query(
    "p4_segment_filter",
    f"""WITH r AS (SELECT *, {REASON} AS why FROM documents), k AS (SELECT doc_id, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM r WHERE why IS NULL AND NOT contains(lower(text), 'rights reserved'))
    SELECT r.doc_id, CASE WHEN why IS NOT NULL THEN why WHEN contains(lower(text), 'rights reserved') THEN 'HALLUCINATION_PHRASE' WHEN k.prev = r.text THEN 'REPEATED' END AS reason FROM r LEFT JOIN k ON k.doc_id = r.doc_id""",
)
def p4(spark: SparkSession, d: str) -> DataFrame:
    """Metric rules, the phrase rule, then repeats of the last kept text of a source."""
    why = F.when(F.length(F.trim("text")) == 0, "EMPTY").when(F.col("doc_id") % 17 == 0, "NO_SPEECH_PROB").when(F.col("n_chars") < 100, "LOW_LOGPROB").when(F.col("n_chars") > 15000, "HIGH_COMPRESSION")
    why = F.coalesce(why, F.when(F.contains(F.lower("text"), F.lit("rights reserved")), "HALLUCINATION_PHRASE"))
    r = docs(spark, d).select("doc_id", "source", F.md5("text").alias("h"), why.alias("why"))
    rows = r.withColumn("kept", F.col("why").isNull())
    prev = F.lag("h").over(Window.partitionBy("source", "kept").orderBy("doc_id"))
    return rows.withColumn("prev", prev).select("doc_id", F.when(F.col("why").isNotNull(), F.col("why")).when(F.col("prev") == F.col("h"), "REPEATED").alias("reason"))


@query("a24_reason_histogram", f"SELECT coalesce({REASON}, 'KEPT') AS reason, count(*) AS n, round_even(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY 1")
def a24(spark: SparkSession, d: str) -> DataFrame:
    why = F.when(F.length(F.trim("text")) == 0, "EMPTY").when(F.col("doc_id") % 17 == 0, "NO_SPEECH_PROB").when(F.col("n_chars") < 100, "LOW_LOGPROB").when(F.col("n_chars") > 15000, "HIGH_COMPRESSION").otherwise("KEPT")
    return docs(spark, d).groupBy(why.alias("reason")).agg(F.count("*").alias("n"), F.bround(F.avg("n_chars"), 4).alias("mean_chars"))


@query("p7_confidence_filter", "SELECT event_id, value < 50 AS flagged FROM events WHERE value >= 30 AND length(event_type) >= 4")
def p7(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").filter("value >= 30 and length(event_type) >= 4").select("event_id", (F.col("value") < 50).alias("flagged"))


MASKS = [("top", 0.0, 0.0, 1.0, 0.18), ("bottom", 0.0, 0.85, 1.0, 1.0), ("corner", 0.9, 0.0, 1.0, 1.0)]


@query("p8_region_masks", "WITH b AS (SELECT p_partkey, (p_size * 37 % 100) / 100.0::DOUBLE AS x, (p_partkey * 13 % 100) / 100.0::DOUBLE AS y FROM part) SELECT p_partkey, CASE WHEN y <= 0.18 THEN 'top' WHEN y >= 0.85 THEN 'bottom' WHEN x >= 0.9 THEN 'corner' END AS mask FROM b")
def p8(spark: SparkSession, d: str) -> DataFrame:
    """The first mask that a box's centre lies in; null keeps it."""
    b = load(spark, d, "part").select("p_partkey", ((F.col("p_size") * 37 % 100) / 100.0).alias("x"), ((F.col("p_partkey") * 13 % 100) / 100.0).alias("y"))
    mask = F.lit(None).cast("string")
    for name, x0, y0, x1, y1 in reversed(MASKS):
        mask = F.when(F.col("x").between(x0, x1) & F.col("y").between(y0, y1), name).otherwise(mask)
    return b.select("p_partkey", mask.alias("mask"))


@query("p13_machine_checkable", f"WITH {INFERRED} SELECT id, checkable FROM inferred")
def p13(spark: SparkSession, d: str) -> DataFrame:
    return inferred(spark, d).select("id", "checkable")


@query("p15_scorable", f"WITH {INFERRED} SELECT id, checkable AND kind <> 'other' AS scorable FROM inferred")
def p15(spark: SparkSession, d: str) -> DataFrame:
    """Machine-checkable and not of the type `other`."""
    return inferred(spark, d).select("id", (F.col("checkable") & (F.col("kind") != "other")).alias("scorable"))


@query("p14_figure_rule", f"WITH {INFERRED}, {norm('n', 'SELECT id, polarity, text AS x FROM inferred')}, h AS (SELECT id, polarity, list_filter({content('norm')}, lambda z: length(z) > 2) AS hints FROM n) SELECT id, polarity = 'forbidden' AND len(hints) > 0 AND len(list_filter(hints, lambda z: regexp_matches(z, '[0-9]'))) * 2 >= len(hints) AS figure_rule FROM h")
def p14(spark: SparkSession, d: str) -> DataFrame:
    """A prohibition at least half of whose hints have a digit."""
    h = inferred(spark, d).select("id", "polarity", F.filter(tx.content_tokens(F.col("text")), lambda z: F.length(z) > 2).alias("hints"))
    return h.select("id", ((F.col("polarity") == "forbidden") & (F.size("hints") > 0) & (F.size(F.filter("hints", lambda x: x.rlike("[0-9]"))) * 2 >= F.size("hints"))).alias("figure_rule"))


@query("p16_non_english", rf"WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '([a-z'']+)', 1) AS w FROM documents) SELECT doc_id, trim(text) <> '' AND (len(regexp_replace(text, '[^\pL]|[A-Za-z]', '', 'g')) * 100 > len(regexp_replace(text, '[^\pL]', '', 'g')) * 15 OR (len(w) >= 6 AND NOT list_has_any(w, {STOP}))) AS foreign_text FROM w")
def p16(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", tx.non_english(F.col("text")).alias("foreign_text"))


JUDGE = ["trash", "stupid", "worthless", "disgusting", "loser", "idiot"]


@query("p17_judgement_words", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"'{w}'" for w in JUDGE) + "], lambda w: regexp_matches(lower(text), '(^|[^a-z])' || w || '([^a-z]|$)')), ',') AS words FROM documents")
def p17(spark: SparkSession, d: str) -> DataFrame:
    hits = [F.when(F.lower("text").rlike(f"(^|[^a-z]){w}([^a-z]|$)"), w) for w in JUDGE]
    return docs(spark, d).select("doc_id", F.array_join(F.array_compact(F.array(*hits)), ",").alias("words"))


@query("p18_recommendation_guard", f"WITH {ASKS_SQL} SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_]){w}([^a-z0-9_]|$)') THEN '{w}' END" for w in lx.BANNED) + r", CASE WHEN regexp_matches(text, '[0-9]\s?%|\b[0-9]{1,3}\s*(?:out of|/)\s*[0-9]{1,3}\b') THEN 'numeric-score-like' END], lambda x: x IS NOT NULL), ',') AS banned FROM asks")
def p18(spark: SparkSession, d: str) -> DataFrame:
    return asks(spark, d).select("id", F.array_join(cues.banned_wording(F.col("text")), ",").alias("banned"))


@query("p20_coercion", "SELECT event_id, TRY_CAST(regexp_extract(props, '-?[0-9]+') AS INTEGER) AS k, TRY_CAST(event_type AS DOUBLE) AS bad, CASE WHEN isfinite(value) THEN value END AS value FROM events")
def p20(spark: SparkSession, d: str) -> DataFrame:
    """Numbers out of text; what isn't one is null."""
    e = load(spark, d, "events")
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    return e.select("event_id", F.regexp_extract("props", "-?[0-9]+", 0).try_cast("int").alias("k"), F.col("event_type").try_cast("double").alias("bad"), F.when(finite, F.col("value")).alias("value"))


@query("a22_spacing_health", "SELECT source, count(*) FILTER (length(text) > 12) AS n, round_even(CAST(count(*) FILTER (length(text) > 12 AND NOT contains(text, ' ')) AS DOUBLE) / nullif(count(*) FILTER (length(text) > 12), 0), 6) AS unspaced FROM documents GROUP BY source")
def a22(spark: SparkSession, d: str) -> DataFrame:
    long = F.length("text") > 12
    return docs(spark, d).groupBy("source").agg(F.count_if(long).alias("n"), F.bround(F.try_divide(F.count_if(long & ~F.contains("text", F.lit(" "))).cast("double"), F.count_if(long)), 6).alias("unspaced"))


@query("w10_word_index", "WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM conversations) SELECT conv_id, turn, pos, length(word) AS len, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM w")
def w10(spark: SparkSession, d: str) -> DataFrame:
    """Words of utterances with running character offsets."""
    w = load(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    run = F.sum(F.length("word") + 1).over(Window.partitionBy("conv_id", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return w.select("conv_id", "turn", "pos", F.length("word").alias("len"), F.coalesce(run, F.lit(0)).alias("char_start"))


@query("p12_word_window", "WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM conversations) SELECT conv_id, turn, word, turn * 60 + pos AS at FROM w WHERE turn * 60 + pos BETWEEN 50 AND 70")
def p12(spark: SparkSession, d: str) -> DataFrame:
    """Words said between seconds 50 and 70, at one word a second."""
    w = load(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return w.withColumn("at", F.col("turn") * 60 + F.col("pos")).filter("at between 50 and 70").select("conv_id", "turn", "word", "at")


@query("w14_growing_text", "WITH g AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) ELSE text END AS text FROM conversations)) SELECT conv_id, turn, coalesce(starts_with(nxt, text), false) AS grows FROM g")
def w14(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the next row only extends."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = load(spark, d, "conversations").withColumn("text", F.when(F.col("turn") % 2 == 1, F.array_join(F.collect_list("text").over(w.rowsBetween(-1, 0)), " ")).otherwise(F.col("text")))
    return c.select("conv_id", "turn", F.coalesce(F.startswith(F.lead("text").over(w), F.col("text")), F.lit(False)).alias("grows"))


#: Phrases of the stand-in brief.
BRIEF = ["please answer", "twenty-five % off", "what is the", "user question", "thank you"]


@query("j3_phrase_windows")
def j3(spark: SparkSession, d: str) -> DataFrame:
    """Where the phrases of a brief stand in what is said, number spellings and small errors aside (J3). The phrases are a brief's: few."""
    w = spread(load(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn").select("conv_id", "turn", F.filter(F.transform(F.split("text", " "), tx.normalize_token), lambda x: x != "").alias("w"))
    hits = w.withColumn("hit", F.explode(phrases.phrase_hits(F.col("w"), {i: phrases.phrase_variants(p) for i, p in enumerate(BRIEF)})))
    return hits.select("conv_id", "turn", "hit.*")


@query(
    "j3_exact_windows",
    f"""WITH w AS (SELECT doc_id, unnest({toks('text')}) AS t, generate_subscripts({toks('text')}, 1) AS pos FROM documents), v AS (SELECT item_id, unnest({toks('text')}) AS t, generate_subscripts({toks('text')}, 1) AS pos FROM benchmark),
    g AS (SELECT doc_id, pos, t || ' ' || lead(t, 1) OVER w || ' ' || lead(t, 2) OVER w || ' ' || lead(t, 3) OVER w AS gram FROM w WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    b AS (SELECT DISTINCT item_id, gram FROM (SELECT item_id, t || ' ' || lead(t, 1) OVER w || ' ' || lead(t, 2) OVER w || ' ' || lead(t, 3) OVER w AS gram FROM v WINDOW w AS (PARTITION BY item_id ORDER BY pos)))
    SELECT item_id, doc_id, CAST(min(pos) AS INTEGER) AS first_pos, count(*) AS hits FROM g JOIN b USING (gram) WHERE gram IS NOT NULL GROUP BY ALL""",
)
def j3_exact(spark: SparkSession, d: str) -> DataFrame:
    """The relational case of J3: windows of four words that an item and a document share, by a join on their hashes."""
    windows = "transform(sequence(1, size(t) - 3), i -> xxhash64(t[i - 1], t[i], t[i + 1], t[i + 2]))"
    b = load(spark, d, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("t")).filter("size(t) >= 4")
    b = b.select("item_id", F.explode(F.array_distinct(F.expr(windows))).alias("gram"))
    t = docs(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("t")).filter("size(t) >= 4")
    g = t.select("doc_id", F.posexplode(F.expr(windows)).alias("pos", "gram"))
    return g.join(b, "gram").groupBy("item_id", "doc_id").agg((F.min("pos") + 1).alias("first_pos"), F.count("*").alias("hits"))


@query("j12_stray_adoption", "WITH m AS (SELECT item_id, doc_id, count(*) OVER (PARTITION BY item_id) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT item_id, doc_id FROM m WHERE n = 1")
def j12(spark: SparkSession, d: str) -> DataFrame:
    """Items adopted by the one document that contains them; several or none: not at all."""
    m = matching.contained(load(spark, d, "benchmark").select("item_id", F.col("text").alias("item")), "item", docs(spark, d).select("doc_id", "text"), "text", "doc_id")
    return m.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1").select("item_id", "doc_id")


@query(
    "j14_conflicts",
    f"""WITH {norm('c', 'SELECT item_id, item_id % 2 AS polarity, text AS x FROM benchmark')}, b AS (SELECT item_id, polarity, list_distinct({content('norm')}) AS t FROM c), e AS (SELECT item_id, polarity, len(t) AS n, unnest(t) AS tok FROM b)
    SELECT x.item_id AS a, y.item_id AS b, count(*) AS shared FROM e x JOIN e y ON x.tok = y.tok AND x.item_id < y.item_id AND x.polarity <> y.polarity GROUP BY x.item_id, y.item_id, x.n, y.n HAVING count(*) >= 2 AND count(*) * 10 >= least(x.n, y.n)""",
)
def j14(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of opposite polarity that share two content words and a tenth of the smaller set: inverted-index join."""
    b = load(spark, d, "benchmark").select("item_id", (F.col("item_id") % 2).alias("polarity"), F.array_distinct(tx.content_tokens(F.col("text"))).alias("t"))
    e = b.select("item_id", "polarity", F.size("t").alias("n"), F.explode("t").alias("tok"))
    x, y = e.select("tok", *(F.col(c).alias(f"x_{c}") for c in ("item_id", "polarity", "n"))), e.select("tok", *(F.col(c).alias(f"y_{c}") for c in ("item_id", "polarity", "n")))
    j = x.join(y, "tok").filter("x_item_id < y_item_id and x_polarity <> y_polarity").groupBy("x_item_id", "y_item_id", "x_n", "y_n").agg(F.count("*").alias("shared"))
    return j.filter((F.col("shared") >= 2) & (F.col("shared") * 10 >= F.least("x_n", "y_n"))).select(F.col("x_item_id").alias("a"), F.col("y_item_id").alias("b"), "shared")


@query(
    "j15_jaccard_pairs",
    "WITH p AS (SELECT DISTINCT p_brand, p_type, p_name FROM part), s AS (SELECT p_brand, list_sort(list_distinct(list(p_name))) AS names FROM p GROUP BY p_brand), j AS (SELECT x.p_brand AS a, y.p_brand AS b, CAST(len(list_intersect(x.names, y.names)) AS DOUBLE) / len(list_distinct(list_concat(x.names, y.names))) AS jaccard FROM s x JOIN s y ON x.p_brand < y.p_brand) SELECT a, b, round_even(jaccard, 6) AS jaccard FROM j WHERE jaccard > 0",
)
def j15(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of the name sets of brands that share a name: shared names by an inverted index, the union from the sizes."""
    s = load(spark, d, "part").select("p_brand", "p_name").distinct()
    n = s.groupBy("p_brand").agg(F.count("*").alias("n"))
    x, y = s.select(F.col("p_brand").alias("a"), "p_name"), s.select(F.col("p_brand").alias("b"), "p_name")
    both = x.join(y, "p_name").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    j = both.join(n.withColumnsRenamed({"p_brand": "a", "n": "n_a"}), "a").join(n.withColumnsRenamed({"p_brand": "b", "n": "n_b"}), "b")
    return j.select("a", "b", F.bround(F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both")), 6).alias("jaccard"))


@query("s14_document_source", "SELECT page_id, length(replace(replace(chr(65279) || html, chr(65279), ''), chr(13) || chr(10), chr(10))) AS n FROM pages WHERE NOT regexp_matches(lower(url), 'login|signin')")
def s14(spark: SparkSession, d: str) -> DataFrame:
    """BOM and CRLF go; login pages are rejected."""
    raw = F.concat(F.lit("﻿"), "html")
    return load(spark, d, "pages").filter(~F.lower("url").rlike("login|signin")).select("page_id", F.length(F.replace(F.replace(raw, F.lit("﻿"), F.lit("")), F.lit("\r\n"), F.lit("\n"))).alias("n"))


@query("s16_url_map", "WITH u AS (SELECT page_id, regexp_extract(url, '/([0-9]+)(\\?|#|$|/)', 1) AS vid FROM pages), m AS (SELECT page_id, doc_id, row_number() OVER (PARTITION BY page_id ORDER BY doc_id) AS rn FROM u JOIN documents ON vid <> '' AND CAST(doc_id AS VARCHAR) = vid) SELECT page_id, doc_id FROM m WHERE rn = 1")
def s16(spark: SparkSession, d: str) -> DataFrame:
    """The document whose id ends a page's address."""
    u = load(spark, d, "pages").select("page_id", F.regexp_extract("url", r"/([0-9]+)(\?|#|$|/)", 1).alias("vid")).filter("vid <> ''")
    return u.join(docs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("vid")), "vid").groupBy("page_id").agg(F.min("doc_id").alias("doc_id"))


@query("so2_ordered_distinct", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) SELECT doc_id, count(*) AS n, count(DISTINCT line) AS kinds FROM l GROUP BY doc_id")
def so2(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    return docs(spark, d).select("doc_id", F.size(lines).cast("long").alias("n"), F.size(F.array_distinct(lines)).cast("long").alias("kinds"))


@query("so3_token_sets", f"SELECT item_id, len(list_intersect(list_distinct({toks('text')}), {STOP})) AS common, len(list_filter(list_distinct({toks('text')}), lambda x: NOT list_contains({STOP}, x))) AS only_here, len(list_distinct(list_concat({toks('text')}, {STOP}))) AS either FROM benchmark")
def so3(spark: SparkSession, d: str) -> DataFrame:
    t, stop = tx.tokens(F.col("text")), F.array(*map(F.lit, lx.STOP_WORDS))
    return load(spark, d, "benchmark").select("item_id", F.size(F.array_intersect(t, stop)).alias("common"), F.size(F.array_except(t, stop)).alias("only_here"), F.size(F.array_union(t, stop)).alias("either"))


@query("so6_unit_dedupe", "WITH k AS (SELECT doc_id, source, regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g') AS key FROM documents), r AS (SELECT doc_id, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn FROM k) SELECT doc_id FROM r WHERE rn = 1")
def so6(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each normalised text."""
    k = docs(spark, d).select("doc_id", F.md5(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", "")).alias("key"))
    return k.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("x15_fingerprint", "SELECT doc_id, substr(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), 1, 90) || '|' || lang AS fp FROM documents")
def x15(spark: SparkSession, d: str) -> DataFrame:
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", " "), " +", " "))
    return docs(spark, d).select("doc_id", F.concat(F.substring(t, 1, 90), F.lit("|"), "lang").alias("fp"))


@query("x16_headings", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) FILTER (len(string_split(trim(line), ' ')) <= 4 AND NOT regexp_matches(line, '[.]') AND trim(line) <> '') AS headings FROM l GROUP BY doc_id")
def x16(spark: SparkSession, d: str) -> DataFrame:
    """Lines of at most four words without a full stop."""
    on = F.size(F.filter(F.split("text", "\n"), lambda x: (F.size(F.split(F.trim(x), " ")) <= 4) & ~F.contains(x, F.lit(".")) & (F.trim(x) != "")))
    return docs(spark, d).select("doc_id", on.cast("long").alias("headings"))


@query("x33_vocabulary", f"SELECT t AS word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({toks('text')}) AS t FROM documents) GROUP BY t HAVING count(*) >= 20")
def x33(spark: SparkSession, d: str) -> DataFrame:
    """Words that occur 20 times or more."""
    w = docs(spark, d).select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("word"))
    per = w.groupBy("word", "doc_id").agg(F.count("*").alias("c"))
    return per.groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("docs")).filter("n >= 20")


_CALLED = "(" + " OR ".join(f"contains(norm, '{p}')" for p in lx.RUN_TOGETHER) + ")"


@query(
    "f15_readability",
    f"""WITH {norm('n', 'SELECT doc_id, text AS x FROM documents')}, v AS (SELECT t FROM (SELECT unnest({toks('text')}) AS t FROM documents) GROUP BY t HAVING count(*) >= 20),
    r AS (SELECT doc_id, {_CALLED} AS called, list_filter(list_transform(string_split(norm, ' '), lambda z: regexp_replace(z, '[^a-z]', '', 'g')), lambda z: length(z) >= 3) AS ws FROM n),
    j AS (SELECT *, len(ws) >= 2 OR (len(ws) = 1 AND length(ws[1]) >= 8) AS judged FROM r), e AS (SELECT doc_id, unnest(ws) AS t FROM j), h AS (SELECT doc_id, count(v.t) AS hits FROM e LEFT JOIN v USING (t) GROUP BY doc_id),
    s AS (SELECT doc_id, CAST(len(ws) AS INTEGER) AS n_tokens, CAST(CASE WHEN judged THEN CASE WHEN called THEN 100 ELSE round_even(100.0 * hits / len(ws), 0) END END AS INTEGER) AS score FROM j LEFT JOIN h USING (doc_id))
    SELECT *, CASE WHEN score IS NULL THEN 'too_short_to_judge' WHEN score >= 40 THEN 'readable' ELSE 'unreadable' END AS verdict FROM s""",
)
def f15(spark: SparkSession, d: str) -> DataFrame:
    """Share of a text's words that the corpus uses 20 times or more; known phrases are readable, short texts have no verdict."""
    known = wording.word_costs(docs(spark, d).select(F.explode(tx.tokens(F.col("text"))).alias("w"))).filter("n >= 20").select("w")
    return wording.readability(docs(spark, d), "doc_id", "text", known)


_HEAD = f"""CASE WHEN regexp_matches(line, '^#{{1,6}} ') THEN true WHEN regexp_matches(p, '(?i){lx.REFERENCE}') OR regexp_matches(p, '{lx.ONLY_LINK}') THEN false
  WHEN length(p) > 90 OR regexp_matches(p, '(?i){lx.BULLET}') OR regexp_matches(p, '^["“”''‘’(]') OR regexp_matches(p, '["“”]') OR n > 12 OR (n > 3 AND {_has(lx.ACTION, 'p')}) THEN false
  WHEN regexp_matches(p, ':$') THEN true WHEN regexp_matches(p, '[.!?,;]$') THEN false
  ELSE length(regexp_replace(p, '[^A-Z]', '', 'g')) > 0.6 * length(regexp_replace(p, '[^A-Za-z]', '', 'g')) OR len(list_filter(string_split(p, ' '), lambda w: regexp_matches(w, '^[A-Z]'))) >= greatest(1, n - 2) OR (n <= 6 AND {_has([x for ps in lx.SECTION_KINDS.values() for x in ps], 'p')}) END"""
HEADS = f"""{BRIEF_LINES_SQL}, pl AS (SELECT *, trim(regexp_replace(line, '^#+ ', '')) AS p, len(string_split(trim(regexp_replace(line, '^#+ ', '')), ' ')) AS n FROM bl WHERE NOT regexp_matches(line, '{lx.PAGE_RULE}')), hl AS (SELECT doc, pos, p, {_HEAD} AS head FROM pl)"""
_KIND = "CASE " + " ".join(f"WHEN {_has(ps, 'heading')} THEN '{k}'" for kinds in (lx.SECTION_FIRST, lx.SECTION_KINDS) for k, ps in kinds.items()) + " WHEN n_lines = 0 THEN 'context' ELSE 'requirements' END"


@query(
    "f22_sections",
    f"""WITH {HEADS}, s AS (SELECT *, NOT head AND (regexp_matches(p, '(?i){lx.REFERENCE}') OR regexp_matches(p, '{lx.ONLY_LINK}')) AS ref, sum(head::INT) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM hl),
    g AS (SELECT doc, section, coalesce(max(regexp_replace(p, ':+$', '')) FILTER (head), '') AS heading, count(*) FILTER (NOT head AND NOT ref) AS n_lines, count(*) FILTER (ref) AS n_refs, coalesce(string_agg(p, '|' ORDER BY pos) FILTER (NOT head AND NOT ref), '') AS lines FROM s GROUP BY ALL)
    SELECT doc, CAST(section AS BIGINT) AS section, heading, {_KIND} AS kind, lines, CAST(n_refs AS BIGINT) AS n_refs FROM g WHERE n_lines > 0 OR n_refs > 0""",
)
def f22(spark: SparkSession, d: str) -> DataFrame:
    """Documents of lines into headed sections of a kind, with their references."""
    return structure.sections(brief_lines(spark, d), "doc", "pos", "line").withColumn("lines", F.array_join("lines", "|"))


@query("a18_obligation_vote", "WITH v AS (SELECT doc_id, len(list_filter(['the','must','will','all'], lambda w: regexp_matches(lower(text), '(^|[^a-z])' || w || '([^a-z]|$)'))) AS req, len(list_filter(['may','can','or','if'], lambda w: regexp_matches(lower(text), '(^|[^a-z])' || w || '([^a-z]|$)'))) AS opt FROM documents) SELECT doc_id, req, opt, CASE WHEN req > opt THEN 'required' WHEN opt > req THEN 'optional' END AS obligation FROM v")
def a18(spark: SparkSession, d: str) -> DataFrame:
    """Distinct cues for required against optional; a tie is null."""
    hits = lambda ws: sum((F.lower("text").rlike(f"(^|[^a-z]){w}([^a-z]|$)").cast("int") for w in ws[1:]), F.lower("text").rlike(f"(^|[^a-z]){ws[0]}([^a-z]|$)").cast("int"))
    v = docs(spark, d).select("doc_id", hits(["the", "must", "will", "all"]).alias("req"), hits(["may", "can", "or", "if"]).alias("opt"))
    return v.withColumn("obligation", F.when(F.col("req") > F.col("opt"), "required").when(F.col("opt") > F.col("req"), "optional"))
