"""Requirements as a model wrote them, repaired in a fixed order with a trail of flags.

A repair is a condition, a flag and the columns it sets; later repairs see what earlier ones set. The whole chain is
one pass over rows. What the document must say to back a row is counted by joins on its distinct content words, so a
document's text never travels with its requirements.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import cues, expressions, parsing
from tidemark.functions import text as tx
from tidemark.tables import per_text

# The words each field may have, where a type is sought if nothing says so, and phrases for the end of a video.
TYPES = ["hook", "visual", "speech", "speech_or_text", "demonstration", "audience", "cta", "policy", "brand", "timing", "other"]
MODES = ["speech_only", "visual_only", "ocr_only", "speech_or_text", "visual_and_speech", "any"]
POLARITIES, PRIORITIES, CHOICES = ["required", "forbidden"], ["critical", "high", "medium", "low"], ["all_of", "one_of", "any_of"]
CLAIMS = ["medical", "cure", "guarantee", "unsupported_outcome", "prohibited_wording", "competitor", "pricing", "other"]
MODE_OF_TYPE = {"hook": "any", "visual": "visual_only", "speech": "speech_only", "speech_or_text": "speech_or_text", "demonstration": "visual_only", "audience": "any", "cta": "speech_or_text", "policy": "any", "brand": "any", "timing": "any", "other": "any"}
AT_THE_END = [r"\bend(?:s|ing)? with\b", r"\bat the end\b", r"\blast\s+\d+\s*s", r"\bfinal\b", r"\bclos(?:e|es|ing) with\b", r"\bfinish with\b"]
#: Latest plausible deadline and length of a window at the end, in seconds; share of content words that backs a row.
LATEST, END_WINDOW, BACKED = 600.0, 5, 0.6

#: Columns of a requirement as it comes; lists are arrays of text, all may be null.
FIELDS = "type mode polarity priority checkable deadline window_start window_end start_expr end_expr classes hints criteria span confidence choice choice_mode".split()


@dataclass
class Repair:
    """flag: what joins the trail of the rows of `when`, which get the columns `sets`."""

    when: Column
    flag: Column
    sets: dict[str, Column] = field(default_factory=dict)


def repaired(rows: DataFrame, repairs: list[Repair]) -> DataFrame:
    """rows after the repairs, one after the other; flags grows by those of each row."""
    for r in repairs:
        hit = F.coalesce(r.when, F.lit(False))
        trail = F.when(F.col("_hit"), F.concat("flags", F.array(r.flag))).otherwise(F.col("flags"))
        sets = {c: F.when(F.col("_hit"), x).otherwise(F.col(c)) for c, x in r.sets.items()}
        rows = rows.withColumn("_hit", hit).withColumns({"flags": trail} | sets).drop("_hit")
    return rows


def _said(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _word(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def _or_missing(c: str) -> Column:
    return F.when(F.col(c) == "", "missing").otherwise(F.col(c))


def _out_of(c: str, words: list[str], code: str, instead: Column) -> Repair:
    return Repair(~F.col(c).isin(words), _said(f"{code}:", _or_missing(c), "->", instead), {c: instead})


def _texts(c: str, most: int = 24) -> Column:
    """Distinct texts of a list regardless of case, trimmed, in order; an empty list if there is none."""
    some = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(F.filter(some, lambda x, i: F.array_position(F.transform(some, F.lower), F.lower(x)) == i + 1), 1, most)


def _valid(c: str) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else expressions.valid(t) for t in s], dtype=object)

    return run(c)


def backing(rows: DataFrame, spans: str, sources: DataFrame) -> DataFrame:
    """id, source, share: of each row's distinct content words of `spans`, the share that each source of its document has; rows without any have none.

    rows: doc, id; sources: doc, source, text.
    """
    words = lambda df, keep, c: df.select(*keep, F.explode(F.array_distinct(tx.content_tokens(F.col(c)))).alias("w"))
    own = words(rows, ["doc", "id"], spans)
    n = own.groupBy("id").agg(F.count("*").alias("n"))
    both = own.join(words(sources, ["doc", "source"], "text").distinct(), ["doc", "w"]).groupBy("id", "source").agg(F.count("*").alias("both"))
    return both.join(n, "id").select("id", "source", (F.col("both") / F.col("n")).alias("share"))


def backed_claim(rows: DataFrame, spans: str, claims: DataFrame) -> DataFrame:
    """id, claim: the first claim of a row's document of which the row has BACKED of the content words.

    claims: doc, pos, claim.
    """
    words = lambda df, keep, c: df.select(*keep, F.explode(F.array_distinct(tx.content_tokens(F.col(c)))).alias("w"))
    each = words(claims, ["doc", "pos", "claim"], "claim")
    n = each.groupBy("doc", "pos").agg(F.count("*").alias("n"))
    both = words(rows, ["doc", "id"], spans).join(each, ["doc", "w"]).groupBy("doc", "id", "pos", "claim").agg(F.count("*").alias("both")).join(n, ["doc", "pos"])
    return both.filter(F.col("both") >= F.col("n") * BACKED - 1e-9).groupBy("id").agg(F.min_by("claim", "pos").alias("claim"))


def repair_requirements(rows: DataFrame, documents: DataFrame, claims: DataFrame) -> DataFrame:
    """rows with their fields repaired, and flags, the trail in the order of repairs.

    rows: id (unique), doc, text and FIELDS; documents: doc, text (one row a document); claims: doc, pos, claim. Rows of
    no text go. Enumerated words are compared trimmed and in lower case. Types, modes, polarities and so on that
    a cue contradicts are flagged, not changed: both can be wrong, and a person decides.
    """
    t, none = F.col("text"), F.lit(None)
    rows = rows.withColumn("text", F.trim("text")).filter(F.col("text") != "")
    rows = rows.withColumns({c: _word(c) for c in ("type", "mode", "polarity", "priority")} | {"choice_mode": F.when(_word("choice_mode") == "", "all_of").otherwise(_word("choice_mode"))})
    rows = rows.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in ("start_expr", "end_expr", "span", "choice")})
    rows = rows.withColumns({"hints": _texts("hints"), "criteria": _texts("criteria"), "said_classes": _texts("classes"), "flags": F.array().cast("array<string>")})
    known = F.filter("said_classes", lambda x: F.lower(x).isin(CLAIMS))
    unknown = F.filter("said_classes", lambda x: ~F.lower(x).isin(CLAIMS))
    cue = cues.evidence_mode(t)
    said = {"cue_mode": cue, "cue_polarity": cues.polarity(t), "rule": parsing.temporal_window(t), "cue_type": cues.requirement_type(t, cue), "cue_classes": cues.claim_classes(t), "cue_hints": cues.match_hints(t), "at_the_end": cues.has(t, AT_THE_END), "said_numbers": F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?)"), 1)}
    rows = per_text(rows, "text", lambda texts: texts.withColumns(said)).withColumn("classes", known)
    rows = rows.withColumns({
        "rule_deadline": F.when(~F.col("rule.from_end") & (F.col("rule.lo") == 0), F.col("rule.hi").cast("double")),
        "rule_start": F.when(F.col("rule.from_end"), _said("duration - ", F.col("rule.hi"))),
        "start_ok": _valid("start_expr"), "end_ok": _valid("end_expr"),
    })
    numbers = F.array_distinct(F.regexp_extract_all("start_expr", F.lit(r"(\d+(?:\.\d+)?)"), 1))
    unsaid = F.filter(numbers, lambda x: ~F.array_contains("said_numbers", x))
    c = F.col
    fallback = F.coalesce(c("cue_mode"), F.try_element_at(F.create_map(*[F.lit(x) for kv in MODE_OF_TYPE.items() for x in kv]), c("type")), F.lit("any"))
    first = repaired(rows, [
        _out_of("type", TYPES, "TYPE_OUT_OF_ENUM", c("cue_type")),
        Repair(c("polarity").isin(POLARITIES) & (c("polarity") != c("cue_polarity")), _said("POLARITY_DISAGREES:model=", c("polarity"), ",rules=", c("cue_polarity"))),
        _out_of("polarity", POLARITIES, "POLARITY_OUT_OF_ENUM", c("cue_polarity")),
        Repair(c("mode").isin(MODES) & (c("cue_mode") != c("mode")), _said("MODE_DISAGREES:model=", c("mode"), ",rules=", c("cue_mode"))),
        _out_of("mode", MODES, "MODE_OUT_OF_ENUM", fallback),
        Repair(c("cue_mode").isNull(), F.lit("MODE_NO_CUE:defaulted_by_type")),
        _out_of("priority", PRIORITIES, "PRIORITY_OUT_OF_ENUM", cues.priority(t, c("type"), c("polarity"))),
    ])
    first = first.withColumn("rule_checkable", cues.machine_checkable(t, c("type")))
    span_flag = Repair(c("span").isNull(), F.lit("BRIEF_SPAN_MISSING"), {"span": t})
    end_window = _said("duration - ", str(END_WINDOW))
    second = repaired(first, [
        Repair(c("checkable") & ~c("rule_checkable"), F.lit("VAGUE_BUT_MARKED_CHECKABLE")),
        Repair(c("checkable").isNull(), _said("MACHINE_CHECKABLE_MISSING->", c("rule_checkable")), {"checkable": c("rule_checkable")}),
        Repair(c("deadline") <= 0, _said("DEADLINE_NOT_POSITIVE:", c("deadline")), {"deadline": none}),
        Repair(c("deadline") > LATEST, _said("DEADLINE_IMPLAUSIBLE:", c("deadline")), {"deadline": none}),
        Repair(~c("start_ok"), _said("WINDOW_START_EXPR_INVALID:", c("start_expr")), {"start_expr": none}),
        Repair(~c("end_ok"), _said("WINDOW_END_EXPR_INVALID:", c("end_expr")), {"end_expr": none}),
        Repair(c("deadline").isNull() & c("rule_deadline").isNotNull(), _said("DEADLINE_MISSED_BY_MODEL:rules_found=", c("rule_deadline")), {"deadline": c("rule_deadline")}),
        Repair(c("rule_start") != c("start_expr"), _said("WINDOW_DISAGREES_WITH_BRIEF:model=", c("start_expr"), ";rules=", c("rule_start"))),
        Repair(c("rule_start").isNull() & c("start_expr").isNotNull() & (F.size(unsaid) > 0), _said("WINDOW_UNSUPPORTED_BY_BRIEF:", c("start_expr"), ";not_in_brief=", F.array_join(unsaid, ","))),
        Repair(c("rule_start").isNotNull() & c("start_expr").isNull() & c("window_start").isNull(), _said("WINDOW_MISSED_BY_MODEL:rules_found=", c("rule_start")), {"end_expr": F.lit("duration"), "start_expr": c("rule_start")}),
        Repair(c("at_the_end") & c("window_start").isNotNull() & c("start_expr").isNull(), _said("END_RELATIVE_HARDCODED:", c("window_start"), "->", end_window), {"end_expr": F.coalesce("end_expr", F.lit("duration")), "start_expr": end_window, "window_start": none, "window_end": none}),
        Repair(c("window_start") > c("window_end"), _said("WINDOW_INVERTED:", c("window_start"), ">", c("window_end")), {"window_start": c("window_end"), "window_end": c("window_start")}),
        Repair(F.size(unknown) > 0, _said("CLAIM_CLASS_OUT_OF_ENUM:", F.array_join(F.slice(unknown, 1, 3), ","))),
        Repair((c("polarity") == "forbidden") & (F.size("classes") == 0), _said("CLAIM_CLASSES_MISSING->", F.array_join("cue_classes", ",")), {"classes": c("cue_classes")}),
        Repair(F.size("hints") == 0, F.lit("MATCH_HINTS_MISSING:generated_from_rules"), {"hints": c("cue_hints")}),
    ])
    given = second.withColumn("quoted", c("span"))
    given = repaired(given, [span_flag])
    in_document = backing(given, "span", documents.select("doc", F.lit(0).alias("source"), "text")).select("id", "share")
    quoted, worded = (backed_claim(given.filter(F.col(x).isNotNull()), x, claims).withColumnRenamed("claim", f"by_{x}") for x in ("quoted", "text"))
    whole = given.join(in_document, "id", "left").join(quoted, "id", "left").join(worded, "id", "left")
    whole = whole.withColumn("claim", F.coalesce("by_quoted", "by_text"))
    disagrees = F.exists("flags", lambda f: f.startswith("SPAN_NOT_IN_BRIEF") | f.startswith("MODE_DISAGREES"))
    whole = repaired(whole, [
        Repair(F.coalesce("share", F.lit(0.0)) < BACKED - 1e-9, F.lit("SPAN_NOT_IN_BRIEF:possible_invention")),
        Repair(~c("choice_mode").isin(CHOICES), _said("GROUP_MODE_OUT_OF_ENUM:", c("choice_mode"), "->all_of"), {"choice_mode": F.lit("all_of")}),
        Repair(c("choice").isNull() & (c("choice_mode") != "all_of"), _said("GROUP_MODE_WITHOUT_GROUP:", c("choice_mode"), "->all_of"), {"choice_mode": F.lit("all_of")}),
        Repair(c("choice").isNull() & (c("polarity") == "required") & c("claim").isNotNull(), _said("FROM_APPROVED_CLAIMS:", F.substring("claim", 1, 48))),
    ])
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.6))))
    whole = whole.withColumns({"confidence": F.bround(F.when(disagrees, F.least(sure, F.lit(0.4))).otherwise(sure), 3), "criteria": F.when(F.size("criteria") == 0, F.array(t)).otherwise(c("criteria"))})
    return whole.select("id", "doc", "text", *FIELDS, "flags")
