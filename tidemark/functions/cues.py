"""Ladders of cues over requirement texts, as columns: mode, polarity, type, priority, checkability, claims, hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx
from tidemark.functions import text as tx


def has(text: Column, patterns: list[str]) -> Column:
    return text.rlike(lx.any_of(patterns))


def evidence_mode(text: Column) -> Column:
    """Where the evidence for a requirement must be, null if no cue says so.

    Spoken and seen is both; spoken and written is either, as no mode is for both; what is shown but is read
    (a discount, a code) may be spoken or written.
    """
    speech, visual, written, readable = (has(text, p) for p in (lx.SPEECH, lx.VISUAL, lx.WRITTEN, lx.READABLE))
    return (
        F.when(speech & visual, "visual_and_speech")
        .when(speech & written, "speech_or_text")
        .when(written, "ocr_only")
        .when(speech, "speech_only")
        .when(visual & readable, "speech_or_text")
        .when(visual, "visual_only")
    )


def polarity(text: Column) -> Column:
    """forbidden by a negation, but `no longer than` alone is timing."""
    other = [p for p in lx.NEGATION if p != r"\bno claims?\b"]
    timing = has(text, lx.NOT_NEGATION) & ~has(text, other)
    return F.when(~timing & has(text, lx.NEGATION), "forbidden").otherwise("required")


def requirement_type(text: Column, mode: Column) -> Column:
    """The first type of which a cue stands in the text, else what the mode implies, else other."""
    out = F.lit("other")
    for m, kind in reversed(lx.TYPE_OF_MODE.items()):
        out = F.when(mode == m, kind).otherwise(out)
    for kind, patterns in reversed(lx.TYPES.items()):
        seen = F.regexp_replace(text, "(?i)" + lx.TO_CAMERA, " ") if kind == "audience" else text
        out = F.when(has(seen, patterns), kind).otherwise(out)
    return out


def priority(text: Column, kind: Column, polarity: Column) -> Column:
    """critical, high, medium or low: by imperative, softened or preferring language, else by the kind of rule."""
    rule = (kind == "policy") | (polarity == "forbidden")
    return (
        F.when(has(text, lx.IMPERATIVE), F.when(rule, "critical").otherwise("high"))
        .when(has(text, lx.SOFTENED), "low")
        .when(has(text, lx.PREFERENCE), "medium")
        .when(rule, "critical")
        .when(kind.isin("hook", "cta", "visual", "demonstration"), "high")
        .otherwise("medium")
    )


def machine_checkable(text: Column, kind: Column) -> Column:
    """Not for a vague word, unless something readable, a figure or a quotation is there, or the kind of thing is concrete."""
    concrete = has(text, [*lx.READABLE, r"\d", r'"[^"]+"', "“[^”]+”"])
    hard = kind.isin("visual", "demonstration", "speech", "speech_or_text", "cta", "policy")
    return ~has(text, lx.VAGUE) | concrete | hard


def claim_classes(text: Column) -> Column:
    """Classes of claims that a rule names, in their order; other if none."""
    found = F.array_compact(F.array(*(F.when(has(text, p), k) for k, p in lx.CLAIM_CLASSES.items())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def claim_candidate(text: Column) -> Column:
    """struct(all_terms, klass): the distinct terms and wordings of claims that stand in a text as words, and the class of the first wording; null without any."""
    low = F.lower(F.trim(text))
    terms = [F.when(tx.word_hit(low, F.lit(t)), t) for t in lx.CLAIM_TERMS]
    said = [F.nullif(F.regexp_extract(low, p, 0), F.lit("")) for p, _ in lx.CLAIM_WORDINGS]
    hits = F.array_distinct(F.array_compact(F.array(*terms, *said)))
    klass = F.coalesce(*(F.when(low.rlike(p), k) for p, k in lx.CLAIM_WORDINGS))
    return tx.bound(hits, lambda h: F.when(F.size(h) > 0, F.struct(h.alias("all_terms"), klass.alias("klass"))))


def banned_wording(text: Column) -> Column:
    """Words and score-like figures that a recommendation must not hold, in their order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when(low.rlike(rf"(?<!\w){w}(?!\w)"), w) for w in lx.BANNED]
    return F.array_compact(F.array(*found, F.when(F.coalesce(text, F.lit("")).rlike(lx.BANNED_FIGURES), "numeric-score-like")))


def match_hints(text: Column, most: int = 12) -> Column:
    """Content tokens that are no verbs of asking, what synonyms add, and quotations: distinct, of three characters or more, the first `most`."""
    verbs = F.array(*map(F.lit, lx.NO_HINTS))
    own = F.filter(tx.content_tokens(text), lambda t: ~F.array_contains(verbs, t))
    more = [F.when(text.rlike(rf"(?i)\b{key[:6]}"), F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")) for key, words in lx.SYNONYMS.items()]
    quoted = r'"([^"]{2,40})"|“([^”]{2,40})”'
    said = F.zip_with(F.regexp_extract_all(text, F.lit(quoted), 1), F.regexp_extract_all(text, F.lit(quoted), 2), lambda a, b: F.lower(F.trim(F.concat(a, b))))
    return F.slice(F.array_distinct(F.filter(F.concat(own, *more, said), lambda h: F.length(h) > 2)), 1, most)
