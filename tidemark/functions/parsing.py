"""Model replies and time phrases: JSON extraction and repair, temporal windows (§2.9 JSON)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx

def json_object(text: str) -> str | None:
    """The first balanced {...} of the text; braces in strings don't count."""
    start = text.find("{")
    while start >= 0:
        depth, quoted, i = 0, False, start
        while i < len(text):
            c = text[i]
            if quoted:
                if c == "\\":
                    i += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    return text[start : i + 1]
            i += 1
        start = text.find("{", start + 1)
    return None


def parsed(text: str | None) -> tuple[str | None, str]:
    """(canonical JSON, how): direct, extracted, repaired (single quotes, trailing commas, constants) or failed."""

    def load(t: str | None) -> str | None:
        try:
            return json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False) if t else None
        except ValueError:
            return None

    if text is None:
        return None, "failed"
    if (out := load(text)) is not None:
        return out, "direct"
    part = json_object(text)
    if (out := load(part)) is not None:
        return out, "extracted"
    fixed = re.sub(r",\s*([}\]])", r"\1", part or text)
    fixed = re.sub(r"'([^'\"]*)'", r'"\1"', fixed)
    for a, b in (("None", "null"), ("True", "true"), ("False", "false")):
        fixed = re.sub(rf"\b{a}\b", b, fixed)
    out = load(fixed)
    return (out, "repaired") if out is not None else (None, "failed")


def parse_reply(text: Column) -> Column:
    """struct(json, how) of model replies: valid ones natively, only the others in Python."""

    @F.pandas_udf("json string, how string")
    def slow(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parsed(t) for t in s], columns=["json", "how"])

    fine = F.try_parse_json(text)
    return F.when(fine.isNotNull(), F.struct(F.to_json(fine).alias("json"), F.lit("direct").alias("how"))).otherwise(slow(F.when(fine.isNull(), text)))


def temporal_window(text: Column) -> Column:
    """struct(lo, hi, from_end) of `first N seconds`, `last N seconds`, `between A and B seconds`, else null.

    Numbers as digits or as words up to ten.
    """
    words = [*lx.UNIT_WORDS, "ten"]
    number = "([0-9]+|" + "|".join(words) + ")"
    table = F.create_map(*[F.lit(x) for i, w in enumerate(words) for x in (w, i + 1)])
    low = F.lower(text)

    def num(pattern: str, group: int) -> Column:
        raw = F.regexp_extract(low, pattern, group)
        return F.coalesce(raw.try_cast("int"), F.try_element_at(table, raw))

    first, last, between = f"first {number} (?:s|sec|second)", f"last {number} (?:s|sec|second)", f"between {number} and {number} (?:s|sec|second)"
    kind = "struct<lo:int,hi:int,from_end:boolean>"
    make = lambda lo, hi, end: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), F.lit(end).alias("from_end")).cast(kind)
    return (
        F.when(low.rlike(between), make(F.least(num(between, 1), num(between, 2)), F.greatest(num(between, 1), num(between, 2)), False))
        .when(low.rlike(first), make(F.lit(0), num(first, 1), False))
        .when(low.rlike(last), make(F.lit(0), num(last, 1), True))
    )
