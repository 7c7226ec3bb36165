"""Text functions as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx

_MARKS = r"[!\"#'()*,./:;<=>?@\[\\\]^_`{|}~-]"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def normalize_token(c: Column) -> Column:
    """Lower case, no punctuation but % $ & +, single spaces (F1). ASCII punctuation and white space only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), _MARKS, ""), r"[ \t\n\r]+", " "))


def _numbers(words: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv])


def fold_numbers(tokens: Column) -> Column:
    """Spelled numbers as digits: `twenty five` and `twentyfive` are 25, `two hundred` is 200, other words stand alone.

    Read from left to right, so a unit after a ten belongs to it and not to a hundred that follows.
    """
    tens, ones = list(lx.TENS_WORDS), list(lx.UNIT_WORDS)
    single = lx.NUMBER_WORDS | {t + u: lx.TENS_WORDS[t] + lx.UNIT_WORDS[u] for t in tens for u in ones}
    value, ten, one = _numbers(single), _numbers(lx.TENS_WORDS), _numbers(lx.UNIT_WORDS)

    def fold(every: Column, x: Column, i: Column) -> Column:
        before, twice, after = F.get(every, i - 1), F.get(every, i - 2), F.get(every, i + 1)
        to_ten = x.isin(ones) & F.coalesce(before.isin(tens), F.lit(False))
        to_one = (x == "hundred") & F.coalesce(before.isin(ones), F.lit(False)) & ~F.coalesce(twice.isin(tens), F.lit(False))
        return (
            F.when(to_ten | to_one, None)
            .when(x.isin(tens) & after.isin(ones), (F.try_element_at(ten, x) + F.try_element_at(one, after)).cast("string"))
            .when(x.isin(ones) & (after == "hundred"), (F.try_element_at(one, x) * 100).cast("string"))
            .otherwise(F.coalesce(F.try_element_at(value, x).cast("string"), x))
        )

    # each token looks at its neighbours: the tokens are made once a text, not once a token
    return bound(tokens, lambda every: F.array_compact(F.transform(every, lambda x, i: fold(every, x, i))))


def normalize_text(c: Column, numbers: bool = True) -> Column:
    """Dashes to spaces, token normalisation, spelled numbers to digits, `20 %` to `20%`, `$ 5` to `$5` (F2)."""
    joined = f"(?:{'|'.join(lx.TENS_WORDS)})(?:{'|'.join(lx.UNIT_WORDS)})"
    guard = f"(?:^| )(?:{'|'.join(lx.NUMBER_WORDS)}|{joined})(?: |$)"

    def folded(plain: Column) -> Column:  # most texts have no number words and are spared the fold
        return F.when(plain.rlike(guard), F.array_join(fold_numbers(F.split(plain, " ")), " ")).otherwise(plain)

    plain = normalize_token(F.regexp_replace(c, "[-‐‑–—]", " "))
    out = bound(plain, folded) if numbers else plain
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"([0-9]) +%", "$1%"), r"\$ +([0-9])", r"\$$1"))


def despace(c: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(c, r"[ \t\n\r]+", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalize_token(c), " "), lambda x: x != "")


def content_tokens(c: Column) -> Column:
    """Tokens of the normalised text with a digit, or of three characters or more that aren't stop words."""
    return F.filter(F.split(normalize_text(c), " "), lambda x: x.rlike("[0-9]") | ((F.length(x) >= 3) & ~x.isin(*lx.STOP_WORDS)))


def digit_runs(c: Column) -> Column:
    """Runs of digits in order."""
    return F.regexp_extract_all(c, F.lit("([0-9]+)"), 1)


def digits_conflict(a: Column, b: Column) -> Column:
    """Both have digits, and different ones (F13): are these two things?"""
    x, y = digit_runs(a), digit_runs(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


def digits_missing(required: Column, candidate: Column) -> Column:
    """The candidate lacks a number that is required (F13): does this not satisfy that?"""
    return F.size(F.array_except(digit_runs(required), digit_runs(candidate))) > 0


def word_hit(hay: Column, term: Column) -> Column:
    """Whether a lower-case term stands in lower-case hay as a word, with a plain inflection at most (F16).

    `heal` is in `heals` and `healing`, not in `healthy`; `27%` is in `27% off`. The term is literal text.
    """
    literal = F.regexp_replace(term, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.rlike(hay, F.concat(F.lit(r"\b"), literal, F.lit(r"(?:s|es|ed|d|ing)?(?!\w)")))


def figures(c: Column) -> Column:
    """Array of struct(value, unit) in order (F18): a number, its decimals, and its canonical unit, empty for a bare number.

    A comma before more digits is dropped. `3months`, `27.5 %` and `27.5 percent` have units, `3 monthly` has none.
    """
    pattern = r"(?i)(\d+(?:[.,]\d+)?)\s*(?:(%)|(percent|pct|days?|weeks?|months?|years?|hours?|minutes?|times?|x)\b)?"
    value, sign, word = (F.regexp_extract_all(c, F.lit(pattern), i) for i in (1, 2, 3))
    known = F.create_map(*[F.lit(x) for kv in lx.UNITS.items() for x in kv])
    unit = F.zip_with(sign, word, lambda s, w: F.coalesce(F.try_element_at(known, F.lower(F.concat(s, w))), F.lit("")))
    return F.zip_with(value, unit, lambda v, u: F.struct(F.regexp_replace(v, ",", "").cast("double").alias("value"), u.alias("unit")))


def policed(figures_: Column) -> Column:
    """Those that have a unit: a bare number is never held against anything."""
    return F.filter(figures_, lambda f: f.unit != "")


def strip_markdown(c: Column) -> Column:
    """Without the marks of bold, italics and code, and with links' texts only (F20). A lone star or underscore stays."""
    for pattern in (r"\*\*(.+?)\*\*", r"__(.+?)__", r"(?<![\w*])\*([^*\n]+)\*(?![\w*])", r"`([^`]+)`", r"\[([^\]]+)\]\([^)]*\)"):
        c = F.regexp_replace(c, pattern, "$1")
    return F.trim(c)


def looks_like_html(c: Column) -> Column:
    """Starts as an HTML page does."""
    return F.lower(F.substring(F.trim(c), 1, 200)).rlike(r"^<!doctype html|^<html|<head>")


def escape_html(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def clock(seconds: Column) -> Column:
    """m:ss (F31)."""
    return F.format_string("%d:%02d", F.floor(seconds / 60), F.floor(seconds) % 60)


def non_english(c: Column) -> Column:
    """More than 15 % of the letters aren't ASCII, or six words or more without a stop word (P16). Not an empty text."""
    letters, other = F.regexp_count(c, F.lit(r"\p{L}")), F.regexp_count(c, F.lit(r"[\p{L}&&[^A-Za-z]]"))
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), 1)
    none = ~F.arrays_overlap(words, F.array(*map(F.lit, lx.STOP_WORDS)))
    return (F.trim(c) != "") & ((other * 100 > letters * 15) | ((F.size(words) >= 6) & none))
