"""Fuzzy text similarity (F5-F11, F16, F17): the only functions that need Python.

The ratio is 100 * 2 * LCS / (len a + len b). The length of the longest common subsequence is computed
with bit-parallel integers: one pass over b with a mask of positions for each character of a.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import phrases
from tidemark.functions import text as tx


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    mask: dict[str, int] = {}
    for i, ch in enumerate(b):
        mask[ch] = mask.get(ch, 0) | 1 << i
    whole = (1 << len(b)) - 1
    v = whole
    for ch in a:
        u = v & mask.get(ch, 0)
        v = ((v + u) | (v - u)) & whole
    return len(b) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """100 for two empty texts."""
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def robust_ratio(a: str, b: str) -> int:
    """The better of the whole-number ratios with and without white space."""
    return max(int(ratio(a, b)), int(ratio("".join(a.split()), "".join(b.split()))))


def _masks(text: str) -> dict[str, int]:
    """The places of each character, as bits."""
    mask: dict[str, int] = {}
    for i, ch in enumerate(text):
        mask[ch] = mask.get(ch, 0) | 1 << i
    return mask


def _ends(chars: str, mask: dict[str, int], n: int) -> list[int]:
    """Length of the common subsequence of the masks' text, of n characters, with each beginning of chars, in one pass."""
    whole = v = (1 << n) - 1
    out = []
    for ch in chars:
        u = v & mask.get(ch, 0)
        v = ((v + u) | (v - u)) & whole
        out.append(n - v.bit_count())
    return out


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of its length in the longer one, or of less at its ends.

    From one window to the next the common subsequence changes by one character at most, so a window that falls k
    short of the best is followed by k that can't be better; what the ends cut off is had from one pass from each end.
    """
    s, t = sorted((a, b), key=len)
    if not s:
        return 100.0 if not t else 0.0
    if s in t:
        return 100.0
    n, mask = len(s), _masks(s)
    best = max(200.0 * common / (n + k) for side, m in ((t[: n - 1], mask), (t[::-1][: n - 1], _masks(s[::-1]))) for k, common in enumerate(_ends(side, m, n), 1)) if n > 1 else 0.0
    whole, most, i = (1 << n) - 1, 0, 0  # most: of the common subsequences, as all whole windows are of n characters
    while i <= len(t) - n:
        v = whole
        for ch in t[i : i + n]:
            u = v & mask.get(ch, 0)
            v = ((v + u) | (v - u)) & whole
        have = n - v.bit_count()
        most = max(most, have)
        i += max(1, most + 1 - have)
    return max(best, 200.0 * most / (2 * n))


def robust_partial_ratio(a: str, b: str) -> int:
    """The better of the whole-number partial ratios with and without white space."""
    return max(int(partial_ratio(a, b)), int(partial_ratio("".join(a.split()), "".join(b.split()))))


def contains_ratio(needle: str, hay: str) -> int:
    """Whether hay holds needle, from 0 to 100.

    A hay of less than 0.8 of the needle, white space aside, can't hold it: it is compared as a whole.
    """
    n, h = len("".join(needle.split())), len("".join(hay.split()))
    return robust_ratio(needle, hay) if h < n * 0.8 else robust_partial_ratio(needle, hay)


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Ratio of token sets: what both have against each side's whole (F8)."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left = " ".join(filter(None, [both, " ".join(sorted(x - y))]))
    right = " ".join(filter(None, [both, " ".join(sorted(y - x))]))
    return max(ratio(left, right), *((ratio(both, left), ratio(both, right)) if both else (0.0,)))


def _shared(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def tokens_match(a: str, b: str, least: float = 80) -> bool:
    """Equal, alike at `least`, or with a common start of 5 characters and 60 % of the shorter."""
    reachable = 200 * min(len(a), len(b)) >= least * (len(a) + len(b))
    if a == b or reachable and ratio(a, b) >= least:
        return True
    n = _shared(a, b)
    return n >= 5 and n >= 0.6 * min(len(a), len(b))


def same_word(a: str, b: str, least: float = 80) -> bool:
    """tokens_match, or a common start of 4 characters and 55 % of the shorter (F11): hold and holding, not head and hand."""
    n = _shared(a, b)
    return tokens_match(a, b, least) or (n >= 4 and n >= 0.55 * min(len(a), len(b)))


def token_recall(needle: str, hay: str, least: float = 80) -> tuple[int, int]:
    """Per cent of the needle's distinct content tokens that a content token of the hay matches, and their number."""
    x, y = dict.fromkeys(phrases.content_tokens(needle)), set(phrases.content_tokens(hay))
    if not x or not y:
        return 0, len(x)
    return round(100 * sum(any(tokens_match(a, b, least) for b in y) for a in x) / len(x)), len(x)


def caption_similarity(a: str, b: str, least: float = 80, content: int = 3) -> tuple[int, str]:
    """The best of four scores and the first method that reaches it (F9). Recall counts from `content` content tokens on."""
    recall, n = token_recall(a, b, least)
    sets = max(int(token_set_ratio(a, b)), int(token_set_ratio("".join(a.split()), "".join(b.split()))))
    scores = [("contains", contains_ratio(a, b)), ("token_set", sets), ("token_sort", int(token_sort_ratio(a, b))), ("token_recall", recall if n >= content else 0)]
    best = max(s for _, s in scores)
    return best, next(n for n, s in scores if s == best)


#: A single word of fewer characters must stand in a text as a word.
SHORT_TERM = 8


def term_ratio(term: str, hay: str) -> int:
    """How well hay holds a term of several words or of SHORT_TERM characters; 0 for other terms and for a hay of less than 0.8 of it (F16)."""
    if len(term) < SHORT_TERM and " " not in term or len(hay) < len(term) * 0.8:
        return 0
    return int(partial_ratio(term, hay))


@lru_cache(maxsize=4096)
def _term_pieces(term: str, least: float) -> list[str]:
    """The pieces of a term of which one stands unchanged in every text of no fewer characters that holds it at `least`."""
    n = int(2 * len(term) * (100 - least) / 100 + 1e-9) + 1
    return [term[i * len(term) // n : (i + 1) * len(term) // n] for i in range(n)]


def holds_term(term: str, hay: str, least: float) -> bool:
    """Whether term_ratio reaches `least`; only where a piece of the term stands in the hay a ratio is needed."""
    if len(hay) >= len(term) and not any(p in hay for p in _term_pieces(term, least)):
        return False
    return term_ratio(term, hay) >= least


def term_score(term: Column, hay: Column) -> Column:
    """100 for the term as a word, else term_ratio, of lower-case columns; 0 if either is empty (F16). Only what no native rule decides goes to Python."""
    empty = (F.coalesce(F.length(term), F.lit(0)) == 0) | (F.coalesce(F.length(hay), F.lit(0)) == 0)
    hit = tx.word_hit(hay, term)
    short = (F.length(term) < SHORT_TERM) & ~F.contains(term, F.lit(" ")) | (F.length(hay) < F.length(term) * 0.8)
    slow = column(term_ratio, F.when(~empty & ~hit & ~short, term), hay).cast("int")
    return F.when(empty, 0).when(hit, 100).when(short, 0).otherwise(slow)


def hint_score(hints: list[str], hay: Column, least_length: int = 3) -> Column:
    """struct(score, hint): the best score of any hint and the first hint that has it; 0 and empty if none scores."""
    low = [h.strip().lower() for h in hints]
    scored = [(h, term_score(F.lit(h), hay)) for h in low if len(h) >= least_length]
    none = F.struct(F.lit(0).alias("score"), F.lit("").alias("hint"))
    if not scored:
        return none
    every = F.array(*(F.struct(s.alias("score"), F.lit(h).alias("hint")) for h, s in scored))
    return F.aggregate(every, none, lambda best, x: F.when(x.score > best.score, x).otherwise(best))


def column(f: Callable[[str, str], float], a: Column, b: Column) -> Column:
    """f over two text columns, Arrow batches; null if either is null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else float(f(p, q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)
