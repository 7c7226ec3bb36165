"""Phrases against sequences of tokens (F3, J3): the plain-Python twins of text functions, on phrases and short windows."""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx

_GONE = str.maketrans("", "", "!\"#'()*,-./:;<=>?@[\\]^_`{|}~")
_DASHES = str.maketrans(dict.fromkeys("-‐‑–—", " "))
_SINGLE = lx.NUMBER_WORDS | {t + u: n + m for t, n in lx.TENS_WORDS.items() for u, m in lx.UNIT_WORDS.items()}
_NUMBERS = {*_SINGLE, *lx.TENS_WORDS, *lx.UNIT_WORDS}
_SPELLED = {n: w for w, n in lx.NUMBER_WORDS.items()}


def fold_numbers(tokens: list[str]) -> list[str]:
    """Spelled numbers as digits; see text.fold_numbers."""
    out: list[str] = []
    taken = False  # the token belongs to the one before
    for a, b in pairwise([*tokens, ""]):
        if taken:
            taken = False
        elif a in lx.TENS_WORDS and b in lx.UNIT_WORDS:
            out.append(str(lx.TENS_WORDS[a] + lx.UNIT_WORDS[b]))
            taken = True
        elif a in lx.UNIT_WORDS and b == "hundred":
            out.append(str(lx.UNIT_WORDS[a] * 100))
            taken = True
        else:
            out.append(str(_SINGLE.get(a, a)))
    return out


def normalize_text(text: str, numbers: bool = True) -> str:
    """The twin of text.normalize_text (F2)."""
    tokens = _plain(text)
    return _joined(fold_numbers(tokens) if numbers else tokens)


def _plain(text: str) -> list[str]:
    return text.lower().translate(_DASHES).translate(_GONE).split()


def _joined(tokens: list[str]) -> str:
    out = " ".join(tokens)
    if "$" not in out and "%" not in out:
        return out
    return re.sub(r"\$\s+(\d)", r"$\1", re.sub(r"(\d)\s+%", r"\1%", out)).strip()


def content_tokens(text: str) -> list[str]:
    """The twin of text.content_tokens."""
    stop = set(lx.STOP_WORDS)
    return [t for t in normalize_text(text).split() if any(map(str.isdigit, t)) or (len(t) >= 3 and t not in stop)]


def digits(text: str) -> list[str]:
    """Runs of digits in order."""
    return re.findall(r"\d+", text)


def digits_missing(required: str, candidate: str) -> bool:
    """The twin of text.digits_missing."""
    return not set(digits(required)) <= set(digits(candidate))


def spelled(n: int) -> str:
    """A number from 0 to 100 in words; empty for others."""
    if n in _SPELLED:
        return _SPELLED[n]
    return f"{_SPELLED[n // 10 * 10]} {_SPELLED[n % 10]}" if 20 < n < 100 else ""


def phrase_variants(phrase: str) -> list[str]:
    """The normalised phrase with numbers as digits and as words, and per cent as sign and as word; sorted, distinct."""
    base = normalize_text(phrase)
    word = lambda n: spelled(int(n)) if len(n) < 4 else ""

    def in_words(token: str) -> str:
        if m := re.fullmatch(r"(\d+)(%?)", token):
            return f"{word(m[1])} percent" if m[2] and word(m[1]) else word(m[1]) or token if not m[2] else token
        return token

    found = {base, normalize_text(phrase, numbers=False), " ".join(map(in_words, base.split()))}
    for v in [v for v in found if "%" in v]:
        found.add(re.sub(r"(\d+)%", r"\1 percent", v))
        found.add(re.sub(r"(\d+)%", lambda m: (word(m[1]) or m[1]) + " percent", v))
    return sorted(v for v in found if v)


def _counts(texts: list[str]) -> np.ndarray:
    """Characters of each text by code modulo 64, white space aside."""
    bare = ["".join(t.split()) for t in texts]
    codes = np.frombuffer("".join(bare).encode("utf-32-le"), dtype="<u4").astype(np.int64) % 64
    at = np.repeat(np.arange(len(bare)), [len(t) for t in bare])
    return np.bincount(at * 64 + codes, minlength=64 * len(bare)).reshape(-1, 64).astype(np.int32)


def _windows(plain: list[list[str]], n: int) -> list[str]:
    """normalize_text of every n neighbours, of which each is plain already; only where one is a number there is something to fold."""
    number = [any(t in _NUMBERS for t in own) for own in plain]
    out = []
    for i in range(len(plain) - n + 1):
        tokens = [t for own in plain[i : i + n] for t in own]
        out.append(_joined(fold_numbers(tokens) if any(number[i : i + n]) else tokens))
    return out


def find_phrases(tokens: list[str], phrases: dict[int, list[str]], least: int = 88) -> list[tuple[int, int, int, int, str]]:
    """(phrase, first token, tokens, score, variant) of every window that is like a variant of a phrase at `least` or more.

    Windows have as many tokens as the variant, one less or one more. Numbers are folded for the comparison, and
    a window without a number that the variant has is none. Of equal windows of a phrase the first variant counts.
    What the characters of both allow at most is computed for all windows at once; few need a ratio.
    """
    from tidemark.functions.fuzzy import robust_ratio

    wanted = [(p, v, len(v.split())) for p, variants in phrases.items() for v in variants]
    counts = _counts([v for _, v, _ in wanted])
    sizes = counts.sum(1)
    plain = [_plain(t) for t in tokens]
    found: dict[tuple[int, int, int], tuple[int, str]] = {}
    cache: dict[int, tuple[list[str], np.ndarray]] = {}
    for (p, variant, k), own, size in zip(wanted, counts, sizes, strict=True):
        for n in sorted({max(1, k - 1), k, k + 1}):
            if n > len(tokens):
                continue
            if n not in cache:
                texts = _windows(plain, n)
                cache[n] = texts, _counts(texts)
            texts, have = cache[n]
            # a ratio with white space is at most that without, but for the spaces, of which n + k - 2 may match
            most = 2 * (np.minimum(have, own).sum(1) + min(n, k) - 1)
            for i in np.flatnonzero(most * 100 >= least * (have.sum(1) + size)).tolist():
                if (p, i, n) in found or digits_missing(variant, texts[i]):
                    continue
                if (score := robust_ratio(variant, texts[i])) >= least:
                    found[p, i, n] = score, variant
    return [(p, i, n, score, v) for (p, i, n), (score, v) in found.items()]


def phrase_hits(tokens: Column, phrases: dict[int, list[str]], least: int = 88) -> Column:
    """Array of struct(phrase, at, n, score, variant) of find_phrases over a column of token arrays. The phrases are few: a brief's."""

    @F.pandas_udf("array<struct<phrase:int,at:int,n:int,score:int,variant:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [dict(zip(("phrase", "at", "n", "score", "variant"), x, strict=True)) for x in find_phrases(list(t), phrases, least)] if t is not None else None)

    return run(tokens)
