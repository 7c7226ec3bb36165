"""Op 5: secrets by fixed patterns and by sliding-window entropy.

Candidate strings are runs of 20 or more characters of the base64 and URL alphabets. Over each, a window
of 20 slides; its Shannon entropy is kept by character class (hex digits; letters and digits; letters of both
cases with a digit at most) from counts that change by the one character that enters and the one that leaves.
Windows above their class's threshold join to spans of kind `entropy`, unless matches of the allow list cover half
of them or more, or a span of the fixed patterns covers them whole. Letters of one case are words for all that can be
told, and are no secret.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import accumulate
from math import log2

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import table

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_MIXED = re.compile(r"[0-9][^0-9]*[0-9]|[a-z][^A-Z]*[A-Z]|[A-Z][^a-z]*[a-z]")
WINDOW = 20
#: Bits a character that a window needs, by class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "letters": 4.1}
#: What matches one of these is known not to be a secret; the rest of its candidate may be one.
ALLOW = (
    r"(?i)example|sample|placeholder|dummy|changeme|x{8}|test[_-]?key",
    r"(?i)0123456789|abcdefghij|1234567890",
    r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}",
    r"[-_=/]{4,}",
    r"^[A-Za-z]{1,15}([-_/=+][A-Za-z]{1,15})*$",
)
_CLASS = {c: "hex" for c in "0123456789abcdef"} | {c: "hex" for c in "ABCDEF"} | {c: "alnum" for c in "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ"}
_F = [0.0, *(c * log2(c) for c in range(1, WINDOW + 1))]


def windows(candidate: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> Iterator[tuple[int, str, float]]:
    """(start, class, bits a character) of each window above its class's threshold.

    A window is of class hex if it has hex digits only, else alnum, if it has two digits or more and not only
    digits; with fewer digits it is of class letters, if it has both cases.
    """
    if len(candidate) < window:
        return
    counts: dict[str, int] = {}
    total = 0.0  # of c * log2(c) over the counts
    not_hex = digits = upper = lower = 0
    f = _F if window == WINDOW else [0.0, *(c * log2(c) for c in range(1, window + 1))]
    for i, ch in enumerate(candidate):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += f[c + 1] - f[c]
        not_hex += _CLASS.get(ch) != "hex"
        digits += ch.isdigit()
        upper += ch.isupper()
        lower += ch.islower()
        if i >= window:
            old = candidate[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += f[c - 1] - f[c]
            not_hex -= _CLASS.get(old) != "hex"
            digits -= old.isdigit()
            upper -= old.isupper()
            lower -= old.islower()
        if i >= window - 1:
            if digits == window or digits < 2 and not (upper and lower):
                continue
            kind = "letters" if digits < 2 else "alnum" if not_hex else "hex"
            bits = log2(window) - total / window
            if bits >= thresholds[kind]:
                yield i - window + 1, kind, bits


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost, not overlapping within a kind; too short ones are dropped."""
    found = []
    if _HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def allowed(candidate: str, allow: Sequence[re.Pattern]) -> list[int]:
    """Of each place of the candidate, how many characters before it matches of the allow list cover."""
    covered = bytearray(len(candidate))
    for a in allow:
        for m in a.finditer(candidate):
            covered[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    return [0, *accumulate(covered)]


def entropy_spans(text: str, base: Sequence[tuple[int, int, int]], allow: Sequence[str] = ALLOW) -> list[tuple[int, int, int]]:
    """Spans of joined windows that no base span covers whole and that the allow list doesn't cover by half."""
    found = []
    at_base = 0
    known = [re.compile(a) for a in allow] if allow is not ALLOW else _ALLOWED
    for m in _CANDIDATE.finditer(text):
        s = m.group()
        if not _MIXED.search(s):
            continue  # no window can have two digits or both cases
        cover = allowed(s, known)
        off = bytearray(len(s))  # windows that a base span covers, by their start
        while at_base < len(base) and base[at_base][2] <= m.start():
            at_base += 1
        for x, _, y in base[at_base : bisect_left(base, (m.end(),))]:
            x, y = max(0, x - m.start()), min(len(s), y - m.start()) - WINDOW + 1
            if x < y:
                off[x:y] = b"\1" * (y - x)
        spans: list[list[int]] = []
        for at, _, _ in windows(s):
            if off[at] or 2 * (cover[at + WINDOW] - cover[at]) >= WINDOW:
                continue
            if spans and at <= spans[-1][1]:
                spans[-1][1] = at + WINDOW
            else:
                spans.append([at, at + WINDOW])
        found += [(a + m.start(), 3, b + m.start()) for a, b in spans]
    return found


_ALLOWED = [re.compile(a) for a in ALLOW]


def spans_of(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans in order of start, then kind. Null is empty."""
    base = base_spans(text or "")
    return base, sorted([*base, *entropy_spans(text or "", base)])


def said(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with each run of overlapping spans replaced by mark; a null text stays null."""
    if text is None:
        return None
    out, at = [], 0
    for a, _, b in spans_of(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_assign, n_access, n_hex, n_entropy, base_sha256 and spans.

    Offsets are code points, ends exclusive. A null text is empty. Columns of these names are replaced.
    """
    new = ["n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"]
    docs = docs.drop(*new)
    at = docs.columns.index(text_col)
    rest = [i for i, c in enumerate(docs.columns) if i != at]
    kinds = [*[T.LongType()] * 4, T.StringType(), T.StringType()]
    schema = T.StructType([*(docs.schema.fields[i] for i in rest), *map(T.StructField, new, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            hashes, spans = [], []
            for text in batch.column(at).to_pylist():
                base, every = spans_of(text)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in every))
                hashes.append(hashlib.sha256(said(base).encode()).hexdigest())
                spans.append(said(every))
            more = [*(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *more], names=schema.names)

    return docs.mapInArrow(run, schema)


def redact(text: Column) -> Column:
    """Column of texts with their secrets replaced; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(redacted, na_action="ignore")

    return run(text)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
