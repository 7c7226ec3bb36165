"""The structure of a document of requirements, line by line: headings, kinds of sections, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx
from tidemark.functions import text as tx
from tidemark.functions.cues import has


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def plain_heading(line: Column) -> Column:
    """Whether a line without marks is a heading: short, no bullet, no quotation, no instruction; then by its last character, its capitals or a word that names a section."""
    s = F.trim(line)
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    n = F.size(words)
    last = F.substring(s, -1, 1)
    ruled_out = (
        (F.length(s) == 0) | (F.length(s) > 90) | s.rlike("(?i)" + lx.BULLET) | s.rlike(lx.PAGE_RULE) | s.rlike("^[\"“”'‘’(]") | s.rlike('["“”]') | (n > 12) | ((n > 3) & has(s, lx.ACTION))
    )
    letters = _count(s, r"\p{L}")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    named = (n <= 6) & has(s, [p for kind in lx.SECTION_KINDS.values() for p in kind])
    signs = (_count(s, r"\p{Lu}") > letters * 0.6) & (letters > 0) | (capital >= F.greatest(F.lit(1), n - 2)) | named
    return F.when(ruled_out, False).when(last == ":", True).when(last.isin(".", "!", "?", ",", ";"), False).otherwise(signs)


def section_kind(heading: Column, body: Column) -> Column:
    """alternatives, claims, requirements or context: by the heading, else by whether there is a body."""
    out = F.when(F.coalesce(F.length(body), F.lit(0)) == 0, "context").otherwise("requirements")
    for kinds in (lx.SECTION_KINDS, lx.SECTION_FIRST):
        for kind, patterns in reversed(kinds.items()):
            out = F.when(has(heading, patterns), kind).otherwise(out)
    return out


def descriptive(line: Column) -> Column:
    """Whether a line describes somebody's video and asks for nothing: third person, a verb that reports, no obligation."""
    t = F.regexp_replace(F.trim(line), r"^[*\-•\s]+", "")
    found = t.rlike("(?i)" + lx.DESCRIBED) & t.rlike("(?i)" + lx.REPORTED)
    return found & ~t.rlike("(?i)" + lx.OBLIGED) & ~t.rlike("(?i)" + lx.IMPERATIVE_START)


def quoted_example(line: Column) -> Column:
    """Whether a line is one to be said: a quotation of more than eight characters."""
    s = F.regexp_replace(F.trim(line), r"[.]+$", "")
    return (F.length(s) > 8) & s.rlike("^[\"“”'‘’]")


def sections(lines: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """doc, section, heading, kind, lines (array), n_refs of each section that has lines or references.

    Marked and plain headings open sections; lines before the first form section 0, which has no heading. Empty
    lines and rules across the page are nothing. Lines that only point at a video are references.
    """
    marked = r"^\s{0,3}#{1,6}\s+(.*\S)\s*$"
    raw = lines.filter((F.trim(line) != "") & ~F.col(line).rlike(lx.PAGE_RULE))
    inner = F.when(F.col(line).rlike(marked), F.regexp_extract(F.col(line), marked, 1)).otherwise(F.col(line))
    p = raw.select(doc, pos, F.col(line).rlike(marked).alias("marked"), tx.strip_markdown(inner).alias("plain")).filter("plain <> ''")
    p = p.withColumn("ref", ~F.col("marked") & (F.col("plain").rlike("(?i)" + lx.REFERENCE) | F.col("plain").rlike(lx.ONLY_LINK)))
    p = p.withColumn("head", F.col("marked") | (~F.col("ref") & plain_heading(F.col("plain"))))
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    s = p.withColumn("section", F.sum(F.col("head").cast("int")).over(w))
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("head") & ~F.col("ref"), F.struct(pos, "plain")))), lambda x: x["plain"])
    heading = F.max(F.when(F.col("head"), F.when(F.col("marked"), F.col("plain")).otherwise(F.regexp_replace("plain", ":+$", ""))))
    g = s.groupBy(doc, "section").agg(F.coalesce(heading, F.lit("")).alias("heading"), body.alias("lines"), F.sum(F.when(F.col("ref"), F.size(F.regexp_extract_all("plain", F.lit(r"(https?://\S+)"), 1))).otherwise(0)).alias("n_refs"))
    g = g.filter((F.size("lines") > 0) | (F.col("n_refs") > 0))
    return g.select(doc, "section", "heading", section_kind(F.col("heading"), F.array_join("lines", " ")).alias("kind"), "lines", "n_refs")
