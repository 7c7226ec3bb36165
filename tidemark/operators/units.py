"""From sections to units: items of a section (F23), and what each asks for, one thing at a time.

Items are islands of lines and stay columns. Units come from a Python table function over all items of a document, in
order: it looks ahead over conjunctions and knows what the document has said already.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.functions import cues
from tidemark.functions import lexicon as lx

# A numbered title, where a sentence ends, words that join two asks, and labels that only introduce.
TITLE = r"^\s*(\d+)[.)]\s+(.{2,70})$"
SENTENCE = re.compile(r'(?<=[.!?])\s+(?=[A-Z0-9"“])')
JOINED = re.compile(r"\s*,?\s+(?:and then|and|then)\s+", re.I)
LABEL = re.compile(r"^\s*(?:campaign|brand|product|brief|requirements?|notes?|deliverables?)\s*:", re.I)
_ASKS, _DESCRIBED, _REPORTED, _OBLIGED, _IMPERATIVE = (re.compile(p, re.I) for p in (lx.any_of(lx.ACTION).removeprefix("(?i)"), lx.DESCRIBED, lx.REPORTED, lx.OBLIGED, lx.IMPERATIVE_START))


def section_items(sections: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, section, heading, kind, item (from 0), text: the items of each section's lines.

    sections: as structure.sections gives them. In a section with numbered titles an item is a title with all lines up to
    the next one, and lines before the first are an introduction, not an item. In one with bullets only, each
    bullet is an item, and so is each stretch of lines between them. Else each line is an item. Items of under three
    characters are none.
    """
    lines = sections.select(doc, "section", "heading", "kind", F.posexplode("lines").alias("at", "line"))
    lines = lines.withColumns({"title": F.col("line").rlike(TITLE), "bullet": F.col("line").rlike("(?i)" + lx.BULLET)})
    key = [doc, "section"]
    whole, before = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("at")
    lines = lines.withColumns({"numbered": F.max("title").over(whole), "bulleted": F.max("bullet").over(whole), "after": F.coalesce(F.lag("bullet").over(before), F.lit(True))})
    starts = F.when(F.col("numbered"), F.col("title")).when(F.col("bulleted"), F.col("bullet") | F.col("after")).otherwise(True)
    lines = lines.withColumn("item", F.sum(starts.cast("long")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    bare = F.trim(F.when(F.col("title"), F.regexp_extract("line", TITLE, 2)).otherwise(F.regexp_replace("line", "(?i)" + lx.BULLET, "")))
    items = lines.filter("item > 0").groupBy(*key, "heading", "kind", "item").agg(F.array_sort(F.collect_list(F.struct("at", bare.alias("t"))))["t"].alias("t"))
    text = F.trim(F.regexp_replace(F.array_join(F.filter("t", lambda x: x != ""), " "), r"\s+", " "))
    items = items.select(*key, "heading", "kind", "item", text.alias("text")).filter(F.length("text") >= 3)
    return items.withColumn("item", F.row_number().over(before.orderBy("item")).cast("long") - 1)


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]+", " "))


#: Characters of a line that counts, and of one that counts where it is only a part of another.
SHORTEST, PART = 4, 12


def ungrouped(requirements: DataFrame, sections: DataFrame) -> DataFrame:
    """requirements without the choices that their document doesn't make, and flags.

    requirements: doc, id (unique), text, span, choice, choice_mode, label (of the choice). A line that must be there
    by law is no alternative: `UNGROUPED_COMPLIANCE_LINE`. Nor is one that stands in a section whose heading says that
    its lines are asks or claims, and in no section of alternatives: `UNGROUPED_BY_STRUCTURE`. It stands in a
    section if its text or span, marks aside, is a line, or from PART characters on is a part of one or has it as a
    part. What stands nowhere keeps its choice. Each is compared with the lines of its own document.
    """
    told = [F.col("heading").rlike(lx.any_of([*lx.SECTION_KINDS.get(k, []), *lx.SECTION_FIRST.get(k, [])])) & (F.col("kind") == k) for k in ("requirements", "claims")]
    side = F.when(F.col("kind") == "alternatives", "alt").when(told[0] | told[1], "fixed")
    lines = sections.select("doc", side.alias("side"), F.explode("lines").alias("line")).filter("side is not null")
    lines = lines.select("doc", "side", _plain(F.col("line")).alias("line")).filter(F.length("line") >= SHORTEST).distinct()
    legal = cues.has(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("span", F.lit(""))), lx.COMPLIANCE) | F.ltrim(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("span", F.lit("")))).rlike(lx.any_of(lx.COMPLIANCE_SHAPE))
    legal = F.col("choice").isNotNull() & (legal | F.coalesce("label", F.lit("")).rlike("(?i)" + lx.COMPLIANCE_SECTION))
    rows = requirements.withColumn("legal", F.coalesce(legal, F.lit(False)))
    asked = rows.filter(~F.col("legal") & F.col("choice").isNotNull() & F.col("choice_mode").isin("one_of", "any_of"))
    needles = asked.select("doc", "id", F.explode(F.array_distinct(F.array(_plain(F.col("span")), _plain(F.col("text"))))).alias("n")).filter(F.length("n") >= SHORTEST)
    within = (F.length("n") >= PART) & (F.contains("line", F.col("n")) | F.contains("n", F.col("line")))
    placed = needles.join(lines, "doc").filter((F.col("n") == F.col("line")) | within).groupBy("id").agg(F.max(F.col("side") == "fixed").alias("fixed"), F.max(F.col("side") == "alt").alias("alt"))
    out = rows.join(placed, "id", "left").withColumn("moved", F.coalesce(F.col("fixed") & ~F.col("alt"), F.lit(False)))
    code = F.when(F.col("legal"), "UNGROUPED_COMPLIANCE_LINE:").when(F.col("moved"), "UNGROUPED_BY_STRUCTURE:")
    gone = code.isNotNull()
    changed = {"flag": F.concat(code, F.col("choice")), "choice": F.when(~gone, F.col("choice")), "choice_mode": F.when(gone, "all_of").otherwise(F.col("choice_mode"))}
    return out.withColumns(changed).select(*requirements.columns, "flag")


def asks_of(sentence: str) -> list[str]:
    """The asks of a sentence: a conjunction parts it only if what follows asks for something itself; a semicolon always does."""
    out: list[str] = []
    for clause in re.split(r"\s*;\s*", sentence):
        parts = JOINED.split(clause)
        asks = [parts[0]]
        for part in parts[1:]:
            if _ASKS.search(part):
                asks.append(part)
            else:
                asks[-1] += f" and {part}"  # a second thing of the same ask
        out += asks if len(parts) > 1 else [clause]
    return [a for a in (x.strip(" .,;") for x in out) if a]


def described(text: str) -> bool:
    """The twin of structure.descriptive."""
    t = re.sub(r"^[*\-•\s]+", "", text.strip())
    return bool(_DESCRIBED.search(t) and _REPORTED.search(t) and not _OBLIGED.search(t) and not _IMPERATIVE.search(t))


def titled(text: str) -> bool:
    """A label, or a few words that ask for nothing and end without a stop: context, not an ask."""
    return bool(LABEL.match(text)) or len(text.split()) <= 4 and not _ASKS.search(text) and not text.endswith(".")


@F.udtf(returnType="doc long, section long, item long, unit long, text string, heading string, kind string, choice string")
class BriefUnits:
    """Units of the items of one document, which come in order; choice names the section whose items are alternatives."""

    def __init__(self) -> None:
        self.said: set[str] = set()
        self.n = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["kind"] == "context":
            return
        choice = row["kind"] == "alternatives" and row["items"] > 1
        sentences = SENTENCE.split(row["text"])
        if choice:  # one alternative stays whole, without sentences that only describe
            units = [" ".join(s.strip() for s in sentences if not described(s))]
        else:
            units = [u for s in sentences for u in asks_of(s.strip())]
        for unit in units:
            key = re.sub(r"[^a-z0-9 ]", "", unit.lower()).strip()
            if len(unit) < 3 or titled(unit) or described(unit) or not key or key in self.said:
                continue
            self.said.add(key)
            self.n += 1
            name = re.sub(r"[^a-z0-9]+", "_", row["heading"].lower()).strip("_") if choice else None
            yield row["doc"], row["section"], row["item"], self.n, unit if unit.endswith((".", "!", "?", '"', "”")) else unit + ".", row["heading"], row["kind"], name


def brief_units(sections: DataFrame) -> DataFrame:
    """doc, section, item, unit (number in the document), text, heading, kind, choice of each unit of documents.

    Sections of context give none. What a document says again, case and marks aside, is one unit. One document's
    items pass through one call in order, a row at a time; what it has said is held.
    """
    items = section_items(sections)
    items = items.withColumn("items", F.count("*").over(Window.partitionBy("doc", "section")))
    return BriefUnits(items.asTable().partitionBy("doc").orderBy("section", "item"))
