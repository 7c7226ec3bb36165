"""Items and units of documents, by literal cases and a loop over the same lines."""

from __future__ import annotations

import random
import re

import pytest

from tidemark.functions import lexicon as lx
from tidemark.operators import units

SECTIONS = "doc long, section long, heading string, kind string, lines array<string>, n_refs long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SECTIONS)


@pytest.mark.parametrize(("sentence", "asks"), [
    ("show the product and say the name", ["show the product", "say the name"]),
    ("mention hydration and barrier support", ["mention hydration and barrier support"]),
    ("show the jar, and then hold it close; 20% off", ["show the jar", "hold it close", "20% off"]),
    ("say it's soft and warm and show the jar", ["say it's soft and warm", "show the jar"]),
    ("", []), (" ; . ", []),
])
def test_a_conjunction_parts_asks_only(sentence, asks):
    assert units.asks_of(sentence) == asks


def plain_items(lines: list[str]) -> list[str]:
    numbered, bulleted = any(re.match(units.TITLE, x) for x in lines), any(re.match(lx.BULLET, x, re.I) for x in lines)
    out: list[list[str]] = []
    after = True
    for x in lines:
        title, bullet = re.match(units.TITLE, x), bool(re.match(lx.BULLET, x, re.I))
        if bool(title) if numbered else bullet or after if bulleted else True:
            out.append([])
        after = bullet
        if out:
            out[-1].append(title[2] if title else re.sub(lx.BULLET, "", x, flags=re.I))
    return [t for t in (re.sub(r"\s+", " ", " ".join(filter(None, (b.strip() for b in i)))).strip() for i in out) if len(t) >= 3]


def test_items_against_a_loop(spark):
    r = random.Random(3)
    some = ["1. Everyday hair", "2) Night  routine", "- show it", "* a", "plain words", "more plain words here", "a. lettered", "3. " + "x" * 90, "-", "ok"]
    rows = [(d, s, "h", "requirements", [r.choice(some[r.choice([0, 2, 4]) :]) for _ in range(r.randint(1, 7))]) for d in range(40) for s in range(3)]
    got = sorted((x.doc, x.section, x.item, x.text) for x in units.section_items(frame(spark, rows)).collect())
    assert got == sorted((d, s, i, t) for d, s, _, _, lines in rows for i, t in enumerate(plain_items(lines)))


def test_units_of_documents(spark):
    rows = [
        (1, 0, "About", "context", ["This guide helps creators."]),
        (1, 1, "Requirements", "requirements", ["- Show the jar and say the name. Mention hydration and barrier support.", "- The creator must hold it close up.", "- This creator begins her video with a joke", "Key facts"]),
        (1, 2, "Hook Concepts", "alternatives", ["These did well", "1. Morning routine", "show the jar and say the name", "This creator starts her video at home.", "2. Night routine", "- hold the jar"]),
        (1, 3, "More", "requirements", ["show the jar!"]),
        (2, 0, "", "requirements", ["show the jar"]),
        (3, 0, "Hook", "alternatives", ["1. Only one: show the jar and say the name"]),
    ]
    got = [(x.doc, x.section, x.item, x.text, x.choice) for x in sorted(units.brief_units(frame(spark, rows)).collect(), key=lambda x: (x.doc, x.unit))]
    assert got == [
        (1, 1, 0, "Show the jar.", None), (1, 1, 0, "say the name.", None), (1, 1, 0, "Mention hydration and barrier support.", None), (1, 1, 1, "The creator must hold it close up.", None),
        (1, 2, 0, "Morning routine show the jar and say the name This creator starts her video at home.", "hook_concepts"), (1, 2, 1, "Night routine hold the jar.", "hook_concepts"),
        (2, 0, 0, "show the jar.", None), (3, 0, 0, "Only one: show the jar.", None), (3, 0, 0, "say the name.", None),
    ]
    assert units.brief_units(frame(spark, [])).count() == 0


def test_query_is_a_loop_over_items(spark):
    from tidemark import plans
    from tidemark.functions import structure
    from tidemark.tables import brief_lines

    d = "/root/testdata/sf0.001"
    items = units.section_items(structure.sections(brief_lines(spark, d), "doc", "pos", "line")).collect()
    want = []
    for doc in {x.doc for x in items}:
        said: set[str] = set()
        own = sorted((x for x in items if x.doc == doc), key=lambda x: (x.section, x.item))
        for x in own:
            if x.kind == "context":
                continue
            alternative = x.kind == "alternatives" and sum(y.section == x.section for y in own) > 1
            sentences = re.split(r'(?<=[.!?])\s+(?=[A-Z0-9"“])', x.text)
            parts = [" ".join(s for s in sentences if not units.described(s))] if alternative else [a for s in sentences for a in units.asks_of(s)]
            for p in parts:
                key = re.sub("[^a-z0-9 ]", "", p.lower()).strip()
                if len(p) >= 3 and key and key not in said and not units.titled(p) and not units.described(p):
                    said.add(key)
                    want.append((doc, x.section, x.item, p.rstrip(".!?\"”")))
    got = [(x.doc, x.section, x.item, x.text.rstrip(".!?\"”")) for x in plans.QUERIES["f27_brief_units"](spark, d).collect()]
    assert want
    assert sorted(got) == sorted(want)


def test_choices_that_a_document_does_not_make(spark):
    sections = [
        (1, 0, "Requirements", "requirements", ["Show the jar close up", "Link in bio"], 0), (1, 1, "Hook ideas", "alternatives", ["Open with a joke", "Tag us in every post"], 0),
        (1, 2, "Back to school", "requirements", ["Wear a blue shirt today"], 0), (1, 3, "Approved claims", "claims", ["Tag us in every post"], 0),
    ]
    rows = [
        (1, 1, "show the jar close up!", None, "g", "one_of", ""),  # a line, marks aside
        (1, 2, "link in bio", None, "g", "any_of", ""),  # a short line as a whole
        (1, 3, "link", "bio", "g", "one_of", ""),  # too short to be a part
        (1, 4, "you must show the jar close up please", None, "g", "one_of", ""),  # has the line as a part
        (1, 5, "Tag us in every post", None, "g", "one_of", ""),  # also an alternative
        (1, 6, "Wear a blue shirt today", None, "g", "one_of", ""),  # no heading says so
        (1, 7, "Open with a joke", "Show the jar close up", "g", "all_of", ""),  # no choice by its mode
        (1, 8, "These statements have not been evaluated by the FDA", None, "g", "one_of", ""),
        (1, 9, "* only while stocks last", None, "g", "all_of", ""), (1, 10, "any words", None, "g", "one_of", "Legal"), (1, 11, "any words #ad", None, None, "all_of", ""),
        (2, 12, "Show the jar close up", None, "g", "one_of", ""), (None, 13, None, None, "g", "one_of", None),
    ]
    r = spark.createDataFrame(rows, "doc long, id long, text string, span string, choice string, choice_mode string, label string")
    got = {x.id: x for x in units.ungrouped(r, spark.createDataFrame(sections, SECTIONS)).collect()}
    assert len(got) == len(rows)
    flags = {i: x.flag for i, x in got.items() if x.flag}
    assert flags == {i: "UNGROUPED_BY_STRUCTURE:g" for i in (1, 2, 4)} | {i: "UNGROUPED_COMPLIANCE_LINE:g" for i in (8, 9, 10)}
    assert all((x.choice, x.choice_mode) == (None, "all_of") for i, x in got.items() if i in flags)
    assert got[6].choice == "g" and got[7].choice == "g" and got[11].choice is None
