"""Every repair alone, and several at once."""

from __future__ import annotations

import pytest

from tidemark.operators import repair

SCHEMA = """id long, doc long, text string, type string, mode string, polarity string, priority string, checkable boolean, deadline double, window_start double, window_end double, start_expr string, end_expr string,
classes array<string>, hints array<string>, criteria array<string>, span string, confidence double, choice string, choice_mode string"""
GOOD = {"doc": 1, "text": "Show the jar close up", "type": "visual", "mode": "visual_only", "polarity": "required", "priority": "high", "checkable": True, "deadline": None, "window_start": None, "window_end": None, "start_expr": None, "end_expr": None,
        "classes": [], "hints": ["jar"], "criteria": ["seen"], "span": "show the jar close up", "confidence": 0.9, "choice": None, "choice_mode": "all_of"}
BRIEF = "The launch. Show the jar close up in the first 3 seconds. End with a call to action in the last 10 seconds. Never claim it cures eczema. Say the words about glow and premium feel. Reduce hair loss by 27% after 3 months."
CASES = {
    "good": ({}, []),
    "type": ({"type": "Vsual"}, ["TYPE_OUT_OF_ENUM:vsual->visual"]),
    "no type": ({"type": None}, ["TYPE_OUT_OF_ENUM:missing->visual"]),
    "case": ({"type": " VISUAL ", "mode": "Visual_Only"}, []),
    "polarity": ({"polarity": "maybe"}, ["POLARITY_OUT_OF_ENUM:maybe->required"]),
    "polarity disagrees": ({"polarity": "forbidden", "classes": ["cure"]}, ["POLARITY_DISAGREES:model=forbidden,rules=required"]),
    "mode": ({"mode": "eyes"}, ["MODE_OUT_OF_ENUM:eyes->visual_only"]),
    "mode disagrees": ({"mode": "speech_only"}, ["MODE_DISAGREES:model=speech_only,rules=visual_only"]),
    "priority": ({"priority": ""}, ["PRIORITY_OUT_OF_ENUM:missing->high"]),
    "checkable": ({"checkable": None}, ["MACHINE_CHECKABLE_MISSING->true"]),
    "negative": ({"deadline": -1.0}, ["DEADLINE_NOT_POSITIVE:-1.0"]),
    "implausible": ({"deadline": 601.0}, ["DEADLINE_IMPLAUSIBLE:601.0"]),
    "start": ({"start_expr": "duration ^ 2"}, ["WINDOW_START_EXPR_INVALID:duration ^ 2"]),
    "end": ({"end_expr": "len("}, ["WINDOW_END_EXPR_INVALID:len("]),
    "unsupported": ({"start_expr": "duration - 15"}, ["WINDOW_UNSUPPORTED_BY_BRIEF:duration - 15;not_in_brief=15"]),
    "missed deadline": ({"text": "Show the jar close up in the first 3 seconds", "type": "visual"}, ["DEADLINE_MISSED_BY_MODEL:rules_found=3.0"]),
    "missed window": ({"text": "Show the jar close up in the last 10 seconds"}, ["WINDOW_MISSED_BY_MODEL:rules_found=duration - 10"]),
    "window disagrees": ({"text": "Show the jar close up in the last 10 seconds", "start_expr": "duration - 5"}, ["WINDOW_DISAGREES_WITH_BRIEF:model=duration - 5;rules=duration - 10"]),
    "hardcoded": ({"text": "Show the jar close up at the end", "window_start": 25.0, "window_end": 30.0}, ["END_RELATIVE_HARDCODED:25.0->duration - 5"]),
    "inverted": ({"window_start": 9.0, "window_end": 4.0}, ["WINDOW_INVERTED:9.0>4.0"]),
    "class": ({"classes": ["Cure", "magic", "cure"]}, ["CLAIM_CLASS_OUT_OF_ENUM:magic"]),
    "hints": ({"hints": [" "]}, ["MATCH_HINTS_MISSING:generated_from_rules"]),
    "no span": ({"span": " "}, ["BRIEF_SPAN_MISSING"]),
    "invented": ({"span": "dance on the moon with penguins"}, ["SPAN_NOT_IN_BRIEF:possible_invention"]),
    "choice mode": ({"choice": "a", "choice_mode": "two_of"}, ["GROUP_MODE_OUT_OF_ENUM:two_of->all_of"]),
    "no choice": ({"choice_mode": "one_of"}, ["GROUP_MODE_WITHOUT_GROUP:one_of->all_of"]),
    "claim": ({"span": "reduce hair loss by 27% after 3 months"}, ["FROM_APPROVED_CLAIMS:Reduce hair loss by 27% after 3 months"]),
    "claim of a choice": ({"span": "reduce hair loss by 27% after 3 months", "choice": "c"}, []),
    "many": ({"type": "", "mode": None, "polarity": None, "priority": None, "checkable": None, "hints": None, "criteria": None, "span": None, "confidence": None, "classes": None, "choice_mode": None},
             ["TYPE_OUT_OF_ENUM:missing->visual", "POLARITY_OUT_OF_ENUM:missing->required", "MODE_OUT_OF_ENUM:missing->visual_only", "PRIORITY_OUT_OF_ENUM:missing->high", "MACHINE_CHECKABLE_MISSING->true", "MATCH_HINTS_MISSING:generated_from_rules", "BRIEF_SPAN_MISSING"]),
}


@pytest.fixture(scope="module")
def got(spark):
    names = [f.split()[0] for f in SCHEMA.replace("\n", " ").split(", ")]
    rows = [tuple({"id": i, **GOOD, **change}[n] for n in names) for i, (change, _) in enumerate(CASES.values())]
    rows += [tuple({"id": 900, **GOOD, "text": "  "}[n] for n in names), tuple({"id": 901, **GOOD, "text": None}[n] for n in names), tuple({"id": 902, **GOOD, "doc": 7}[n] for n in names)]
    documents = spark.createDataFrame([(1, BRIEF)], "doc long, text string")
    claims = spark.createDataFrame([(1, 0, "Reduce hair loss by 27% after 3 months"), (1, 1, "Glow all day")], "doc long, pos long, claim string")
    return {r.id: r for r in repair.repair_requirements(spark.createDataFrame(rows, SCHEMA), documents, claims).collect()}


@pytest.mark.parametrize("case", CASES)
def test_flags(got, case):
    assert got[list(CASES).index(case)].flags == CASES[case][1]


def test_what_repairs_set(got):
    row = lambda case: got[list(CASES).index(case)]
    assert (row("missed deadline").deadline, row("implausible").deadline, row("negative").deadline) == (3.0, None, None)
    assert (row("missed window").start_expr, row("missed window").end_expr) == ("duration - 10", "duration")
    assert (row("hardcoded").window_start, row("hardcoded").window_end, row("hardcoded").start_expr) == (None, None, "duration - 5")
    assert (row("inverted").window_start, row("inverted").window_end) == (4.0, 9.0)
    assert row("class").classes == ["Cure"]
    assert (row("good").confidence, row("invented").confidence, row("mode disagrees").confidence, row("many").confidence) == (0.9, 0.4, 0.4, 0.6)
    assert row("many").criteria == ["Show the jar close up"] and row("many").span == "Show the jar close up"
    assert (row("mode").mode, row("no choice").choice_mode) == ("visual_only", "all_of")


def test_rows_without_text_or_document(got):
    assert 900 not in got and 901 not in got
    assert got[902].flags == ["SPAN_NOT_IN_BRIEF:possible_invention"]
