"""The pipeline's stages against brute force on a planted corpus."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as cp
from tests.llm.test_ops import components
from tidemark.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> list[tuple]:
    r = random.Random(3)
    parts = {"en": ["the", "th", "ing", "ou", "er"], "de": ["der", "sch", "ung", "ein", "ü"]}
    rows = []
    for i in range(80):
        lang = "en" if i % 2 else "de"
        t = " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(30, 90)))
        rows.append([i, t, lang])
    for i in range(80, 110):  # copies, edited copies
        src = rows[r.randrange(80)]
        w = src[1].split()
        if i % 2:
            w[len(w) // 2] = "edited"
        rows.append([i, " ".join(w), src[2]])
    rows[5][1] += " password=s3cr3t99 end"
    rows += [[200, None, None], [201, "", "en"], [202, "123 456", "en"], [203, rows[7][1] + " und", None]]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    out = []
    for name, f in cp.STAGES:
        docs = written(spark, f(spark, docs, ""), name)
        out.append((name, docs.columns, docs.collect()))
    return out


def test_columns(stages):
    for _, columns, _ in stages[:-1]:
        assert columns == cp.COLUMNS


def test_language_keeps_clean_documents(stages):
    ids = {r.doc_id for r in stages[0][2]}
    assert ids == {i for i, *_ in corpus()} - {200, 201, 202}
    assert {r.doc_id: r.lang for r in stages[0][2]}[203] == "en"


def test_one_document_of_each_group_stays(stages):
    kept = [(r.doc_id, r.text) for r in stages[0][2]]
    want = {c for _, c in components(kept).values()}
    assert {r.doc_id for r in stages[1][2]} == want


def test_secrets_go_and_documents_stay(stages):
    before, after = {r.doc_id: r for r in stages[1][2]}, {r.doc_id: r for r in stages[2][2]}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r.n_chars == len(r.text)
        assert r.text == before[i].text.replace("password=s3cr3t99", "[secret]")


def test_every_document_is_packed(stages):
    rows = stages[3][2]
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages[2][2]}
    total = {r.doc_id: r.doc_tokens for r in rows}
    for i, n in total.items():
        assert sum(r.length for r in rows if r.doc_id == i) == n


def test_repeated_ids(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (3, "x y z u v w q", "en", "s", 13)]
    got = cp.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in got) == [1, 3]


def test_one_id_with_two_texts(spark):
    t, u, v = "a b c d e f g", "x y z u v w q", "k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9"
    near = v.replace("k l", "K l") + " end"
    rows = [(3, t), (5, t), (5, u), (7, v), (7, near), (None, t), (None, "null ids link too a b"), (None, "null ids link too a b"), (8, None), (8, None), (8, "")]
    got = cp.near_duplicates(spark, spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], SCHEMA), "").collect()
    kept = sorted(((r.doc_id, r.text) for r in got), key=str)
    assert sum(i == 7 for i, _ in kept) == 1
    assert [k for k in kept if k[0] != 7] == sorted([(3, t), (5, u), (None, "null ids link too a b"), (8, None), (8, None), (8, "")], key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, f in cp.STAGES:
        docs = written(spark, f(spark, docs, ""), name)
    assert docs.count() == 0
