"""Work that must not grow with repeated texts, or stay in the few tasks that small files make."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests import oracle
from tests.test_restatements import DATA, plain_windows
from tidemark import plans, tables
from tidemark.functions import fuzzy, phrases, spoken
from tidemark.functions import text as tx
from tidemark.operators import scoring, selection


def test_per_text(spark):
    """Made once a distinct text, in as many tasks as a shuffle has; repeats and nulls keep their rows."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(t):
        seen.add(1)
        return None if t is None else t * 2

    rows = [(i, None if i % 5 == 4 else "abcd"[i % 5]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    tasks = []
    got = tables.per_text(df, "text", lambda t: tasks.append(t.rdd.getNumPartitions()) or t.withColumn("x", slow("text")))
    assert sorted((r.id, r.x) for r in got.collect()) == [(i, t and t * 2) for i, t in rows]
    assert got.columns == ["id", "text", "x"]
    assert seen.value == 5 and tasks == [4]


@pytest.mark.parametrize("name", ["f17_hint_score", "f9_caption_similarity", "r4_fuzzy_phrases", "r22_claim_candidates"])
def test_once_a_text(spark, name):
    """Python works on distinct texts that are dealt over all tasks."""
    plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    python, dealt = plan.index("ArrowEvalPython"), plan.index("REPARTITION_BY_NUM")
    assert python < dealt < plan.index("HashAggregate", dealt) and plan.count("ArrowEvalPython") == 1


def test_partial_ratio_asks_few_windows(monkeypatch):
    """Windows that can't be better are passed over: no ratio is asked for a window at all, and the best is the brute-force one."""
    ratio, r = fuzzy.ratio, random.Random(4)
    monkeypatch.setattr(fuzzy, "ratio", None)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd ") for _ in range(r.randint(1, n))) for n in (12, 60))
        s, t = sorted((a, b), key=len)
        assert fuzzy.partial_ratio(a, b) == max(ratio(s, t[max(0, i) : i + len(s)]) for i in range(1 - len(s), len(t)))


def test_terms_held_are_sought_by_pieces(monkeypatch):
    """A ratio is asked for only where a piece of the term stands; what holds a term is what brute force finds."""
    asked, r = [], random.Random(5)
    full = fuzzy.term_ratio
    monkeypatch.setattr(fuzzy, "term_ratio", lambda t, h: asked.append(t) or full(t, h))
    assert not fuzzy.holds_term("dermatologist recommended", "hold the white jar close up, then say its name aloud", 90) and not asked
    assert fuzzy.holds_term("dermatologist recommended", "a dermatolgist recommended serum", 90) and asked
    for _ in range(2000):
        term, hay = ("".join(r.choice("abcd ") for _ in range(r.randint(1, n))) for n in (16, 50))
        least = r.choice([70, 80, 90, 95])
        assert fuzzy.holds_term(term, hay, least) == (full(term, hay) >= least)


@pytest.mark.parametrize("name", ["f29_infer_type"])
def test_patterns_once_a_text(spark, name):
    """Ladders of patterns are worked out above an exchange of distinct texts, not on the rows of a small file."""
    plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "REPARTITION_BY_NUM" in line)
    assert any("RLIKE" in line for line in plan[:at]) and not any("RLIKE" in line for line in plan[at:])


def test_equal_words_are_compared_once(monkeypatch):
    """A run of events works on each text and each pair of words once."""
    from tidemark.operators import sequential as sq

    asked, full = [], phrases.content_tokens
    sq._facts.cache_clear()
    monkeypatch.setattr(phrases, "content_tokens", lambda t: asked.append(t) or full(t))
    texts = ["she holds the jar", "she is holding a jar"] * 50
    rows = [{"id": i, "start": i, "end": i, "kind": "k", "text": t} for i, t in enumerate(texts)]
    assert [(r["id"], r["n"]) for r in sq.merge_events(rows, 1)] == [(0, 100)]
    assert sorted(asked) == sorted(set(texts))


def test_options_of_one_text_are_compared_once():
    """Claims are those of the loop over all options, and two texts are compared once however often they occur."""
    from tidemark.operators import sequential as sq

    def loop(requirements, options, same):
        left, out = sorted(options, key=lambda o: o["pos"]), []
        for r in sorted(requirements, key=lambda r: r["pos"]):
            hit = next((o for o in left if same(r["text"], o["text"])), None)
            if hit is not None:
                left.remove(hit)
            out.append({"text": r["text"], "option": hit["text"] if hit else None, "added": False})
        return out + [{"text": o["text"], "option": o["text"], "added": True} for o in left]

    r, asked = random.Random(6), []
    close = lambda a, b: abs(ord(a) - ord(b)) <= 1
    for _ in range(100):
        want, have = ([{"pos": p, "text": r.choice("abcdefg")} for p in r.sample(range(99), r.randint(0, 40))] for _ in range(2))
        asked.clear()
        assert sq.claim_options(want, have, lambda a, b: asked.append((a, b)) or close(a, b)) == loop(want, have, close)
        assert len(asked) == len(set(asked))


def test_windows_are_normalised_by_tokens(monkeypatch):
    """Windows of a row are made of tokens that are normalised once each, and are what normalize_text makes of them."""
    words, r = ["the", "twenty", "five", "two", "hundred", "%", "$", "5", "20%", "well-known", "it's", "-", "Σας", "percent"], random.Random(7)
    for _ in range(300):
        tokens = [r.choice(words) for _ in range(r.randint(1, 12))]
        for n in range(1, len(tokens) + 1):
            want = [phrases.normalize_text(" ".join(tokens[i : i + n])) for i in range(len(tokens) - n + 1)]
            assert phrases._windows([phrases._plain(t) for t in tokens], n) == want
    monkeypatch.setattr(phrases, "normalize_text", None)
    assert phrases.find_phrases("you save twenty five now".split(), {0: ["save 25 now"]})[0][:4] == (0, 1, 4, 100)


def test_windows_of_captions_all_at_once(monkeypatch):
    """No window is compared on its own (F3), and what comes out is each window's best of four likenesses by brute force."""
    r, plain = random.Random(11), {}
    parts = ["the", "er", "in", "ou", "st", "an", "20", "ñü", "twenty", "one", "hundred", "%", "$", "5", "Σ", "语言", "🙂", "x" * 70]
    word = lambda: "".join(r.choices(parts[:7] if r.random() < 0.9 else parts, k=r.randint(1, 3)))
    for _ in range(150):
        speech, caption = [word() for _ in range(r.choice([0, 1, 5, 30, 90]))], [word() for _ in range(r.choice([1, 2, 6, 25]))]
        if speech and r.random() < 0.5:
            at = r.randrange(len(speech))
            caption = [*speech[at : at + 20], word()]
        plain[" ".join(caption), " ".join(speech)] = plain_windows(" ".join(caption), " ".join(speech)) if speech else None
    assert spoken.best_windows(list(plain)) == list(plain.values())
    asked, lcs = [], fuzzy.lcs
    monkeypatch.setattr(fuzzy, "lcs", lambda a, b: asked.append(a) or lcs(a, b))
    some = [(" ".join(word() for _ in range(12)), " ".join(word() for _ in range(200))) for _ in range(5)]
    assert len(spoken.best_windows(some)) == 5 and len(asked) < 5 * 61  # one ratio a window was asked for before, and more


def test_captions_are_dealt_over_all_tasks(spark):
    """The search in windows (F3) comes behind an exchange that neither goes for another one nor is made few tasks of."""
    plan = plans.QUERIES["j5_caption_speech"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    python = plan.index("ArrowEvalPython")
    assert "xxhash64" in plan[plan.index("Exchange", python) :].splitlines()[0] and "REPARTITION_BY_NUM" in plan[plan.index("Exchange", python) :].splitlines()[0]


def test_normalised_text_is_split_once(spark):
    """Spelled numbers look at their neighbours (F10): the text must not be split anew for each look of each word."""
    df = spark.createDataFrame([("one two hundred twenty five " * 3,)], "t string").select(tx.normalize_text(F.col("t")).alias("n"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 1
    assert df.first().n == phrases.normalize_text("one two hundred twenty five " * 3)


def test_meaning_holds_one_pair_of_blocks(spark):
    """Vectors of a key's pairs of blocks (F7) reach a task one pair after the other, not as batches of rows that each hold two whole blocks."""
    plan = plans.QUERIES["k10_meaning"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapCoGroupsInArrow", "") and "collect_list" not in plan


def test_merging_makes_its_rows_once(spark):
    """What makes the requirements (F8) is run once, not for each use of them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(t):
        seen.add(1)
        return t

    rows = [(1, i, "say", f"say the word {'abc'[i % 3] * 9}", None, "high", "any", None, None, ["h"], ["c"], ["k"]) for i in range(6)]
    df = spark.createDataFrame(rows, "brief long, id long, kind string, text string, choice string, priority string, mode string, deadline long, window string, hints array<string>, criteria array<string>, classes array<string>")
    merged = selection.merge_requirements(df.withColumn("text", slow.asNondeterministic()("text"))).collect()
    assert sorted(x for r in merged for x in [r.id, *r.merged]) == list(range(6)) and seen.value == 6


@pytest.mark.parametrize("name", ["a20_group_of_one", "w12_group_resolution", "r17_score_by_order"])
def test_units_join_by_number_of_lines(spark, monkeypatch, name):
    """Tasks of the join of verdicts (F13) become more with the lines and each keeps few, whole orders; rows are those of the SQL."""
    lines = tables.load(spark, DATA, "lineitem").count()
    monkeypatch.setattr(tables, "LINES", lines // 10)
    tasks = -(-lines // tables.LINES)
    per = tables.units(spark, DATA).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count_distinct("grp").alias("groups")).collect()
    assert 4 < len(per) <= tasks and max(r.n for r in per) < 2 * tables.LINES and sum(r.n for r in per) == tables.units(spark, DATA).count()
    assert sum(r.groups for r in per) == tables.units(spark, DATA).select("grp").distinct().count()
    plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert f", {tasks}), REPARTITION_BY_NUM" in plan
    assert oracle.difference(spark, oracle.connect(DATA), plans.QUERIES[name], plans.ORACLE[name], DATA) == ""


def test_choice_groups_stay_where_orders_lie(spark, monkeypatch):
    """Groups are resolved in the tasks that join the orders (F13), not in a fixed number of them; a null group is not another row's negative id."""
    monkeypatch.setattr(tables, "LINES", 1000)
    plan = plans.QUERIES["w12_group_resolution"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges)
    rows = [(1, None, 7), (1, None, 7), (1, None, 8), (1, -8, 9), (1, 3, 1), (1, 3, 2), (2, 3, 4)]
    df = spark.createDataFrame([(*r, 1, "PASS", None) for r in rows], "video long, grp long, id long, ordinal int, status string, alignment string")
    kept = scoring.resolve_groups(df, ["video"], ()).filter("not lost").collect()
    assert sorted(r.id for r in kept) == [1, 4, 7, 8, 9]
