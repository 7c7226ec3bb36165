"""Operators against small restatements in plain Python."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import cues, fuzzy, phrases, structure
from tidemark.functions import text as tx
from tidemark.functions.expressions import column_of, valid
from tidemark.operators import intervals as iv
from tidemark.operators import matching, selection
from tidemark.operators import ranking as rk
from tidemark.operators import scoring as sc
from tidemark.operators import sequential as sq


def spans(n: int, seed: int = 1) -> list[tuple[int, int, int]]:
    r = random.Random(seed)
    return [(r.randint(0, 2), a := r.randint(0, 300), a + r.randint(0, 25)) for _ in range(n)]


def union(rows, gap=0):
    out = []
    for a, b in sorted(rows):
        if out and a - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("gap", [0, 3])
def test_union(spark, gap):
    rows = spans(60)
    got = iv.union(spark.createDataFrame(rows, "k long, a long, b long"), ["k"], "a", "b", gap).collect()
    want = {(k, *x) for k in range(3) for x in union([(a, b) for q, a, b in rows if q == k], gap)}
    assert {(r.k, r.a, r.b) for r in got} == want


def test_union_skips_null_ends(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, None), (1, 5, 5)], "k long, a long, b long")
    assert [(r.a, r.b, r.n) for r in iv.union(df, ["k"], "a", "b").collect()] == [(0, 5, 2)]


def test_overlap_join(spark):
    left, right = spans(80, 2), spans(80, 3)
    l = spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "i long, k long, a long, b long")
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(right)], "j long, k long, c long, d long")
    got = sorted((x.i, x.j) for x in iv.overlap_join(l, r, ["k"], ("a", "b"), ("c", "d"), slack=4, width=10).collect())
    want = sorted((i, j) for i, (k, a, b) in enumerate(left) for j, (q, c, d) in enumerate(right) if k == q and a - 4 <= d and b + 4 >= c)
    assert got == want


def test_nearest_tie_goes_to_the_earlier(spark):
    p = spark.createDataFrame([(1, 5), (1, 100), (1, 10), (2, 3)], "k long, t long")
    g = spark.createDataFrame([(1, 0), (1, 10)], "k long, g long")
    assert {(r.k, r.t): r.g for r in iv.nearest_join(p, g, ["k"], "t", "g").collect()} == {(1, 5): 0, (1, 100): 10, (1, 10): 10, (2, 3): None}


def test_quota_keeps_the_minority(spark):
    """Ranked first, twenty texts would crowd out the two that were said; without the quota they do."""
    rows = [("q", "ocr", i, 100 - i) for i in range(20)] + [("q", "speech", 20 + i, 10 - i) for i in range(2)]
    df = spark.createDataFrame(rows, "q string, kind string, id long, score long")
    pick = lambda share: {r.kind for r in rk.quota_top_k(df, ["q"], "kind", [F.desc("score"), F.col("id")], 8, share).collect()}
    assert pick(0.6) == {"ocr", "speech"}
    assert pick(1.0) == {"ocr"}


@pytest.mark.parametrize(("n", "k"), [(3, 8), (8, 8), (50, 8), (9, 8)])
def test_spread(spark, n, k):
    df = spark.range(n).withColumn("g", F.lit(1))
    want = list(range(n)) if n <= k else sorted({min(n - 1, i * n // k) for i in range(k)})
    assert sorted(r.id for r in rk.spread(df, ["g"], [F.col("id")], k).collect()) == want


def unit(**x):
    return {"video": 1, "grp": 1, "id": 1, "ordinal": 1, "status": "PASS", "alignment": None, "priority": "low", "w2": 1, "q": 0, "polarity": "", "dimension": "", "flag": ""} | x


SCHEMA = "video long, grp long, id long, ordinal int, status string, alignment string, priority string, w2 int, q long, polarity string, dimension string, flag string"


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


@pytest.mark.parametrize(
    ("rows", "winner"),
    [
        ([unit(id=1, status="FAIL"), unit(id=2, status="PARTIAL")], 2),
        ([unit(id=1, alignment=None), unit(id=2, alignment="none")], 2),
        ([unit(id=1, ordinal=0), unit(id=2, ordinal=9)], 2),
        ([unit(id=2), unit(id=1)], 1),
        ([unit(id=7, status="FAIL")], 7),
    ],
)
def test_choice_groups(spark, rows, winner):
    got = sc.resolve_groups(frame(spark, rows), ["video"]).filter("not lost").collect()
    assert [r.id for r in got] == [winner]


def test_abstention(spark):
    """UNCERTAIN counts in the total only, NOT_APPLICABLE nowhere; nothing decided: no optimistic score."""
    rows = [unit(id=1, w2=6), unit(id=2, status="UNCERTAIN", w2=4), unit(id=3, status="NOT_APPLICABLE", w2=6), unit(id=4, video=2, status="UNCERTAIN"), unit(id=5, video=3, status="NOT_APPLICABLE")]
    got = {r.video: r for r in sc.verdict(sc.bands(sc.sums(frame(spark, rows), ["video"]))).collect()}
    assert (got[1].pessimistic, got[1].optimistic, got[1].coverage) == (60.0, 100.0, 0.6)
    assert (got[2].pessimistic, got[2].optimistic, got[2].band) == (0.0, None, "REJECTED")
    assert 3 not in got


def test_critical_failure_caps_the_band(spark):
    rows = [unit(id=i, w2=6) for i in range(20)] + [unit(id=99, status="FAIL", priority="critical", w2=1)]
    r = sc.verdict(sc.bands(sc.sums(frame(spark, rows), ["video"]))).first()
    assert (r.optimistic, r.band, r.floored) == (99.0, "NEEDS_MAJOR_REVISION", True)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc d", max_size=80), st.text("abc d", max_size=80))
def test_lcs(a, b):
    assert fuzzy.lcs(a, b) == slow_lcs(a, b)


def test_ratios():
    assert round(fuzzy.ratio("20 percent off", "25 percent off"), 2) == 92.86
    assert fuzzy.robust_ratio("a b c", "abc") == 100
    assert fuzzy.contains_ratio("off", "20 percent off") == 100
    assert fuzzy.contains_ratio("twenty percent", "ten") < 80
    assert fuzzy.token_set_ratio("b a a", "a b") == 100
    assert fuzzy.ratio("", "") == 100


def test_expressions(spark):
    df = spark.createDataFrame([(10.0,), (0.0,)], "d double")
    assert [r[0] for r in df.select(column_of("(duration - 4) * 2 / 3", F.col("d"))).collect()] == [4.0, -8 / 3]
    assert not valid("duration / (duration - 30)")
    for bad in ("duration -", "2 ** 3", "duration; drop", "", "(1"):
        assert not valid(bad)
        with pytest.raises(ValueError):
            column_of(bad, F.col("d"))


def test_sequential():
    ev = [{"id": i, "start": i, "end": i, "kind": "k", "text": t} for i, t in enumerate(["a woman speaks", "the woman continues speaking", "a jar", "woman jar"])]
    assert [(r["id"], r["n"], r["text"]) for r in sq.merge_events(ev, 1)] == [(0, 2, "the woman continues speaking"), (2, 1, "a jar"), (3, 1, "woman jar")]
    assert list(sq.merge_events([], 1)) == []
    det = [{"t": t, "text": x, "confidence": c} for t, x, c in [(0, "A", 0.5), (1, "B", 0.5), (2, "A", 0.6), (30, "A", 0.9), (31, "C", 0.1)]]
    got = list(sq.text_intervals(det, 5, lambda a, b: a["text"] == b["text"]))
    assert [(r["start"], r["end"], r["text"], r["n"]) for r in got] == [(0, 2, "A", 2), (30, 30, "A", 1)]
    frames = [{"idx": i, "frame": [0]} for i in range(6)]
    assert [r["read"] for r in sq.read_frames(frames, lambda a, b: a == b)] == [True, False, False, False, True, False]
    rule = lambda i, t, h, f=False, c=(): {"id": i, "text": t, "hints": h, "figures": f, "classes": c}
    rules = [rule(1, "long one", ["a", "b"]), rule(2, "short", ["a", "b", "c"]), rule(4, "figs", ["x"], True, ["cure"]), rule(5, "fig", ["y"], True, ["cure"]), rule(3, "x", [])]
    assert [(r["id"], r["hints"], r["merged"]) for r in sq.merge_rules(rules)] == [(1, "a,b,c", 1), (4, "x,y", 1), (3, "", 0)]
    req, opt = [{"pos": 1, "text": "a"}, {"pos": 2, "text": "a"}], [{"pos": 1, "text": "a"}, {"pos": 2, "text": "z"}]
    assert [(r["text"], r["option"], r["added"]) for r in sq.claim_options(req, opt, str.__eq__)] == [("a", "a", False), ("a", None, False), ("z", "z", True)]


def test_captions():
    """Numbers part captions; a caption that grows word by word is one; another place is another caption."""
    box = (0, 0, 40, 10)
    assert sq.one_caption("shop now", box, "shopnow", (2, 0, 42, 10))
    assert not sq.one_caption("shop now", box, "shop now", (60, 0, 100, 10))
    assert not sq.one_caption("code save20", box, "code save30", box)
    assert sq.one_caption("everyone", (0, 0, 30, 10), "everyone talks about", (0, 0, 90, 10))
    assert not sq.one_caption("everyone", (0, 50, 30, 60), "everyone talks about", (0, 0, 90, 10))
    assert sq.iou((0, 0, 2, 1), (1, 0, 3, 1)) == pytest.approx(1 / 3)
    assert sq.iou((0, 0, 0, 0), (0, 0, 0, 0)) == 0


def test_streams_are_sorted_and_whole(spark):
    r = random.Random(5)
    rows = [(r.randrange(4), i, r.randrange(9)) for i in range(300)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, i long, x long").repartition(5)
    got = sq.streamed(df, ["k"], ["i"], lambda own: ({"i": y["i"], "run": n} for n, y in enumerate(own)), "k long, i long, run long", rows=7).collect()
    want = []
    for k in range(4):
        want += [(k, i, n) for n, i in enumerate(sorted(i for kk, i, _ in rows if kk == k))]
    assert sorted(map(tuple, got)) == want
    assert sq.streamed(df.limit(0), ["k"], ["i"], lambda own: (), "k long, i long").count() == 0


def test_partitioning_does_not_matter(spark):
    rows = spans(50, 5)
    df = spark.createDataFrame(rows, "k long, a long, b long")
    one = sorted(map(tuple, iv.union(df.coalesce(1), ["k"], "a", "b").collect()))
    assert one == sorted(map(tuple, iv.union(df.repartition(7), ["k"], "a", "b").collect()))


def test_separated(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 4, 5, 9, 10, 16)], "k long, t long")
    assert sorted(r.t for r in iv.separated(df, ["k"], "t", 5).collect()) == [0, 5, 10, 16]


def test_store(spark, tmp_path):
    from tidemark.sources import Store

    s, calls = Store(spark, str(tmp_path)), []

    def make():
        calls.append(1)
        return spark.range(3)

    df, key, hit = s.run("text", "1", ["b", "a"], {"x": 1}, make)
    assert (df.count(), hit, len(key)) == (3, False, 16)
    assert s.run("text", "1", ["a", "b"], {"x": 1}, make)[1:] == (key, True)
    assert s.run("text", "2", ["a", "b"], {"x": 1}, make)[2] is False
    assert len(calls) == 2
    assert s.get("text", ["0" * 16, key])[1] == "exact"
    assert s.get("text", ["0" * 16])[1] == "fallback"
    assert s.get("other", [key]) == (None, "missing")


def test_files(spark, tmp_path):
    import io
    import wave
    import zipfile

    from tidemark import sources

    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_bytes("﻿one\r\ntwo".encode())
    (tmp_path / "t/b.txt").write_text("<!DOCTYPE html><p>log in")
    assert [r.text for r in sources.read_documents(spark, str(tmp_path / "t")).collect()] == ["one\ntwo"]
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(b"\x00\x00\x00\x40")
    r = sources.read_wav(spark, str(tmp_path / "x.wav")).first()
    assert (r.rate, r.samples) == (16000, [0.0, 0.5])
    b = spark.read.format("binaryFile").load(str(tmp_path / "x.wav"))
    assert b.select(sources.sniff(F.col("content"))).first()[0] == "wav"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name in ("a/v.MP4", "b/v.mp4", "n.txt"):
            z.writestr(name, name)
    (tmp_path / "v.zip").write_bytes(buf.getvalue())
    assert sorted(r.name for r in sources.unzipped(spark, str(tmp_path / "v.zip")).collect()) == ["v.mp4", "v_1.mp4"]
    sources.write_html(spark.createDataFrame([("<b>",)], "x string"), str(tmp_path / "h"), "t")
    assert "&lt;b&gt;" in "".join(p.read_text() for p in (tmp_path / "h").glob("part-*"))
    spark.range(2).write.json(str(tmp_path / "j"))
    assert sources.read_json(spark, str(tmp_path / "j"), "id long, other string").count() == 2


def stream_rows(spark, folder, n=60):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=7 * i if i % 20 else 7 * i + 400), i % 3, "click" if i % 2 else "view", 1.0, "{}") for i in range(n)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(folder)
    return df


def test_streams_agree_with_batch(spark, tmp_path):
    from tidemark import streaming as sm
    from tidemark.streaming.operators import events_stream, upserted

    df = stream_rows(spark, str(tmp_path / "in"))
    batch = df.withColumn("at", F.col("ts").cast("timestamp"))
    for name, f in (("tumble", sm.tumbling_windows), ("slide", sm.sliding_windows), ("sess", sm.session_windows)):
        got = sm.run_available(f(events_stream(spark, str(tmp_path / "in"), df.schema)), name, "complete", str(tmp_path / f"c{name}"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, f(batch).collect()))
    both = df.unionByName(df)
    both.write.parquet(str(tmp_path / "twice"))
    once = sm.run_available(sm.deduplicated(events_stream(spark, str(tmp_path / "twice"), df.schema, late="30 days")), "once", "append", str(tmp_path / "cd"))
    assert once.count() == df.count()
    q = upserted(events_stream(spark, str(tmp_path / "twice"), df.schema), str(tmp_path / "out"), ["event_id"], str(tmp_path / "cu"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()  # each once, though the files have all twice


def test_upserts_know_earlier_batches(spark, tmp_path):
    from tidemark.streaming.operators import events_stream, upserted

    df = stream_rows(spark, str(tmp_path / "in"))
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "again"))
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "again"))
    q = upserted(events_stream(spark, str(tmp_path / "again"), df.schema, files_per_trigger=1), str(tmp_path / "o"), ["event_id"], str(tmp_path / "c"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.count() == df.count() == got.select("event_id").distinct().count()


def test_stateful_intervals_close(spark, tmp_path):
    from tidemark import streaming as sm
    from tidemark.streaming.operators import events_stream

    df = stream_rows(spark, str(tmp_path / "in"))
    late = [(999, datetime(2024, 2, 1), 9, "click", 1.0, "{}")]
    spark.createDataFrame(late, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = sm.text_sessions(events_stream(spark, str(tmp_path / "in"), df.schema, late="0 seconds", files_per_trigger=1), 3600.0)
    got = sm.run_available(rows, "state", "append", str(tmp_path / "c")).agg(F.sum("n")).first()[0]
    assert got is not None and 0 < got <= df.count()


def test_replies_and_phrases():
    from tidemark.functions import parsing

    assert parsing.parsed('{"b": 1, "a": "}"}') == ('{"a":"}","b":1}', "direct")
    assert parsing.parsed('text {"a": "{\\"x"} more') == ('{"a":"{\\"x"}', "extracted")
    assert parsing.parsed("{'a': True,}") == ('{"a":true}', "repaired")
    assert parsing.parsed("nothing") == (None, "failed")
    assert parsing.parsed(None) == (None, "failed")


# --- text to the letter


@pytest.mark.parametrize(
    ("text", "norm"),
    [
        ("Twenty-five % off", "25% off"),
        ("two hundred", "200"),
        ("$ 5 — only!", "$5 only"),
        ("twentyfive", "25"),
        ("ninety nine hundred", "99 100"),
        ("one, two; three", "1 2 3"),
        ("a hundred", "a 100"),
        ("25-50% off", "25 50% off"),
        ("sixty", "60"),
        ("nineteen or zero", "19 or 0"),
        ("someone often", "someone often"),
        ("", ""),
    ],
)
def test_normal_text(spark, text, norm):
    assert phrases.normalize_text(text) == norm
    assert spark.createDataFrame([(text,)], "t string").select(tx.normalize_text(F.col("t"))).first()[0] == norm


def test_numbers_fold_alike_in_both_forms(spark):
    r = random.Random(4)
    some = ["one", "five", "twenty", "ninety", "hundred", "twentyfive", "ten", "x", "7", "%", "$", "zero"]
    rows = [(" ".join(r.choice(some) for _ in range(r.randint(1, 7))),) for _ in range(400)]
    got = spark.createDataFrame(rows, "t string").select("t", tx.normalize_text(F.col("t")).alias("n"), tx.content_tokens(F.col("t")).alias("c")).collect()
    assert all(x.n == phrases.normalize_text(x.t) and x.c == phrases.content_tokens(x.t) for x in got)


def test_variants():
    assert phrases.phrase_variants("25% off") == ["25 percent off", "25% off", "twenty five percent off"]
    assert phrases.phrase_variants("two hundred steps") == ["200 steps", "two hundred steps"]
    assert phrases.phrase_variants("100% cotton") == ["100 percent cotton", "100% cotton", "hundred percent cotton"]
    assert [phrases.spelled(n) for n in (0, 13, 40, 47, 100, 101)] == ["zero", "thirteen", "forty", "forty seven", "hundred", ""]


def test_digit_guards(spark):
    rows = [("20% off", "20% off use code save30", False, True), ("20% off", "25% off", True, True), ("off", "30", False, False), ("save20", "save", True, False)]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, b string")
    assert [tuple(r) for r in df.select(tx.digits_missing(F.col("a"), F.col("b")), tx.digits_conflict(F.col("a"), F.col("b"))).collect()] == [r[2:] for r in rows]
    assert [phrases.digits_missing(a, b) for a, b, *_ in rows] == [r[2] for r in rows]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("27% and 27 percent", [(27, "pct"), (27, "pct")]),
        ("3months, 3 months", [(3, "months"), (3, "months")]),
        ("27.5 % of 1,500 users", [(27.5, "pct"), (1500, "")]),
        ("3 times in 2 weeks", [(3, "times"), (2, "weeks")]),
        ("used 3 monthly", [(3, "")]),
        ("2x faster", [(2, "times")]),
        ("none", []),
    ],
)
def test_figures(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(tx.figures(F.col("t"))).first()[0]
    assert [(f.value, f.unit) for f in got] == want


def test_terms(spark):
    rows = [("heal", "your hair heals", 100), ("heal", "healing", 100), ("heal", "your hair looks healthy", 0), ("27%", "now 27% off", 100), ("$5", "for $5 only", 0), ("dermatologist recommended", "a dermatolgist recommended serum", 96), ("dermatologist", "hair", 0), ("", "x", 0), ("a.b", "a.b c", 100), ("a.b", "axb c", 0)]
    df = spark.createDataFrame([r[:2] for r in rows], "t string, h string")
    got = [r[0] for r in df.select(fuzzy.term_score(F.col("t"), F.col("h"))).collect()]
    assert got == [w for *_, w in rows]
    best = df.limit(1).select(fuzzy.hint_score(["no", "hair", "heal", "looks like"], F.lit("your hair heals"))).first()[0]
    assert (best.score, best.hint) == (100, "hair")


def test_likeness_to_the_letter():
    assert fuzzy.contains_ratio("shop now", "shopnow") == 100
    assert fuzzy.contains_ratio("shop now", "shop") < 85
    assert fuzzy.contains_ratio("shop now", "go and shop now please") == 100
    assert fuzzy.token_recall("and the of", "anything") == (0, 0)
    assert fuzzy.token_recall("everyone talks about hair growth, but what about hair shine?", "everybody talks about hair growth but nobody talks about hair shine") == (100, 5)
    assert fuzzy.caption_similarity("20% off", "20% off")[1] == "contains"
    assert fuzzy.same_word("hold", "holding") and not fuzzy.tokens_match("applying", "applies")
    assert fuzzy.same_word("applying", "applies") and not fuzzy.same_word("head", "hand")
    r = random.Random(2)
    for _ in range(300):  # the bound on windows loses nothing
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(1, n))) for n in (6, 14))
        s, t = sorted((a, b), key=len)
        want = max(fuzzy.ratio(s, t[max(0, i) : i + len(s)]) for i in range(1 - len(s), len(t)))
        assert fuzzy.partial_ratio(a, b) == want


def test_phrases_in_windows():
    t = "get twenty five percent off now and shopnow or save 20 percent".split()
    want = {0: "25% off", 1: "20% off", 2: "shop now"}
    got = phrases.find_phrases(t, {i: phrases.phrase_variants(p) for i, p in want.items()})
    assert {(p, i, n) for p, i, n, *_ in got} >= {(0, 1, 4), (2, 7, 1)}
    assert not any(p == 1 and i < 7 for p, i, *_ in got)  # 25% is not 20%
    r = random.Random(9)
    for _ in range(40):  # against every window, with no bound before the ratio
        tok = [r.choice(["shop", "now", "shopnow", "snow", "two", "hundred", "200", "hop", "%"]) for _ in range(r.randint(1, 12))]
        some = {0: phrases.phrase_variants("shop now"), 1: phrases.phrase_variants("two hundred %")}
        plain = {(p, i, n) for p, vs in some.items() for v in vs for n in {max(1, len(v.split()) - 1), len(v.split()), len(v.split()) + 1} for i in range(len(tok) - n + 1) if not phrases.digits_missing(v, phrases.normalize_text(" ".join(tok[i : i + n]))) and fuzzy.robust_ratio(v, phrases.normalize_text(" ".join(tok[i : i + n]))) >= 88}
        assert {x[:3] for x in phrases.find_phrases(tok, some)} == plain


def test_containment_loses_nothing(spark):
    r = random.Random(6)
    word = lambda: r.choice(["a", "ab", "b,", "abc", "c.", "ba", ""])
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 9)))) for i in range(60)]
    items = [(i, " ".join(word() for _ in range(r.randint(1, 6)))[r.randint(0, 1) :]) for i in range(60)]
    got = matching.contained(spark.createDataFrame(items, "i long, item string"), "item", spark.createDataFrame(docs, "d long, text string"), "text", "d").select("i", "d").collect()
    assert sorted(map(tuple, got)) == sorted((i, d) for i, x in items if x for d, t in docs if x in t)


@pytest.mark.parametrize(("score", "least"), [("ratio", 85), ("ratio", 70), ("token_set", 82)])
def test_blocking_loses_nothing(spark, score, least):
    r = random.Random(7)
    some = [" ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 3))) for _ in range(70)]
    some += [s[:k] + r.choice("abcd ") + s[k + r.randint(0, 1) :] for s in some for k in [r.randrange(len(s))]]
    some = sorted({s.strip() for s in some if s.strip()})
    df = spark.createDataFrame([(s,) for s in some], "t string")
    f = fuzzy.ratio if score == "ratio" else fuzzy.token_set_ratio
    got = {(x.a, x.b) for x in matching.alike(df, "t", df, "t", least, score).collect()}
    assert got == {(a, b) for a in some for b in some if f(a, b) >= least}


def test_holding_loses_nothing(spark):
    r = random.Random(11)
    hays = ["".join(r.choice("abc 1") for _ in range(r.randint(1, 25))).strip() for _ in range(60)]
    needles = ["".join(r.choice("abc 12") for _ in range(r.randint(1, 8))).strip() for _ in range(60)]
    got = {(x.needle, x.hay) for x in matching.holding(spark.createDataFrame([(n,) for n in needles], "n string"), "n", spark.createDataFrame([(h,) for h in hays], "h string"), "h", 85).collect()}
    assert got == {(n, h) for n in needles for h in hays if n and h and fuzzy.contains_ratio(n, h) >= 85 and not phrases.digits_missing(n, h)}


def test_reports_in_archives(spark):
    import io
    import json
    import zipfile

    from tidemark import sources

    rows = [("j1", "a.html", "x"), ("j1", "a.html", "y"), ("j1", "b", "é"), ("j2", "a.html", "z")]
    df = spark.createDataFrame(rows, "job string, name string, content string").repartition(3)
    got = {r.job: bytes(r.archive) for r in sources.zipped(df, ["job"]).collect()}
    with zipfile.ZipFile(io.BytesIO(got["j1"])) as z:
        assert {n: z.read(n).decode() for n in z.namelist() if n != "summary.json"} == {"a.html": "x", "a_1.html": "y", "b": "é"}
        assert json.loads(z.read("summary.json")) == [{"name": "a.html", "bytes": 1}, {"name": "a_1.html", "bytes": 1}, {"name": "b", "bytes": 2}]
    assert {r.job: bytes(r.archive) for r in sources.zipped(df.coalesce(1), ["job"]).collect()} == got


def test_models_and_ordered_work(spark):
    from tidemark import sources

    df = spark.range(8).withColumn("text", F.concat(F.lit("Show it "), F.col("id").cast("string"))).repartition(3)
    got = sources.with_model(df, "length", lambda: len, ["text"], lambda model, rows: [{"n": model(r["text"])} for r in rows], "n long").collect()
    assert sorted((r.id, r.n) for r in got) == [(i, 9) for i in range(8)]

    def work(row):
        if row["id"] == 3:
            raise ValueError("bad item")
        return f"r{row['id']}"

    done = sources.ordered_map(df, "id", work, workers=2).orderBy("id").collect()
    assert [(r.result, r.error) for r in done] == [(f"r{i}", None) if i != 3 else (None, "ValueError: bad item") for i in range(8)]
    rules = sources.rules_backend(spark.createDataFrame([(1, "Never claim it cures eczema"), (2, "Show the jar"), (3, "")], "i int, t string"), F.col("t")).orderBy("i").collect()
    assert [(r.mode, r.polarity, r.kind, r.priority) for r in rules] == [("any", "forbidden", "policy", "critical"), ("visual_only", "required", "visual", "high"), ("any", "required", "other", "medium")]


@pytest.mark.parametrize(
    ("text", "mode", "kind", "polarity", "priority"),
    [
        ("Show 20% OFF.", "speech_or_text", "speech_or_text", "required", "medium"),
        ("Say 20% OFF.", "speech_only", "speech", "required", "medium"),
        ("Show the product in the first 5 seconds.", "visual_only", "visual", "required", "high"),
        ("Keep it no longer than 30 seconds", None, "timing", "required", "medium"),
        ("Speak to the camera", None, "other", "required", "medium"),
        ("Speak to teens", None, "audience", "required", "medium"),
        ("You must not mention competitors", "speech_only", "policy", "forbidden", "critical"),
        ("Captions should mention the price", "speech_or_text", "speech_or_text", "required", "medium"),
        ("Ideally show how to use it", "visual_only", "demonstration", "required", "low"),
    ],
)
def test_ladders(spark, text, mode, kind, polarity, priority):
    t = F.col("t")
    df = spark.createDataFrame([(text,)], "t string").select("t", cues.evidence_mode(t).alias("m"), cues.polarity(t).alias("p"))
    r = df.select("m", "p", cues.requirement_type(t, F.col("m")).alias("k"), "t").withColumn("i", cues.priority(t, F.col("k"), F.col("p"))).first()
    assert (r.m, r.k, r.p, r.i) == (mode, kind, polarity, priority)


@pytest.mark.parametrize(
    ("line", "head"),
    [
        ("KEY MESSAGES", True), ("What to include:", True), ("Sample Hook Concepts", True), ("Show the product to them", False), ("Use the hook 'breakfast' as it stands", False),
        ("- a bullet", False), ('"a quoted line"', False), ("It works.", False), ("some ideas", True), ("a plain small line", False), ("", False), ("x" * 91, False), ("1) Numbered", False),
    ],
)
def test_headings(spark, line, head):
    assert spark.createDataFrame([(line,)], "t string").select(structure.plain_heading(F.col("t"))).first()[0] == head


def test_kinds_of_sections_and_examples(spark):
    kinds = [("Prohibited Claims", "x", "requirements"), ("Campaign Objectives", "x", "context"), ("Call to Actions", "x", "alternatives"), ("Why it works", "x", "claims"), ("Mood", "", "alternatives"), ("Zebra", "", "context"), ("Zebra", "x", "requirements")]
    df = spark.createDataFrame(kinds, "h string, b string, k string")
    assert all(r.k == r.got for r in df.withColumn("got", structure.section_kind(F.col("h"), F.col("b"))).collect())
    lines = [("This creator begins her video with a hook", True, False), ("The creator must show the logo", False, False), ("In this concept, the creator shares a tip", True, False), ("Show what this creator begins with", False, False), ('"If it feels smaller, don\'t scroll"', False, True), ("'short'", False, False)]
    got = spark.createDataFrame(lines, "t string, d boolean, q boolean").select("d", "q", structure.descriptive(F.col("t")).alias("x"), structure.quoted_example(F.col("t")).alias("y")).collect()
    assert all((r.d, r.q) == (r.x, r.y) for r in got)


def test_sections_of_a_document(spark):
    text = ["Title Of It", "intro line here, long enough to stay.", "", "___", "## Options", "1. Show it", "https://a.b/c", "Example: https://d.e", "RULES:", "do not say that it cures."]
    got = structure.sections(spark.createDataFrame(list(enumerate(text)), "pos int, line string").withColumn("doc", F.lit(1)), "doc", "pos", "line").orderBy("section").collect()
    assert [(r.section, r.heading, r.kind, r.lines, r.n_refs) for r in got] == [
        (1, "Title Of It", "requirements", ["intro line here, long enough to stay."], 0),
        (2, "Options", "alternatives", ["1. Show it"], 2),
        (3, "RULES", "requirements", ["do not say that it cures."], 0),
    ]


@pytest.mark.parametrize(("score", "least"), [("ratio", 99.75), ("ratio", 100), ("ratio", 98.5), ("token_set", 99)])
def test_long_texts_meet(spark, score, least):
    r = random.Random(9)
    some = ["".join(r.choices("abcdefgh ", k=n)).strip() for n in (300, 405, 500, 900)]
    some += [some[1], some[2][:-1], some[3][:200] + "x" + some[3][200:], "ab", "abc"]
    df = spark.createDataFrame([(s,) for s in some] + [(None,), ("",)], "t string")
    f = fuzzy.ratio if score == "ratio" else fuzzy.token_set_ratio
    got = {(x.a, x.b) for x in matching.alike(df, "t", df, "t", least, score).collect()}
    assert got == {(a, b) for a in set(some) for b in set(some) if f(a, b) >= least}


def test_too_many_edits_are_an_error(spark):
    df = spark.createDataFrame([("ab " * 300,)], "t string")
    with pytest.raises(Exception, match="too long for alike"):
        matching.alike(df, "t", df, "t", 80).collect()


def test_few_pairs_meet(spark):
    """Of texts that have nothing to do with each other under one in fifty is compared."""
    r = random.Random(10)
    some = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(20, 30))) for _ in range(300)]
    x = spark.createDataFrame([(s,) for s in some], "a string")
    for least in (85, 88, 95):
        assert matching.meeting(x, x.withColumnRenamed("a", "b"), least, "ratio").count() < 300 * 300 / 50 + 300 * 16


def test_token_jaccard_loses_nothing(spark):
    r = random.Random(12)
    some = [" ".join(r.choices(["alpha", "beta", "gamma", "delta", "epsilon", "20", "the", "zeta"], k=r.randint(0, 7))) for _ in range(80)]
    df = spark.createDataFrame([(s,) for s in some] + [(None,)], "t string")
    tokens = {s: set(phrases.content_tokens(s)) for s in some}
    for least in (0.5, 0.8, 1.0):
        got = {(x.a, x.b): x.jaccard for x in matching.token_jaccard(df, "t", df, "t", least).collect()}
        want = {(a, b): len(x & y) / len(x | y) for a, x in tokens.items() for b, y in tokens.items() if x and y and len(x & y) / len(x | y) >= least}
        assert got == want


def plain_first_kept(ids, links):
    """The loop: a row goes if it is linked with an earlier one that stayed."""
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(max(a, b), set()).add(min(a, b))
    out = {}
    for i in sorted(ids):
        out[i] = min((j for j in near.get(i, ()) if out.get(j) == j), default=i)
    return out


@pytest.mark.parametrize(("n", "links"), [(700, None), (50, 60), (200, 400), (200, 2500), (5, 0)])
def test_first_kept_is_the_loop(spark, n, links):
    r = random.Random(n)
    pairs = [(i + 1, i) for i in range(n - 1)] if links is None else [(r.randrange(n), r.randrange(n)) for _ in range(links)]
    pairs += [(3, 3), (3, n + 7)]
    got = selection.first_kept(spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {x.id: x.kept_by for x in got} == plain_first_kept(range(n), [p for p in pairs if max(p) < n])


def plain_merge(rows: list[dict]) -> dict[int, dict]:
    """Requirements one by one against those kept so far."""
    kept: list[dict] = []
    for r in sorted(rows, key=lambda r: r["id"]):
        def like(k, r=r):
            if k["choice"] or r["choice"] or (k["brief"], k["kind"]) != (r["brief"], r["kind"]):
                return False
            x, y = set(phrases.content_tokens(k["text"])), set(phrases.content_tokens(r["text"]))
            return fuzzy.ratio(k["text"].lower(), r["text"].lower()) >= 88 or bool(x and y) and len(x & y) / len(x | y) >= 0.8

        into = next((k for k in kept if like(k)), None)
        if into is None:
            kept.append(r | {"merged": []})
            continue
        if selection.PRIORITY_RANK[r["priority"]] > selection.PRIORITY_RANK[into["priority"]]:
            into["priority"] = r["priority"]
        if selection.MODE_RANK[r["mode"]] > selection.MODE_RANK[into["mode"]]:
            into["mode"] = r["mode"]
        if r["deadline"] is not None:
            into["deadline"] = min(r["deadline"], into["deadline"] if into["deadline"] is not None else r["deadline"])
        into["window"] = into["window"] or r["window"]
        into["hints"] = list(dict.fromkeys(into["hints"] + r["hints"]))
        into["merged"].append(r["id"])
    sizes = Counter((k["brief"], k["choice"]) for k in kept if k["choice"])
    at = Counter()
    for k in kept:
        at[k["brief"]] += 1
        k["ordinal"], k["alone"] = at[k["brief"]], sizes[k["brief"], k["choice"]] == 1
        k["choice"] = None if k["alone"] else k["choice"]
    return {k["id"]: k for k in kept}


def test_requirements_merge_as_in_a_loop(spark):
    r = random.Random(14)
    texts = ["show the jar", "show the jars", "Show the jar close up", "show a jar close up now", "say the price", "say the price now", "say the prices now", "never claim a cure", "", "the of"]
    rows = [
        {"brief": r.randint(1, 3), "id": i, "kind": r.choice(["visual", "visual", "speech"]), "text": r.choice(texts) + r.choice(["", "", " please", " 20"]), "choice": r.choice([None] * 5 + ["c1", "c2", f"solo{i}"]),
         "priority": r.choice(list(selection.PRIORITY_RANK)), "mode": r.choice(list(selection.MODE_RANK)), "deadline": r.choice([None, 3, 9]), "window": r.choice([None, f"w{i}"]), "hints": r.sample(["a", "b", "c", "d"], 2), "criteria": ["k"], "classes": []}
        for i in range(90)
    ]
    schema = "brief long, id long, kind string, text string, choice string, priority string, mode string, deadline long, window string, hints array<string>, criteria array<string>, classes array<string>"
    got = {x.id: x.asDict() for x in selection.merge_requirements(spark.createDataFrame(rows, schema)).collect()}
    want = plain_merge([dict(x) for x in rows])
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert {k: got[i][k] for k in ("brief", "priority", "mode", "deadline", "window", "hints", "merged", "ordinal", "alone", "choice")} == {k: w[k] for k in ("brief", "priority", "mode", "deadline", "window", "hints", "merged", "ordinal", "alone", "choice")}
    assert any(w["merged"] for w in want.values())


def test_semantic_rank_against_all_pairs(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(rk, "BLOCK", 5)
    g = np.random.default_rng(3)
    vector = lambda: [float(x) for x in g.integers(-2, 3, 3)]
    cands = [(key, 100 * key + i, i % 7, vector()) for key, n in ((1, 30), (2, 4), (3, 11)) for i in range(n)] + [(1, 190, 0, None), (None, 191, 0, vector())]
    reqs = [(key, 10 * key + i, vector()) for key in (1, 2, 3, 4) for i in range(7)]
    hints = [(11, 103, 80), (11, 104, 90), (12, 105, 0), (31, 203, 70)]
    got = {}
    for r in rk.semantic_rank(spark.createDataFrame(reqs, "key long, req long, v array<double>"), spark.createDataFrame(cands, "key long, cand long, at long, v array<double>"), spark.createDataFrame(hints, "req long, cand long, score long"), 4).collect():
        got.setdefault(r.req, []).append((r.rank, r.cand, r.score, r.by))
    want = {}
    unit = lambda v: np.array(v) / max(1e-12, np.linalg.norm(v))
    for key, req, v in reqs:
        own = [c for c in cands if c[0] == key and c[3] is not None]
        hit = {c: s for q, c, s in hints if q == req and s > 0 and any(c == o[1] for o in own)}
        by = "hint" if hit else "all" if len(own) <= 4 else "meaning"
        rows = [(-float(hit[c[1]] if hit else 0 if by == "all" else round(float(unit(v) @ unit(c[3])), 6)), c[2], c[1]) for c in own if not hit or c[1] in hit]
        if rows:
            want[req] = [(i, c, -s + 0.0, by) for i, (s, _, c) in enumerate(sorted(rows)[:4], 1)]
    assert {q: sorted(r) for q, r in got.items()} == want


def test_stored_results_are_checked_again(spark, tmp_path):
    import glob
    import os
    from concurrent.futures import ThreadPoolExecutor

    from tidemark.sources import Store

    s, made = Store(spark, str(tmp_path)), []

    def make():
        made.append(1)
        return spark.range(10).withColumn("twice", F.col("id") * 2)

    def check(df):
        return df.count() == 10 and df.filter("twice <> id * 2").isEmpty()

    run = lambda c=check: s.run("double", "1", ["a"], {"n": 1}, make, c)
    assert [run()[2], run()[2], len(made)] == [False, True, 1]
    path = s.path("double", run()[1])
    part = max(glob.glob(f"{path}/part-*"), key=os.path.getsize)
    with open(part, "r+b") as f:  # cut off
        f.truncate(os.path.getsize(part) // 2)
    assert run()[2] is False and len(made) == 2 and run()[2] is True
    spark.range(10).withColumn("twice", F.col("id") * 3).write.mode("overwrite").parquet(path)  # of an older stage
    spark.catalog.refreshByPath(path)
    df, _, hit = run()
    assert (hit, len(made), df.agg(F.sum("twice")).first()[0]) == (False, 3, 90)
    with pytest.raises(ValueError, match="fails its own check"):
        s.run("double", "2", ["a"], {}, make, lambda df: False)
    assert not os.path.exists(s.path("double", "x")) and not glob.glob(f"{tmp_path}/_made/*")
    with ThreadPoolExecutor(4) as pool:
        results = list(pool.map(lambda _: s.run("many", "1", ["a"], {}, make, check)[0].count(), range(4)))
    assert results == [10] * 4 and len(os.listdir(f"{tmp_path}/stage=many")) == 1 and not glob.glob(f"{tmp_path}/_made/*")
