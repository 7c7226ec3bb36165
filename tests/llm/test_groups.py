"""Prefix trie, toxicity and divergence against brute force, with nulls, ties, repeats, skew, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, difference
from tidemark.llm import divergence, prefix_trie, queries, toxicity
from tidemark.llm.common import fold

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_divergence"])
def test_sql(spark, name):
    assert difference(spark, connect(DATA), queries.QUERIES[name], queries.ORACLE[name], DATA) == ""


# --- op 11

CHAT = "conv_id long, turn long, role string, text string, depth long, k1 long, h1 long, part long, ord long"


def chat(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], CHAT)


def trie_by_hand(sequences: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    """The nodes, by listing every prefix."""
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[c] for c in children[p])
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(sequences[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def in_order(rows) -> dict[int, list[tuple[str, str]]]:
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            md5 = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by[c].append(((t is not None, t or 0), *np.frombuffer(md5[::-1], "<i8")[::-1].tolist(), len(text.encode()), role, text))
    return {c: [x[-2:] for x in sorted(v)] for c, v in by.items()}


def built(spark, rows):
    turns = prefix_trie.placed(spark, prefix_trie.turns_of(chat(spark, rows)), ["turn", "h1", "h2", "n_bytes"])
    return prefix_trie.build(spark, turns, turns.filter("depth = 1").select("conv_id"))


def random_chats(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for c in range(-3, n):
        for t in range(r.choice([1, 2, 3, 9, 12])):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None]), r.choice(["a", "é", "", None])))
    return rows


@pytest.mark.parametrize("first", [1, 2, 8])
def test_trie(spark, monkeypatch, first):
    monkeypatch.setattr(prefix_trie, "FIRST", first)
    rows = random_chats(first, 60)
    rows += [(1000 + c, t, "user", "same") for c in range(20) for t in range(25)]  # copies
    rows += [(2000 + c, t, "user", "same") for c in range(3) for t in range(10 + c)]  # prefixes of each other
    rows += [(3000, t, "u", str(t)) for t in range(3000)] + [(None, 1, "u", "x"), (5, 1, "user", "a"), (5, 1, "user", "a")]  # one that lies in many tasks, no id, repeats
    got = {tuple(r)[:8] for r in built(spark, rows).collect()}
    assert got == trie_by_hand(in_order(rows))


def test_trie_texts_and_no_rows(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "v", "b"), (2, 0, "u", "a"), (2, 1, "v", None)]
    nodes = prefix_trie.texts(built(spark, rows), chat(spark, rows))
    assert {(r.conv_id, r.depth, r.role, r.text) for r in nodes.collect()} == {(1, 0, None, None), (1, 1, "u", "a"), (1, 2, "v", "b"), (2, 2, "v", "")}
    assert built(spark, []).count() == 0


def test_rebuilt(spark, tmp_path):
    rows = [(c, t, "u", f"{c % 3}-{t}") for c in range(40) if c != 10 for t in range(1 + c % 9)] + [(15, None, None, None), (-7, 0, "u", "x")]
    chat(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    own = in_order(rows)
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    again = {c: own.get(c - int(np.fmod(c, 5)), [])[: h(c)] + own[c][h(c) :] for c in own}
    assert any(not s for s in again.values())
    assert {tuple(r) for r in queries.QUERIES["op11_prefix_trie"](spark, str(tmp_path)).collect()} == trie_by_hand(again)


# --- op 12

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, toxic int, score double, features string"


def posts(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    rows = []
    for i in range(n):
        text, bad = [word() for _ in range(r.randint(5, 80))], i % 5 == 3
        for _ in range(3 * bad):
            text.insert(r.randrange(len(text)), r.choice(["zounds", "knave", "wretch"]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 0, 1, 0, 0.0, "f") for i, t in rows], DOCS)


def test_values_are_rates_of_ngrams(monkeypatch):
    monkeypatch.setattr(toxicity, "STRETCH", 50)
    for text in ["Ab  c\n", "", None, "x", "😀 İstanbul " * 30, "long words and more of them " * 9]:
        flat = " " + " ".join((text or "").split()).lower() + " "
        grams = Counter()
        for n in toxicity.GRAMS:
            for at in range(len(flat) - n + 1):
                h = np.uint64(ord(flat[at]))
                with np.errstate(over="ignore"):
                    for c in flat[at + 1 : at + n]:
                        h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(ord(c))
                    grams[int(toxicity.mix(np.array([h + np.uint64(n)]))[0] >> np.uint64(64 - toxicity.BITS))] += 1
        per = sum(grams.values()) + 3 * toxicity.PAD
        want = {g: min(3 * 1024, k * 1024 * 3000 // per) for g, k in grams.items()}
        assert dict(zip(*(x.tolist() for x in toxicity.values(text)), strict=True)) == want


def test_ratios_and_weights(spark):
    rows = posts(1, 60)
    known = frame(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 0), (7, None, 0), (999, 1, 0)], "doc_id long, toxic int, quality int")
    got, texts = toxicity.ratios(spark, toxicity.labelled(known, labels, F.lit(True)).repartition(5))
    total = np.full((2, 1 << toxicity.BITS), toxicity.UNIT)
    for _, t, y in rows:
        f, v = toxicity.values(t)
        total[y][f] += v
    share = np.log(total / total.sum(axis=1, keepdims=True))
    assert texts.tolist() == [48, 12] and np.allclose(got, share[1] - share[0])
    # the fit is where the gradient vanishes
    features, v = zip(*(toxicity.values(t) for _, t, _ in rows), strict=True)
    y = np.array([r[2] for r in rows])
    scaled = [x / toxicity.UNIT * got[f] for f, x in zip(features, v, strict=True)]
    w, b = toxicity.weigh(list(features), scaled, y, np.ones(60), 1 << toxicity.BITS)
    off = np.array([1 / (1 + np.exp(-(w[f] @ x + b))) for f, x in zip(features, scaled, strict=True)]) - y
    grad = toxicity.PENALTY * w
    for f, x, e in zip(features, scaled, off, strict=True):
        grad[f] += e * x / 60
    assert abs(off.sum() / 60) < 1e-3 and np.abs(grad).max() < 1e-3


def test_toxicity_held_out(spark):
    rows = posts(2, 400)
    known = frame(spark, [r[:2] for r in rows] + [(None, None), (401, ""), (402, None), (3, rows[3][1])])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(spark, known, labels, fold("doc_id", 5) != 0)
    got = [(r.doc_id, r.score) for r in toxicity.score(known, model).collect()]
    assert len(got) == 404 and all(0 <= s <= 1 for _, s in got) and len({s for i, s in got if i in (None, 401, 402)}) == 1
    held = [(s, rows[i][2]) for i, s in got if i is not None and i < 400 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and sum((s >= 0.5) == y for s, y in held) >= 0.95 * len(held)


def test_toxicity_without_two_classes(spark):
    docs, none = frame(spark, [(1, "a"), (2, "b")]), spark.createDataFrame([], "doc_id long, toxic int")
    for labels, want in ((none, 0.0), (spark.createDataFrame([(1, 1)], none.schema), 1.0), (spark.createDataFrame([(1, 0)], none.schema), 0.0)):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(spark, docs, labels, F.lit(True))).collect()} == {want}
    assert toxicity.score(frame(spark, []), toxicity.fit(spark, frame(spark, []), none, F.lit(True))).count() == 0


# --- op 13


def audit_by_hand(rows, min_docs: int) -> set[tuple]:
    n, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        n[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang in docs:
        kept = [t for t, d in docs[lang].items() if d >= min_docs]
        groups = {s: c for (x, s), c in n.items() if x == lang}
        whole = sum(groups.values(), Counter())
        p = lambda c: {t: 1 + 1000000000 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        ps, q = {s: p(c) for s, c in groups.items()}, p(whole)
        for s, c in groups.items():
            pairs = sorted((-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            words = sorted((-f(ps[s][t], q[t]), t.encode(), t) for t in kept if c[t] and ps[s][t] > q[t])[:10]
            for part, found in (("pair", pairs), ("term", words)):
                out |= {(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("tile,piece,held,counts", [(1 << 16, 1 << 20, 1 << 22, 400_000), (7, 5, 2, 3)])
def test_divergence(spark, monkeypatch, tile, piece, held, counts):
    for name, value in (("TILE", tile), ("PIECE", piece), ("HELD", held), ("COUNTS", counts)):
        monkeypatch.setattr(divergence, name, value)
    r = random.Random(5)
    words = ["a", "B", "Ä", "ß", "naïve", "x1y", "😀", "o'clock", "the", "The", "zz"] + [f"w{c}" for c in "abcdefghijkl"]
    rows = [(" ".join(r.choices(words, k=r.randint(0, 30))), r.choice(["en", "en", "en", "de", None]), r.choice(["s", "s", "s", "t", "u", None, ""])) for _ in range(150)]
    rows += [(None, "xx", "s"), ("123 --", "xx", "t"), ("", "yy", None), rows[0], rows[0]]
    docs = spark.createDataFrame([(1, *x, 2, 3, 4) for x in rows], "doc_id long, text string, lang string, source string, term long, n long, tile long").repartition(4)
    got = [tuple(x) for x in divergence.audit(spark, docs).collect()]
    assert len(got) == len(set(got)) and set(got) == audit_by_hand(rows, 10)
    assert divergence.audit(spark, docs.limit(0)).count() == 0


def test_shares_do_not_overflow():
    n, of = 3 * 10**15, 7 * 10**15
    assert divergence.shares(np.array([[n]]), np.array([[of]])).item() == 1 + 10**9 * n // of
