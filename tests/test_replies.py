"""Rows that fail once, twice and never; no row is asked more than twice."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from tidemark.operators import replies

ROWS = "key long, id long, offered array<string>, script string"
REPLY = "key long, id long, status string, alignment string, cited array<string>, reason string, seq long"


def backend(folder: str):
    """A model whose answers each row's script tells, and which leaves a file for each row that it is asked about."""

    def answer(batches):
        import uuid

        import pyarrow as pa

        for b in batches:
            out = []
            for r in b.to_pylist():
                with open(f"{folder}/{r['id']}-{r['round']}-{uuid.uuid4().hex}", "w") as f:
                    f.write(str(r["wrong"]))
                said = r["script"].split("|")[min(r["round"], len(r["script"].split("|"))) - 1]
                base = {"key": r["key"], "id": r["id"], "status": "pass", "alignment": "Strong", "cited": ["e1"], "reason": "x" * 500, "seq": 0}
                if said == "cites":
                    out.append(base | {"cited": ["e1", "e9"]})
                elif said == "status":
                    out.append(base | {"status": "maybe"})
                elif said == "twice":
                    out += [base, base | {"status": "FAIL", "seq": 1, "alignment": "8/10"}]
                elif said == "strange":
                    out += [base | {"id": 999}]
                elif said == "good":
                    out.append(base)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.int64()), ("id", pa.int64()), ("status", pa.string()), ("alignment", pa.string()), ("cited", pa.list_(pa.string())), ("reason", pa.string()), ("seq", pa.int64())]))

    return lambda asked: asked.mapInArrow(answer, REPLY)


def test_two_rounds(spark, tmp_path):
    scripts = ["good", "cites|good", "status|none", "none|twice", "none|cites", "strange|good", "twice"]
    rows = spark.createDataFrame([(1, i, ["e1", "e2"], s) for i, s in enumerate(scripts)] + [(2, 50, None, "good")], ROWS)
    got = {r.id: r for r in replies.ask_twice(spark, rows, backend(str(tmp_path))).collect()}
    assert {i: (r.status, r.rounds, r.health, list(r.flags)) for i, r in got.items()} == {
        0: ("PASS", 1, "ok", []), 1: ("PASS", 2, "repaired", ["FIRST:cited:e9"]), 2: ("UNCERTAIN", 2, "degraded", ["FIRST:status:MAYBE", "SECOND:missing"]), 3: ("FAIL", 2, "repaired", ["FIRST:missing"]),
        4: ("UNCERTAIN", 2, "degraded", ["FIRST:missing", "SECOND:cited:e9"]), 5: ("PASS", 2, "repaired", ["FIRST:missing"]), 6: ("FAIL", 1, "ok", []), 50: ("UNCERTAIN", 2, "degraded", ["FIRST:cited:e1", "SECOND:cited:e1"]),
    }
    assert (got[0].alignment, got[6].alignment, got[2].alignment, len(got[0].reason)) == ("strong", None, None, 400)
    asked = sorted(tuple(map(int, f.rsplit("/", 1)[1].split("-")[:2])) for f in glob.glob(f"{tmp_path}/*"))
    assert asked == sorted([(i, 1) for i in got] + [(i, 2) for i in got if i not in (0, 6)])
    why = {f.rsplit("/", 1)[1].split("-")[0]: open(f).read() for f in glob.glob(f"{tmp_path}/*-2-*")}
    assert (why["1"], why["3"]) == ("cited:e9", "missing")


def test_batches_health_and_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([(k, 100 * k + i, ["e1"], "good" if i or k == 1 else "none") for k in (1, 2) for i in range(30)] + [(3, 301, ["e1"], "none")], ROWS)
    seen = []

    def ask(asked):
        seen.append({(r.key, r.batch): r.n for r in asked.groupBy("key", "batch").agg(F.count("*").alias("n")).collect()})
        return backend(str(tmp_path))(asked)

    out = replies.ask_twice(spark, rows, ask)
    assert {r.key: (r.n, r.repaired, r.degraded, r.verdict) for r in replies.batch_health(out).collect()} == {1: (30, 0, 0, "ok"), 2: (30, 0, 1, "degraded"), 3: (1, 0, 1, "failed")}
    assert seen[0] == {(1, 0): 12, (1, 1): 12, (1, 2): 6, (2, 0): 12, (2, 1): 12, (2, 2): 6, (3, 0): 1} and seen[1] == {(2, 0): 1, (3, 0): 1}
    assert replies.ask_twice(spark, rows.limit(0), backend(str(tmp_path))).count() == 0


def test_query_is_a_loop(spark):
    import zlib

    import duckdb

    from tidemark import plans

    d = "/root/testdata/sf0.001"
    want = set()
    for (i,) in duckdb.sql(f"SELECT p_partkey FROM read_parquet('{d}/part.parquet')").fetchall():
        flags = []
        for rounds in (1, 2):
            n = zlib.crc32(f"{i}:{rounds}".encode()) % 10
            wrong = {0: "missing", 1: "status:PERHAPS", 2: "cited:e0x"}.get(n)
            if wrong is None:
                break
            flags.append(f"{['FIRST', 'SECOND'][rounds - 1]}:{wrong}")
        health = "degraded" if wrong else "ok" if rounds == 1 else "repaired"
        want.add((i // 50, i, "UNCERTAIN" if wrong else "PASS" if i % 3 == 0 else "FAIL", None if wrong or n <= 5 else "strong", "" if wrong else f"e{i}", rounds, health, "|".join(flags)))
    assert {tuple(r) for r in plans.QUERIES["r11_two_rounds"](spark, d).collect()} == want
    assert {w[6] for w in want} == {"ok", "repaired", "degraded"}
