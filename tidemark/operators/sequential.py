"""Operators whose state depends on what was kept before: one sorted pass over each key's rows.

W2, W3, W9, R33 and box grouping stream: a task sorts its keys' rows (and spills if need be), and Python holds
what the operator carries on, not the key. K7 and J13 look at a key's rows more than once and take them whole:
the frames of one video, the lines of one brief.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions import fuzzy, phrases
from tidemark.functions import lexicon as lx
from tidemark.tables import spread


def per_key(df: DataFrame, keys: list[str], run: Callable[[list[dict]], Iterable[dict]], schema: T.StructType | str) -> DataFrame:
    """run(rows of one key) for each key; rows come as dicts, in no order."""
    names = T.StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(run(pdf.to_dict("records"))), columns=names)

    return df.groupBy(*keys).applyInPandas(go, schema)


def streamed(df: DataFrame, keys: list[str], order: list[str | Column], run: Callable[[Iterator[dict]], Iterable[dict]], schema: str, rows: int = 1000) -> DataFrame:
    """The keys with what run(rows of one key, in order) gives for each; `schema` is of the keys and run's columns."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        every = (r for batch in batches for r in batch.to_pylist())
        for key, own in groupby(every, key=lambda r: tuple(r[k] for k in keys)):
            head = dict(zip(keys, key, strict=True))
            for made in run(own):
                out.append(head | made)
                if len(out) >= rows:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return spread(df, *keys).sortWithinPartitions(*keys, *order).mapInArrow(go, schema)


# what comes again, of texts and of pairs of words, is kept within bounds
_facts = lru_cache(maxsize=4096)(lambda text: tuple(phrases.content_tokens(text)))
_same_word = lru_cache(maxsize=65_536)(fuzzy.same_word)


def no_new_fact(said: set[str], text: str, least: float = 80) -> bool:
    """Whether every content word of the text is among those that were said, goes on, or is another form of one."""
    return all(t in said or t in lx.GOES_ON or any(_same_word(t, s, least) for s in said) for t in _facts(text))


def merge_events(rows: Iterable[dict], gap: float) -> Iterator[dict]:
    """Adjacent events of one kind merge if the next one brings no new fact to the open run.

    rows, by start and id: start, end, kind, text, id. Result: id (of the first), start, end, kind, text (the longest), n of each run.
    """
    last: dict | None = None
    said: set[str] = set()
    for r in rows:
        if last and last["kind"] == r["kind"] and r["start"] - last["end"] <= gap and no_new_fact(said, r["text"]):
            last["end"] = max(last["end"], r["end"])
            last["text"] = max(last["text"], r["text"], key=len)
            last["n"] += 1
        else:
            if last:
                yield last
            last = {k: r[k] for k in ("id", "start", "end", "kind", "text")} | {"n": 1}
            said = set()
        said.update(_facts(r["text"]))
    if last:
        yield last


Box = tuple[float, float, float, float]


def _inside(a: Box, b: Box) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def _area(a: Box) -> float:
    return max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1])


def iou(a: Box, b: Box) -> float:
    """Area of the intersection over that of the union; 0 for boxes without area."""
    both = _inside(a, b)
    return both / (_area(a) + _area(b) - both) if both else 0.0


def one_caption(a: str, box_a: Box, b: str, box_b: Box, least: int = 85, overlap: float = 0.5, held: float = 0.7) -> bool:
    """Whether two sightings of normalised texts are one caption (W3, W14): alike in the same place, or one growing into the other.

    Different numbers are different captions. A caption grows if its text, white space aside, starts the longer
    one and its box lies in the longer one's by `held` of its area.
    """
    x, y = phrases.digits(a), phrases.digits(b)
    if x and y and x != y:
        return False
    if fuzzy.robust_ratio(a, b) >= least and iou(box_a, box_b) >= overlap:
        return True
    (short, box, s), (long, around, t) = sorted([(a, box_a, "".join(a.split())), (b, box_b, "".join(b.split()))], key=lambda z: len(z[2]))
    return 0 < len(s) < len(t) and t.startswith(s) and _inside(box, around) >= held * max(1e-6, _area(box))


def text_intervals(rows: Iterable[dict], max_gap: float, alike: Callable[[dict, dict], bool], least_seen: int = 2, sure: float = 0.85) -> Iterator[dict]:
    """Detections join the first open interval with a like text and a small gap, else open one.

    rows, by t and text: t, text, confidence and what else `alike` looks at. An interval survives with two
    sightings or one of high confidence; the longest text of its sightings is its text, the most confident of
    equals. Intervals come as they close.
    """
    open_: list[dict] = []
    for r in rows:
        yield from survivors(past(open_, r["t"], max_gap), least_seen, sure)
        sighted(open_, r, alike)
    yield from survivors(open_, least_seen, sure)


def survivors(found: Iterable[dict], least_seen: int = 2, sure: float = 0.85) -> Iterator[dict]:
    return (o for o in found if o["n"] >= least_seen or o["best"] >= sure)


def past(open_: list[dict], t: float, max_gap: float) -> list[dict]:
    """Takes the intervals that nothing from t on can extend out of open_."""
    closed = [o for o in open_ if t - o["end"] > max_gap]
    open_[:] = [o for o in open_ if t - o["end"] <= max_gap]
    return closed


def sighted(open_: list[dict], r: dict, alike: Callable[[dict, dict], bool]) -> None:
    """Adds a detection to the first open interval that it is like, or opens one."""
    own = {k: v for k, v in r.items() if k not in ("t", "confidence")}
    for o in open_:
        if alike(r, o):
            o["end"], o["n"] = r["t"], o["n"] + 1
            if (len(r["text"]), r["confidence"]) > (len(o["text"]), o["best"]):
                o |= own
            o["best"] = max(o["best"], r["confidence"])
            return
    open_.append(own | {"start": r["t"], "end": r["t"], "n": 1, "best": r["confidence"]})


def read_frames(rows: Iterable[dict], same: Callable[[list, list], bool], most: int = 3) -> Iterator[dict]:
    """Frames that are read: one like the last read frame is skipped, but at most `most` in a row.

    rows, by idx: idx, frame.
    """
    last, skipped = None, 0
    for r in rows:
        if last is not None and same(last, r["frame"]) and skipped < most:
            skipped += 1
            yield {"idx": r["idx"], "read": False}
        else:
            last, skipped = r["frame"], 0
            yield {"idx": r["idx"], "read": True}


def cover_shots(rows: list[dict], floor: int, total: int) -> list[dict]:
    """Frames for a budget (K7): first `floor` of each critical window, then a frame of each uncovered shot
    (scene changes first, nearest to its middle), then an even fill.

    rows: idx, t, shot, reason, critical (window name or None).
    """
    rows = sorted(rows, key=lambda r: r["idx"])
    taken: dict[int, str] = {}
    for name in sorted({r["critical"] for r in rows if r["critical"]}):
        for r in [r for r in rows if r["critical"] == name][:floor]:
            if len(taken) < total:
                taken.setdefault(r["idx"], "critical")
    covered = {r["shot"] for r in rows if r["idx"] in taken}
    for shot in sorted({r["shot"] for r in rows} - covered):
        own = [r for r in rows if r["shot"] == shot]
        mid = (own[0]["t"] + own[-1]["t"]) / 2
        best = min(own, key=lambda r: (r["reason"] != "scene_change", abs(r["t"] - mid), r["idx"]))
        if len(taken) < total:
            taken[best["idx"]] = "shot"
    left = [r["idx"] for r in rows if r["idx"] not in taken]
    need = min(total - len(taken), len(left))
    for i in range(need):
        taken[left[i * len(left) // need]] = "fill"
    return [{"idx": i, "why": w} for i, w in sorted(taken.items())]


def claim_options(requirements: list[dict], options: list[dict], same: Callable[[str, str], bool]) -> list[dict]:
    """Greedy one-to-one matching (J13): each requirement claims the first unclaimed like option; unclaimed ones are added."""
    ordered = sorted(options, key=lambda o: o["pos"])
    waiting: dict[str, deque[int]] = {}  # of each text the options that are unclaimed, in order
    for i, o in enumerate(ordered):
        waiting.setdefault(o["text"], deque()).append(i)
    like: dict[str, list[deque[int]]] = {}  # two texts are compared once
    out = []
    for r in sorted(requirements, key=lambda r: r["pos"]):
        if r["text"] not in like:
            like[r["text"]] = [left for text, left in waiting.items() if same(r["text"], text)]
        first = min((left for left in like[r["text"]] if left), key=lambda left: left[0], default=None)
        out.append({"text": r["text"], "option": ordered[first.popleft()]["text"] if first else None, "added": False})
    added = sorted(i for left in waiting.values() for i in left)
    return out + [{"text": ordered[i]["text"], "option": ordered[i]["text"], "added": True} for i in added]


def merge_rules(rows: Iterable[dict], share: float = 0.6) -> Iterator[dict]:
    """Rules that share `share` of the smaller hint set merge, the longer text kept, hints united (R33, SO4).

    Two rules about figures (`figures` true) merge if they share a claim class. rows, the longest texts first, then
    by id: id, text, hints, classes (lists of strings), figures.
    """
    kept: list[dict] = []
    for r in rows:
        own, classes = set(r["hints"]), set(r["classes"] or ())
        for k in kept:
            small = min(len(own), len(k["set"]))
            if (small and len(own & k["set"]) >= share * small) or (r["figures"] and k["figures"] and classes & k["classes"]):
                k["set"] |= own
                k["merged"] += 1
                break
        else:
            kept.append({"id": r["id"], "text": r["text"], "set": own, "classes": classes, "figures": r["figures"], "merged": 0})
    for k in kept:
        yield {"id": k["id"], "text": k["text"], "hints": ",".join(sorted(k["set"])), "merged": k["merged"]}


def box_lines(rows: Iterable[dict], v_overlap: float = 0.6, gap: float = 1.5) -> Iterator[dict]:
    """Word boxes into lines, first fit, the line's box growing (§2.9): id, line.

    rows, by x0, y0 and id: id, x0, y0, x1, y1. A word joins a line if their heights overlap by v_overlap of the
    smaller and the horizontal gap is at most `gap` of the word's height.
    """
    lines: list[dict] = []
    for r in rows:
        h = r["y1"] - r["y0"]
        for i, line in enumerate(lines):
            both = min(r["y1"], line["y1"]) - max(r["y0"], line["y0"])
            if both >= v_overlap * min(h, line["y1"] - line["y0"]) and r["x0"] - line["x1"] <= gap * h:
                line.update(x0=min(line["x0"], r["x0"]), y0=min(line["y0"], r["y0"]), x1=max(line["x1"], r["x1"]), y1=max(line["y1"], r["y1"]))
                yield {"id": r["id"], "line": i}
                break
        else:
            lines.append({k: r[k] for k in ("x0", "y0", "x1", "y1")})
            yield {"id": r["id"], "line": len(lines) - 1}
