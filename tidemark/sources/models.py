"""Models and other foreign code behind one interface: made once an executor's worker, fed by Arrow batches (S22, §2.11).

A model is whatever `make()` returns: a recogniser, an embedder, a language backend. Tests and runs without one
pass rules or look-ups in its place, or skip this module and join a table of the model's outputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions import cues

_made: dict[str, Any] = {}


def worker_model(name: str, make: Callable[[], Any]) -> Any:
    """The model of that name, made at its first use in this worker."""
    if name not in _made:
        _made[name] = make()
    return _made[name]


def with_model(df: DataFrame, name: str, make: Callable[[], Any], columns: list[str], apply: Callable[[Any, list[dict]], list[dict]], schema: str) -> DataFrame:
    """df with the columns of `schema`: what apply(model, rows of a batch) gives for each row.

    An answer of another length than the batch fails the task. Columns of df with those names are replaced.
    """
    new = T.StructType.fromDDL(schema)
    df = df.drop(*new.names)
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(name, make)
        for batch in batches:
            got = apply(model, batch.select(columns).to_pylist())
            if len(got) != batch.num_rows:
                raise ValueError(f"{name} gave {len(got)} answers to {batch.num_rows} rows")
            made = pa.RecordBatch.from_pylist(got, schema=arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.columns], names=[*batch.schema.names, *new.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new.fields]))


def ordered_map(df: DataFrame, ordinal: str, f: Callable[[dict], Any], schema: str = "string", workers: int | None = None) -> DataFrame:
    """ordinal, result and error of f over every row, at most `workers` rows at a time: the order of the input is that of the ordinal.

    An exception in one row is its error and costs no other row.
    """
    out = T.StructType([df.schema[ordinal], T.StructField("result", T._parse_datatype_string(schema)), T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                try:
                    made.append({ordinal: row[ordinal], "result": f(row), "error": None})
                except Exception as e:  # noqa: BLE001
                    made.append({ordinal: row[ordinal], "result": None, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    dealt = df.repartition(workers, ordinal) if workers else df
    return dealt.mapInArrow(run, out)


def rules_backend(units: DataFrame, text: Column) -> DataFrame:
    """units as requirements by rules alone: mode, polarity, kind, priority, checkable, claims and hints. No model needed."""
    mode, polarity = cues.evidence_mode(text), cues.polarity(text)
    first = units.withColumns({"mode": F.coalesce(mode, F.lit("any")), "polarity": polarity, "_mode": mode})
    kind = cues.requirement_type(text, F.col("_mode"))
    second = first.withColumn("kind", kind).drop("_mode")
    more = {"priority": cues.priority(text, F.col("kind"), F.col("polarity")), "checkable": cues.machine_checkable(text, F.col("kind")), "claims": cues.claim_classes(text), "hints": cues.match_hints(text)}
    return second.withColumns(more)
