"""File sources and report sinks."""

from __future__ import annotations

import html
import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as tx


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole-document JSON files with a fixed schema; unknown keys are dropped."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Atomic by Spark's commit protocol."""
    df.write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole text files: no BOM, line feeds only; HTML pages are rejected."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    clean = F.replace(F.replace(F.col("text"), F.lit("﻿"), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return raw.withColumn("text", clean).filter(~tx.looks_like_html(F.col("text")))


def sniff(content: Column) -> Column:
    """Container by its first bytes (S8): mp4, webm, avi, ogg, wav or null."""
    h = F.hex(F.substring(content, 1, 16))
    riff = h.startswith("52494646")
    return (
        F.when(F.substring(h, 9, 8) == "66747970", "mp4")
        .when(h.startswith("1A45DFA3"), "webm")
        .when(riff & (F.substring(h, 17, 8) == "41564920"), "avi")
        .when(riff & (F.substring(h, 17, 8) == "57415645"), "wav")
        .when(h.startswith("4F676753"), "ogg")
    )


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, samples (float, mono) of 16-bit PCM files."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import wave

        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(1) / 32768
                    rows.append((p, w.getframerate(), x.astype("float32").tolist()))
            yield pd.DataFrame(rows, columns=["path", "rate", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, rate int, samples array<float>")


def unzipped(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".mp4", ".mov", ".webm")) -> DataFrame:
    """archive, name, content of the archives' files with these suffixes, folders flattened, a number after repeated names."""

    def open_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, seen = [], {}
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        name = info.filename.rsplit("/", 1)[-1]
                        if info.is_dir() or not name.lower().endswith(suffixes):
                            continue
                        stem, dot, end = name.rpartition(".")
                        name = f"{stem}{dot}{end.lower()}"
                        n = seen[p, name] = seen.get((p, name), -1) + 1
                        rows.append((p, f"{stem}_{n}.{end.lower()}" if n else name, z.read(info)))
            yield pd.DataFrame(rows, columns=["archive", "name", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(open_, "archive string, name string, content binary")


def write_html(df: DataFrame, path: str, title: str) -> None:
    """A table as self-contained pages, one a partition, escaped (S17). Pages are written row by row."""
    cells = F.concat(*(F.concat(F.lit("<td>"), tx.escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in df.columns))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    opening = f"<!doctype html><title>{html.escape(title)}</title><table><tr>{head}</tr>"

    def page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda x: pa.RecordBatch.from_arrays([pa.array([x])], names=["value"])
        yield line(opening)
        yield from (pa.RecordBatch.from_arrays(b.columns, names=["value"]) for b in batches)
        yield line("</table>")

    rows = df.select(F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("value"))
    rows.mapInArrow(page, "value string").write.mode("overwrite").text(path)


def zipped(reports: DataFrame, keys: list[str], name: str = "name", content: str = "content") -> DataFrame:
    """keys and archive: one zip of each key's reports by name, with a summary.json of names and sizes.

    The reports of one job are few (its videos), so an archive is made in one task. Names that repeat get a number.
    Archives depend on their contents alone: times are fixed.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        buf, seen, summary = io.BytesIO(), {}, []
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            put = lambda n, data: z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
            for n, data in sorted(zip(pdf[name], pdf[content], strict=True)):
                k = seen[n] = seen.get(n, -1) + 1
                stem, dot, end = n.rpartition(".")
                n = f"{stem or end}_{k}{dot and stem and '.' + end}" if k else n
                data = data if isinstance(data, bytes) else str(data).encode()
                put(n, data)
                summary.append({"name": n, "bytes": len(data)})
            put("summary.json", json.dumps(summary, separators=(",", ":")).encode())
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), buf.getvalue()]], columns=[*keys, "archive"])

    schema = T.StructType([*(reports.schema[k] for k in keys), T.StructField("archive", T.BinaryType())])
    return reports.select(*keys, name, content).groupBy(*keys).applyInPandas(pack, schema)
