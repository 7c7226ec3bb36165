"""From raw documents to packed training sequences: language ID, near duplicates, secrets, packing.

Each stage works on all that the one before it kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, ngram_join, packing, secrets
from tidemark.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin; a null lang takes the predicted one.

    Dictionaries are learned from a bounded sample of the documents that have a lang. Null, empty and
    letterless texts are rejected.
    """
    learned = language.fit(docs)
    kept = language.classify(docs.select(*COLUMNS), learned).filter("accepted")
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the least id.

    Of rows of that id that are linked the one of the least hash of its text stays, and of equal rows one. Rows are
    named by id and text, so of an id with two texts only the linked one can go. Documents without words are linked
    with nothing and all stay.
    """
    found = written(spark, ngram_join.groups(docs).filter("component is not null"), "near")
    least = found.filter("doc_id <=> component_id")
    again = written(spark, least.groupBy("component", "doc_id").agg(F.count("*").alias("n"), F.min("text_hash").alias("text_hash")).filter("n > 1"), "again")
    others = least.join(again.select("component", F.col("text_hash").alias("stays")), "component").filter("text_hash <> stays")
    drop = found.filter("not (doc_id <=> component_id)").select("doc_id", "text_hash").unionByName(others.select("doc_id", "text_hash"))
    kept = _rows(docs.select(*COLUMNS), written(spark, drop.distinct(), "drop"), "left_anti")
    if again.isEmpty():
        return kept
    once = _rows(kept, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return _rows(kept, again, "left_anti").unionByName(once)


def _rows(docs: DataFrame, named: DataFrame, how: str) -> DataFrame:
    """The rows of docs that are, or aren't, among those named by doc_id and text_hash."""
    n = named.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    n = F.broadcast(n) if named.count() <= ngram_join.BROADCAST else n
    return docs.join(n, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), how)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars is counted anew. A null text stays null."""
    return docs.withColumn("text", secrets.redact(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; see tidemark.llm.packing."""
    import public_tokenizers

    # the workers have served other stages before, so a smaller cache of pieces, at some cost of time
    return packing.pack_texts(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), held=400_000)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", pack_documents),
]

#: Compression, signatures and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return docs
