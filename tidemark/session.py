"""A session with the settings that the library assumes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "tidemark", **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, Arrow; settings (with _ for .) override."""
    b = SparkSession.builder.appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | {k.replace("_", "."): v for k, v in settings.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a new folder below spark.checkpoint.dir, which driver and executors share.

    Only on a local master, as in tests, may that setting be missing: a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}")
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()  # as Spark itself resolves it
    return re.sub("^file:/+", "file:///", uri)
