"""Content keys: canonical JSON and stage keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stage_key(stage: str, version: str, inputs: Column, config: Column) -> Column:
    """First 16 hex digits of the sha256 of {config, inputs sorted, stage, version} as JSON with sorted keys.

    config is a struct; its fields must be in order of name.
    """
    doc = F.struct(config.alias("config"), F.array_sort(inputs).alias("inputs"), F.lit(stage).alias("stage"), F.lit(version).alias("version"))
    return F.substring(F.sha2(F.to_json(doc), 256), 1, 16)


def content_id(prefix: str, digits: int, *parts: Column) -> Column:
    """prefix and the first digits of the sha256 of the parts, joined by |."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits))
