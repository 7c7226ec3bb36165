"""A content-addressed store of stage results as Parquet.

A result lies under <root>/stage=<name>/key=<16 hex digits>; the key covers the stage, its version, its
inputs' keys and its configuration, so equal work is found again and changed work isn't.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def stage_key(stage: str, version: str, inputs: Sequence[str], config: object) -> str:
    text = canonical({"config": config, "inputs": sorted(inputs), "stage": stage, "version": version})
    return hashlib.sha256(text.encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def path(self, stage: str, key: str) -> str:
        return f"{self.root.rstrip('/')}/stage={stage}/key={key}"

    def _there(self, path: str) -> int:
        """Modification time of a finished result, or 0."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else 0

    def get(self, stage: str, keys: Sequence[str]) -> tuple[DataFrame | None, str]:
        """The first key that is there (exact), else the newest of the stage (fallback), else nothing (missing)."""
        for key in keys:
            if self._there(self.path(stage, key)):
                return self.spark.read.parquet(self.path(stage, key)), "exact"
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/stage={stage}/key=*")
        found = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(top)
        paths = [str(f.getPath()) for f in found or []]
        aged = sorted((self._there(p), p) for p in paths)
        if aged and aged[-1][0]:
            return self.spark.read.parquet(aged[-1][1]), "fallback"
        return None, "missing"

    def run(self, stage: str, version: str, inputs: Sequence[str], config: object, make: Callable[[], DataFrame], check: Callable[[DataFrame], bool] | None = None) -> tuple[DataFrame, str, bool]:
        """(result, key, hit): the stored result, or make()'s, stored.

        check: whether a result is one that this stage could have made (X5). A stored one that can't be read or fails it
        is no hit and is made again under the same key; a new one that fails it is an error and isn't stored. A result is
        written beside its place and put there by a rename, so readers see a whole one or none; of writers at
        the same time one stays.
        """
        key = stage_key(stage, version, inputs, config)
        path = self.path(stage, key)
        if self._there(path) and self._sound(path, check):
            return self.spark.read.parquet(path), key, True
        fresh = f"{self.root.rstrip('/')}/_made/{stage}-{key}-{uuid.uuid4().hex}"
        make().write.parquet(fresh)
        if check and not check(self.spark.read.parquet(fresh)):
            self._delete(fresh)
            raise ValueError(f"what stage {stage} made fails its own check")
        self._put(fresh, path, check)
        return self.spark.read.parquet(path), key, False

    def _sound(self, path: str, check: Callable[[DataFrame], bool] | None) -> bool:
        if not check:
            return True
        try:
            return bool(check(self.spark.read.parquet(path)))
        except Exception:  # whatever keeps it from being read: it is made again
            return False

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        p, fs = self._hadoop(path)
        fs.delete(p, True)

    def _put(self, fresh: str, path: str, check: Callable[[DataFrame], bool] | None) -> None:
        """Moves a result to its place, unless another writer has put a sound one there meanwhile."""
        source, fs = self._hadoop(fresh)
        target, _ = self._hadoop(path)
        fs.mkdirs(target.getParent())
        for _ in range(5):
            if self._there(path) and self._sound(path, check):
                break  # theirs is as good
            if fs.exists(target):  # what failed goes aside first: a rename onto a folder would move into it
                aside, _ = self._hadoop(f"{fresh}-old-{uuid.uuid4().hex}")
                if fs.rename(target, aside):
                    fs.delete(aside, True)
            if not fs.exists(target) and fs.rename(source, target):
                nested, _ = self._hadoop(f"{path}/{source.getName()}")
                if fs.exists(nested):  # another writer was faster by a moment
                    fs.delete(nested, True)
                return
        if not self._there(path):
            raise OSError(f"no result could be put to {path}")
        self._delete(fresh)
