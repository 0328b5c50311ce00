"""Named tables in a folder: a save is whole or not seen at all, the last few versions stay, and a reader never meets half of one."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Versions of a table are folders beside each other; a version counts once its marker of success, written last, is there."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[str]:
        """Whole versions, the oldest first."""
        where = self._path(f"{self.root}/{name}")
        if not self._fs.exists(where):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(v for v in found if v.startswith("v") and self._fs.exists(self._path(f"{self.root}/{name}/{v}/_SUCCESS")))

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def save(self, df: DataFrame, name: str) -> str:
        """Writes a new version, drops those beyond the last `keep`, and returns its name. A failed write leaves what was there."""
        version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/{name}/{version}")
        for old in self.versions(name)[: -self.keep]:
            self._fs.delete(self._path(f"{self.root}/{name}/{old}"), True)
        return version

    def load(self, name: str, version: str | None = None) -> DataFrame:
        """The last version, or a given one; an error where there is none."""
        found = version or next(reversed(self.versions(name)), None)
        if found is None:
            raise FileNotFoundError(f"{self.root} holds no {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/{found}")
