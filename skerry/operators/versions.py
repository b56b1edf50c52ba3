"""Keyed tables with whole versions: a merge is written aside and becomes visible in one atomic step.

A table is a folder of data folders and of manifests, v00000001.json and so on. Readers take the last manifest and
see all of a version or none of it; a writer that lost a race gets an error and can merge again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from .store import merge_last


class VersionedTable:
    """Rows of a key at a path of any Hadoop file system whose rename refuses a taken name."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.path).getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def version(self) -> int:
        """The last version; 0 if there is none."""
        folder = self._path(f"{self.path}/manifest")
        if not self.fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def folder(self, version: int) -> str:
        stream = self.fs.open(self._path(f"{self.path}/manifest/v{version:08d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folder"]
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, or of the last; None if nothing was written yet."""
        version = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.path}/{self.folder(version)}") if version else None

    def write(self, rows: DataFrame, after: int) -> int:
        """Make these rows the version after `after`; an error, and no trace, if another writer was first."""
        name = f"data-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        try:
            self._commit(name, after + 1)
        except BaseException:
            self.fs.delete(self._path(f"{self.path}/{name}"), True)
            raise
        return after + 1

    def _commit(self, name: str, version: int) -> None:
        aside, final = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}"), self._path(f"{self.path}/manifest/v{version:08d}.json")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps({"folder": name, "version": version}), "utf-8"))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.context.rename(aside, final, options)  # without OVERWRITE: a taken name is an error
        except Exception as e:
            self.fs.delete(aside, False)
            raise RuntimeError(f"version {version} of {self.path} is taken: merge again") from e

    def merge(self, new: DataFrame, keys: list[str], order: str | None = None) -> int:
        """Upsert rows by key: the row of the highest `order` stays, or without one, the new row.

        Columns that only one side has are null in the other. Rows of `new` that share a key must differ in `order`, or are
        one of them.
        """
        after = self.version()
        old = self.read(after)
        if old is None:
            both = new.dropDuplicates(keys) if order is None else merge_last(new.limit(0), new, keys, order)
        elif order is not None:
            both = merge_last(old, new, keys, order) if set(old.columns) == set(new.columns) else self._last(old, new, keys, order)
        else:
            fresh = new.dropDuplicates(keys)
            both = old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)
        return self.write(both, after)

    @staticmethod
    def _last(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
        every = old.unionByName(new, allowMissingColumns=True)
        return merge_last(every.limit(0), every, keys, order)
