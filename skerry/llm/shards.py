"""Sharding by size-tiered compaction, with DataFrame operations alone on the rows' way.

A store is a folder of immutable runs and of manifests. An arrival is written as a run of small shards. A run's
tier is the logarithm of its bytes; when a tier holds `fanout` runs, they are merged into one run whose shards
have the target size, without a shuffle: neighbouring file splits are read by one task and written as one
file. Each change is one new manifest under the next version's name, put there in one step that fails if the
name is taken, so of two writers one loses and readers see all of a change or nothing; a job that dies leaves
files that no manifest names. Where renames are atomic (RENAMES) that step is a rename; in object stores it is
a create without overwriting, whose object appears whole when it is closed, and which needs a store and
connector that support conditional writes. Old versions stay readable until vacuum() drops them.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..session import scratch

#: Bytes of a shard that merges aim at; bytes below which runs are all of tier 0; runs of a tier that merge.
TARGET, BASE, FANOUT = 64 << 20, 1 << 20, 4
#: Schemes whose rename is atomic and refuses a taken name.
RENAMES = ("file", "hdfs", "viewfs", "abfs", "abfss")
#: Arrivals that the query deals the table into.
ARRIVALS = 16
#: Name of a column for the files' paths, which no table has.
PLACE = "_store_file_path"
#: Versions that the query keeps.
KEEP = 4


class ShardStore:
    """A table as runs of shards under a path that Hadoop's file systems can reach."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, base: int = BASE, fanout: int = FANOUT):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.base, self.fanout = target, base, max(2, fanout)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        folder = self._path(f"{self.path}/manifest")
        if not self.fs.exists(folder):
            return 0
        return max([int(s.getPath().getName()[1:-5]) for s in self.fs.listStatus(folder) if s.getPath().getName().startswith("v")], default=0)

    def manifest(self, version: int | None = None) -> list[dict]:
        """Runs of a version: name, folder, bytes, shards, arrivals."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self.fs.open(self._path(f"{self.path}/manifest/v{version:08d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["runs"]
        finally:
            stream.close()

    def commit(self, runs: list[dict], after: int) -> int:
        """Make `runs` the version after `after`, in one atomic step; raises if another writer was first."""
        folder = f"{self.path}/manifest"
        self.fs.mkdirs(self._path(folder))
        final = self._path(f"{folder}/v{after + 1:08d}.json")
        body = bytearray(json.dumps({"version": after + 1, "runs": runs}).encode())
        taken = RuntimeError(f"version {after + 1} was committed by another writer")
        if self.fs.exists(final):
            raise taken
        if self.fs.getScheme() in RENAMES:
            aside = self._path(f"{folder}/.{uuid.uuid4().hex}")
            self._write(aside, body)
            if not self.fs.rename(aside, final):
                self.fs.delete(aside, False)
                raise taken
        else:
            try:
                self._write(final, body)
            except Py4JJavaError as e:
                if "FileAlreadyExists" in e.java_exception.getClass().getName():
                    raise taken from e
                raise
        return after + 1

    def _write(self, path, body: bytearray) -> None:
        out = self.fs.create(path, False)
        out.write(body)
        out.close()

    def _run(self, folder: str, arrivals: list[str], schema: StructType) -> dict:
        files = [s for s in self.fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")]
        return {"name": folder.rsplit("/", 1)[-1], "folder": folder, "bytes": sum(s.getLen() for s in files), "shards": len(files), "arrivals": arrivals, "schema": schema.json()}

    def _drop(self, folders) -> None:
        for folder in folders:
            self.fs.delete(self._path(folder), True)

    def _schema(self, run: dict) -> StructType:
        return StructType.fromJson(json.loads(run["schema"])) if "schema" in run else self.spark.read.parquet(run["folder"]).schema

    def _rows(self, runs: list[dict], placed: bool = False) -> DataFrame:
        """The rows of runs under the widest schema of all; a column that a run lacks is null in its rows. `placed` adds the file's path as the last column."""
        schemas = [self._schema(r) for r in runs]
        every, like = widest(schemas), {}
        for run, schema in zip(runs, schemas):
            like.setdefault(schema.json(), (schema, []))[1].append(run["folder"])
        out = None
        for schema, folders in like.values():
            names = set(schema.names)
            cols = [(F.col(f"`{f.name}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in every]
            place = [F.col("_metadata.file_path").alias(PLACE)] if placed else []
            part = self.spark.read.schema(schema).parquet(*folders).select(*cols, *place)
            out = part if out is None else out.unionAll(part)
        return out

    def append(self, df: DataFrame, name: str) -> int:
        """One arrival as a run of small shards; if the commit is lost, its files go and the error stays.

        Columns may come, go or get a wider type; one whose type no other can hold is refused before anything is written.
        """
        widest([*(self._schema(r) for r in self.manifest()), df.schema])
        folder = f"{self.path}/runs/a-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        after = self.version()
        try:
            return self.commit([*self.manifest(after), self._run(folder, [name], df.schema)], after)
        except RuntimeError:
            self._drop([folder])
            raise

    def append_all(self, df: DataFrame, arrival) -> int:
        """Many arrivals in one pass over their rows; each becomes a run and a version of its own, in order."""
        widest([*(self._schema(r) for r in self.manifest()), df.schema])
        folder, column = f"{self.path}/runs/b-{uuid.uuid4().hex}", f"arrival_{uuid.uuid4().hex}"
        df.withColumn(column, arrival).write.option("compression", "zstd").partitionBy(column).parquet(folder)
        after = self.version()
        runs = self.manifest(after)
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder)) if s.getPath().getName().startswith(f"{column}="))
        for name in names:
            runs = [*runs, self._run(f"{folder}/{name}", [name.split("=", 1)[1]], df.schema)]
            after = self.commit(runs, after)
        return after

    def tier(self, run: dict) -> int:
        return 0 if run["bytes"] <= self.base else int(math.log(run["bytes"] / self.base, self.fanout)) + 1

    def plan(self, runs: list[dict]) -> list[list[dict]]:
        """Groups of `fanout` runs of one tier each, oldest first."""
        tiers: dict[int, list[dict]] = {}
        for run in runs:
            tiers.setdefault(self.tier(run), []).append(run)
        return [mine[i : i + self.fanout] for _, mine in sorted(tiers.items()) for i in range(0, len(mine) - self.fanout + 1, self.fanout)]

    def _merge(self, group: list[dict]) -> dict:
        folder = f"{self.path}/runs/m-{uuid.uuid4().hex}"
        shards = max(1, round(sum(r["bytes"] for r in group) / self.target))
        rows = self._rows(group)
        rows.coalesce(shards).write.option("compression", "zstd").parquet(folder)
        return self._run(folder, [a for r in group for a in r["arrivals"]], rows.schema)

    def compact(self) -> int:
        """Merge until no tier is full; the merges of a round run side by side and are one commit.

        Replaced runs stay for readers of older versions. Of a lost race, the merged files go.
        """
        while groups := self.plan(runs := self.manifest(after := self.version())):
            with ThreadPoolExecutor(4) as pool:
                merged = list(pool.map(self._merge, groups))
            gone = {r["folder"] for g in groups for r in g}
            try:
                self.commit([r for r in runs if r["folder"] not in gone] + merged, after)
            except RuntimeError:
                self._drop(r["folder"] for r in merged)
                raise
        return self.version()

    def vacuum(self, keep: int = 1) -> int:
        """Drop all versions but the last `keep`, and the runs that only they name; returns how many runs went.

        A reader of a dropped version fails, so `keep` has to cover the longest job.
        """
        last = self.version()
        kept = {r["folder"] for v in range(max(1, last - keep + 1), last + 1) for r in self.manifest(v)}
        old = [v for v in range(1, last - keep + 1) if self.fs.exists(self._path(f"{self.path}/manifest/v{v:08d}.json"))]
        gone = {r["folder"] for v in old for r in self.manifest(v)} - kept
        self._drop(gone)
        self._drop(f"{self.path}/manifest/v{v:08d}.json" for v in old)
        return len(gone)

    def read(self, columns: list[str] | None = None, version: int | None = None) -> DataFrame | None:
        """The rows of a version (the latest), with version, run and shard; None for a store without runs.

        Where the table has columns of these names, the store's are called store_version, store_run and store_shard.
        """
        version = self.version() if version is None else version
        runs = self.manifest(version)
        if not runs:
            return None
        df = self._rows(runs, placed=True)
        names, place = df.columns[:-1], F.split(F.col(PLACE), "/")
        own = {"version": F.lit(version), "run": F.element_at(place, -2), "shard": F.element_at(place, -1)}
        prefix = "store_" if {c.lower() for c in names} & set(own) else ""
        return df.select(*[f"`{c}`" for c in columns or names], *[c.alias(prefix + name) for name, c in own.items()])


#: Types that hold all of those before them.
WIDER = (("tinyint", "smallint", "int", "bigint"), ("float", "double"), ("tinyint", "smallint", "int", "double"))


def widest(schemas: list[StructType]) -> StructType:
    """All columns of the schemas, in order of first sight, each with the type that holds all of its types; an error if there is none."""
    found: dict[str, DataType] = {}
    for field in (f for s in schemas for f in s):
        have = found.get(field.name)
        a, b = have.simpleString() if have else None, field.dataType.simpleString()
        if have is None or a == "void":
            found[field.name] = field.dataType
        elif a != b and b != "void":
            line = next((w for w in WIDER if a in w and b in w), None)
            if line is None:
                raise TypeError(f"column {field.name} is {a} and {b}")
            if line.index(b) > line.index(a):
                found[field.name] = field.dataType
    out = StructType()
    for name, kind in found.items():
        out = out.add(name, kind)
    return out


def shard(docs: DataFrame, path: str | None = None, arrivals: int = ARRIVALS, target: int = TARGET, base: int = BASE, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_bytes, version, run and shard of each document, after its arrivals were appended and compacted.

    Arrivals are doc_id modulo `arrivals` (null: the first). Each row is in one shard of the last version;
    repeated rows stay; null and empty texts have 0 bytes; all columns are stored, whatever their names, and later ones may have more, fewer or wider columns; an
    empty table gives no rows. Versions before the last KEEP are dropped at the end.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, path or scratch(spark, "shards"), target, base, fanout)
    store.append_all(docs, F.coalesce(F.pmod(F.col("doc_id").cast("long"), F.lit(arrivals)), F.lit(0)))
    store.compact()
    store.vacuum(KEEP)
    found = store.read(["doc_id", "text"])
    if found is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).alias("version"), F.lit("").alias("run"), F.lit("").alias("shard")).where("false")
    own = [F.col(c).alias(c.removeprefix("store_")) for c in found.columns[2:]]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), *own)
