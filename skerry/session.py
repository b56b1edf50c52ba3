"""Session helpers: what an operator may ask of the session it is given."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: For Python workers, which are used again and again: what a task frees goes back to the system.
WORKER_ENV = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows of an Arrow batch where the session has Spark's default: a row here is a text.
BATCH, DEFAULT_BATCH = "2000", "10000"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even where PYTHONPATH lacks it, and keep them small."""
    env = spark.sparkContext.environment
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == DEFAULT_BATCH:
        spark.conf.set(rows, BATCH)
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, ROOT])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one for tests where it is unset and Spark runs on one machine."""
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir", None)
    if there is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        there = "/tmp/checkpoints"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(there)
    return there


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to a new folder as Parquet and read again: for large results, as checkpoints aren't compressed."""
    path = scratch(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that small() broadcasts.
SMALL = 100_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """The same rows, cut; to be broadcast in joins if they are few, so that a large other side is not shuffled."""
    rows = cut(df)
    return F.broadcast(rows) if rows.count() <= most else rows
