"""Streams of gateway events: source, drain into a table, circuit breaker with kept state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gateway import COOLDOWN, OPEN_AFTER
from ..session import scratch, ship

#: Our choice: how late an event may be.
WATERMARK = "10 minutes"


def stream(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """Events as a stream, with ts an instant and a watermark; `files` of the table in each micro-batch, or all."""
    ship(spark)
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/events.parquet")
    many = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    raw = reader.parquet(path.toString()) if many else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK)


def drain(spark: SparkSession, rows: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives for the input at hand, from its last batch (complete) or all of them."""
    out, kept = scratch(spark, "stream"), scratch(spark, "stream-state")

    def write(batch: DataFrame, epoch: int) -> None:
        # a batch that is tried again replaces its own rows
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/epoch={epoch}")

    rows.writeStream.outputMode(mode).option("checkpointLocation", kept).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select(*rows.columns)


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without those whose keys came before, within the watermark's delay; older keys leave the state."""
    return rows.dropDuplicatesWithinWatermark(keys)


def next_state(state: str, failures: int, opened: int, ok: bool, at: int) -> tuple[str, int, int]:
    """One step of the breaker, as operators.gateway.breaker_step states it."""
    if state == "open" and at >= opened + COOLDOWN:
        state = "half_open"
    if state == "open":
        return state, failures, opened
    failures = 0 if ok else failures + 1
    if not ok and (state == "half_open" or failures >= OPEN_AFTER):
        return "open", failures, at
    return ("closed" if ok else state), failures, opened


def breaker(spark: SparkSession, events: DataFrame) -> DataFrame:
    """event_type, user_id, state, failures: the breaker of each key after all its events in order."""

    def fold(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        at = state.get if state.exists else ("closed", 0, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for ok, seconds in zip(rows["ok"].tolist(), rows["at"].tolist()):
            at = next_state(*at, ok, seconds)
        state.update(at)
        yield pd.DataFrame([(*key, at[0], at[1])], columns=["event_type", "user_id", "state", "failures"])

    rows = events.select("event_type", "user_id", "event_id", F.unix_seconds("ts").alias("at"), "ok")
    folded = rows.groupBy("event_type", "user_id").applyInPandasWithState(fold, "event_type string, user_id long, state string, failures int", "state string, failures int, opened long", "update", "NoTimeout")
    return drain(spark, folded, "update")
