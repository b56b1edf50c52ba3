"""What is under way at each time: a sweep over arrivals and ends, in time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets whose sums one task puts in order; longer times get wider buckets.
BUCKETS = 1 << 16


def depth(spans: DataFrame, start: str, end: str, by: list[str] | None = None, bucket: int | None = None) -> DataFrame:
    """by, at, arrived, left and depth: how many of the spans [start, end) are open from each moment at which one begins or ends.

    `start` and `end` are whole numbers (say, microseconds). Spans become +1 and -1 at their ends and add up at equal
    moments. Moments are dealt to buckets of time; sums of whole buckets give each its depth at the beginning, and within
    a bucket a running sum adds to it. So no partition holds more than a bucket, and the sums of all buckets are BUCKETS rows
    a key at most. Spans without a start, or that end before they begin, are left out; without an end they stay open.
    """
    by = by or []
    ok = spans.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start))))
    up = ok.select(*by, F.col(start).cast("long").alias("at"), F.lit(1).alias("_a"), F.lit(0).alias("_l"))
    down = ok.where(F.col(end).isNotNull()).select(*by, F.col(end).cast("long").alias("at"), F.lit(0).alias("_a"), F.lit(1).alias("_l"))
    moments = up.unionByName(down).groupBy(*by, "at").agg(F.sum("_a").alias("arrived"), F.sum("_l").alias("left"))
    if bucket is None:
        first = ok.agg(F.min(start).alias("a"), F.max(F.coalesce(end, start)).alias("z")).first()
        bucket = max(1, -(-((first.z or 0) - (first.a or 0)) // BUCKETS))
    moments = moments.withColumn("_b", F.floor(F.col("at") / F.lit(bucket)).cast("long"))
    sums = moments.groupBy(*by, "_b").agg(F.sum(F.col("arrived") - F.col("left")).alias("_s"))
    one = [F.lit(0).alias("_one")] if not by else []
    before = sums.select(*by, "_b", "_s", *one).withColumn("_before", F.coalesce(F.sum("_s").over(Window.partitionBy(*(by or ["_one"])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum(F.col("arrived") - F.col("left")).over(Window.partitionBy(*by, "_b").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return moments.withColumn("_w", within).join(before.select(*by, "_b", "_before"), [*by, "_b"]).select(*by, "at", "arrived", "left", (F.col("_before") + F.col("_w")).alias("depth"))


def states(items: DataFrame, arrived: str, due: str, done: str, horizon: Column) -> DataFrame:
    """Adds state: deferred (not due yet), queued (due and not done), or done, as of `horizon`."""
    state = F.when(F.col(done) <= horizon, "done").when(F.col(due) <= horizon, "queued").when(F.col(arrived) <= horizon, "deferred")
    return items.withColumn("state", state)
