"""Service health: windows, breaker, budgets, back-off, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Breaker: errors in a row that open it, seconds until a probe is let through.
OPEN_AFTER, COOLDOWN = 3, 600


def health(events: DataFrame, provider: str, ts: str, ok: Column, latency: str, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """window_start, provider, requests, success_rate, mean and largest latency; works on streams, too."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.groupBy(w.alias("w"), F.col(provider).alias("provider")).agg(F.count("*").alias("requests"), F.avg(ok.cast("double")).alias("success_rate"), F.avg(latency).alias("mean_latency"), F.max(latency).alias("max_latency")).select(F.col("w.start").alias("window_start"), "provider", "requests", "success_rate", "mean_latency", "max_latency")


def breaker_step(state: Column, ok: Column, at: Column) -> Column:
    """The next (state, failures, opened) after one outcome at epoch seconds `at`."""
    probing = (state["state"] == "open") & (at >= state["opened"] + COOLDOWN)
    now = F.when(probing, F.lit("half_open")).otherwise(state["state"])
    failures = F.when(ok, 0).otherwise(state["failures"] + 1)
    opens = (now == "half_open") & ~ok | (now == "closed") & ~ok & (failures >= OPEN_AFTER)
    blocked = now == "open"
    return F.struct(
        F.when(blocked, "open").when(opens, "open").when(ok, "closed").otherwise(now).alias("state"),
        F.when(blocked, state["failures"]).otherwise(failures).alias("failures"),
        F.when(opens, at).otherwise(state["opened"]).alias("opened"),
    )


def breaker(events: DataFrame, by: list[str], order: str, ok: Column, at: Column) -> DataFrame:
    """Final breaker state of each key: a fold over its outcomes in order. Keys are bounded in rows by what a service sees in the period at hand."""
    seed = F.struct(F.lit("closed").alias("state"), F.lit(0).alias("failures"), F.lit(0).cast("long").alias("opened"))
    rows = events.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), at.cast("long").alias("at"), ok.alias("ok")))).alias("_r"))
    return rows.select(*by, F.aggregate("_r", seed, lambda s, r: breaker_step(s, r["ok"], r["at"])).alias("b")).select(*by, "b.state", "b.failures")


def running_total(events: DataFrame, by: list[str], order: list[str], amount: str, budget: float) -> DataFrame:
    """Adds spent and within: the running sum and whether it keeps to the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("spent", F.sum(amount).over(w)).withColumn("within", F.col("spent") <= budget)


def backoff(attempts: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    """Delay before the given attempt (from 0): base * 2^n, at most cap."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempts))


def leaky_bucket(events: DataFrame, by: list[str], at: Column, order: list[str], cost: str, rate: float, size: float) -> DataFrame:
    """Adds level and limited: the bucket after each event, which leaks `rate` a second and holds `size`.

    level_i = max(0, level_(i-1) - rate * (t_i - t_(i-1))) + cost_i, written as a running sum less its running
    minimum, so that it is a window function and no fold.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    leaked = at * rate
    rows = events.withColumn("_a", F.sum(cost).over(w)).withColumn("_t", leaked)
    rows = rows.withColumn("_m", F.min(F.col("_a") - F.col(cost) - F.col("_t")).over(w))
    return rows.withColumn("level", F.col("_a") - F.col("_t") - F.col("_m")).withColumn("limited", F.col("level") > size).drop("_a", "_t", "_m")


def unhealthy(events: DataFrame, by: list[str], order: list[str], ok: Column, latency: str, calls: int = 20, least: int = 5, errors: float = 0.5, slow: float = 90.0) -> DataFrame:
    """Adds error_rate, p95 and trip over each key's last `calls` calls: too many errors, or a 95th percentile (nearest rank) over `slow`."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - calls, 0)
    rows = events.withColumn("_n", F.count("*").over(w)).withColumn("error_rate", F.avg((~ok).cast("double")).over(w))
    last = F.sort_array(F.collect_list(latency).over(w))  # `calls` values at most
    rows = rows.withColumn("p95", F.element_at(last, (F.least(F.col("_n") - 1, F.floor(F.col("_n") * 0.95)) + 1).cast("int")))
    return rows.withColumn("trip", (F.col("_n") >= least) & ((F.col("error_rate") >= errors) | (F.col("p95") > slow))).drop("_n")


def jittered(delay: Column, key: Column) -> Column:
    """A delay between its half and itself, spread by the key's digest, so that retries don't meet."""
    part = F.conv(F.substring(F.md5(key.cast("string")), 1, 6), 16, 10).cast("double") / float(1 << 24)
    return delay * (0.5 + part / 2)
