"""Gateway health in batch and streaming form; providers are event types, tenants users."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import breaker as B
from ..operators import gateway as W
from ..operators import intervals as I
from ..operators import quantiles as Q
from ..sources.tables import table
from ..streaming import breaker as SB
from ..streaming import gateway as S
from .registry import query

_OK = "value >= 10"


def events(spark, sf_dir):
    """Events with ts as an instant (the session's zone is UTC) and ok."""
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props", F.expr(_OK).alias("ok"))


def _plain(df):
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).select("window_start", "provider", "requests", F.round("success_rate", 6).alias("success_rate"), F.round("mean_latency", 6).alias("mean_latency"), "max_latency")


_AGG = "event_type AS provider, count(*) AS requests, round(avg(CASE WHEN value >= 10 THEN 1.0 ELSE 0 END), 6) AS success_rate, round(avg(value), 6) AS mean_latency, max(value) AS max_latency"
_TUMBLE = f"SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, {_AGG} FROM events GROUP BY 1, 2"
_SLIDE = f"SELECT w AS window_start, {_AGG} FROM (SELECT *, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes'])::TIMESTAMP AS w FROM events) GROUP BY 1, 2"


@query("provider_health_tumbling", _TUMBLE)
def provider_health_tumbling(spark, sf_dir):
    return _plain(W.health(events(spark, sf_dir), "event_type", "ts", F.col("ok"), "value"))


@query("provider_health_sliding", _SLIDE)
def provider_health_sliding(spark, sf_dir):
    return _plain(W.health(events(spark, sf_dir), "event_type", "ts", F.col("ok"), "value", "1 hour", "30 minutes"))


@query("latency_percentiles", "SELECT event_type AS provider, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("provider")).agg(*[F.percentile("value", p).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)])


@query("error_taxonomy", "SELECT event_type AS provider, CASE WHEN value < 2 THEN 'timeout' WHEN value < 5 THEN 'rate_limit' ELSE 'server' END AS error, count(*) AS n FROM events WHERE NOT (value >= 10) GROUP BY 1, 2")
def error_taxonomy(spark, sf_dir):
    kind = F.when(F.col("value") < 2, "timeout").when(F.col("value") < 5, "rate_limit").otherwise("server")
    return events(spark, sf_dir).where("not ok").groupBy(F.col("event_type").alias("provider"), kind.alias("error")).agg(F.count("*").alias("n"))


_PANES = "(SELECT *, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes'])::TIMESTAMP AS w FROM events)"
_KINDS = {"timeouts": "NOT value >= 10 AND value < 2", "rate_limits": "NOT value >= 10 AND value >= 2 AND value < 5", "server_errors": "NOT value >= 10 AND value >= 5"}


@query("rolling_errors", f"SELECT w AS window_start, event_type AS provider, count(value) AS requests, {', '.join(f'count(*) FILTER (WHERE {c}) AS {n}' for n, c in _KINDS.items())} FROM {_PANES} GROUP BY 1, 2")
def rolling_errors(spark, sf_dir):
    """Requests and errors by kind of each provider in sliding windows; half of what rolling_sketch keeps."""
    return _rolling(spark, sf_dir).select("window_start", "provider", F.col("n").alias("requests"), *_KINDS)


def _rolling(spark, sf_dir):
    found = Q.windowed_sketches(events(spark, sf_dir).withColumnRenamed("event_type", "provider"), "ts", ["provider"], "value", "30 minutes", 2, {n: F.expr(c) for n, c in _KINDS.items()})
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("rolling_sketch")
def rolling_sketch(spark, sf_dir):
    """Approximate percentiles of sliding windows, merged from the sketches of their panes; rolling_percentiles is the exact twin."""
    return _rolling(spark, sf_dir).select("window_start", "provider", "n", *[Q.at_rank("sketch", p).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)])


@query("rolling_percentiles", f"SELECT w AS window_start, event_type AS provider, n, {', '.join(f'vs[least(n - 1, CAST(floor(n * {p}) AS BIGINT)) + 1] AS p{round(100 * p)}' for p in (0.5, 0.95, 0.99))} FROM (SELECT w, event_type, count(value) AS n, list_sort(list(value)) AS vs FROM {_PANES} GROUP BY 1, 2)")
def rolling_percentiles(spark, sf_dir):
    """Exact percentiles (nearest rank) of each provider in sliding windows."""
    w = events(spark, sf_dir).select(F.window("ts", "1 hour", "30 minutes")["start"].cast("timestamp_ntz").alias("window_start"), F.col("event_type").alias("provider"), "value")
    found = Q.exact(w, ["window_start", "provider"], "value", [0.5, 0.95, 0.99])
    return found.groupBy("window_start", "provider", "n").agg(*[F.max(F.when(F.col("share") == p, F.col("value"))).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)])


@query("provider_percentiles", f"SELECT event_type AS provider, n, {', '.join(f'vs[least(n - 1, CAST(floor(n * {p}) AS BIGINT)) + 1] AS p{round(100 * p)}' for p in (0.5, 0.95, 0.99))} FROM (SELECT event_type, count(value) AS n, list_sort(list(value)) AS vs FROM events GROUP BY 1)")
def provider_percentiles(spark, sf_dir):
    """The same over all time: five groups of any size, of which none is sorted as a whole."""
    found = Q.exact(events(spark, sf_dir).withColumnRenamed("event_type", "provider"), ["provider"], "value", [0.5, 0.95, 0.99])
    return found.groupBy("provider", "n").agg(*[F.max(F.when(F.col("share") == p, F.col("value"))).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)])


#: Rules that calls as rare as those of the table can trip: six hours of cool-down, a week of idleness.
RULES = B.Rules(errors=0.4, slow=200.0, cooldown=21_600, idle=604_800)
_CALLS = "SELECT event_type || ':' || user_id AS k, epoch_us(ts) AS t, event_id AS o, value >= 10 AS ok, value AS v, {h} AS horizon FROM events{w}"
_CUTOFF = "(SELECT epoch_us(date_trunc('milliseconds', max(ts)) - INTERVAL '10 minutes') FROM events)"


@query("breaker_transitions", B.sql(RULES, _CALLS.format(h="(SELECT max(epoch_us(ts)) FROM events)", w=""), "k") + 'SELECT k AS key, c.moment AS "at", c.state, c.reason FROM g')
def breaker_transitions(spark, sf_dir):
    """Each change of each key's breaker: trips on errors or on the 95th percentile, cool-downs that end by themselves, probes."""
    e = events(spark, sf_dir).withColumn("key", F.concat_ws(":", "event_type", "user_id"))
    last = e.agg(F.unix_micros(F.max("ts")).alias("h")).first()["h"] or 0
    return B.transitions(e, ["key"], F.unix_micros("ts"), "event_id", F.col("ok"), "value", F.lit(last), RULES)


@query("stream_breaker_timers", B.sql(RULES, _CALLS.format(h=_CUTOFF, w=f" WHERE epoch_us(ts) <= {_CUTOFF}"), "k") + 'SELECT k AS key, c.moment AS "at", c.state, c.reason FROM g')
def stream_breaker_timers(spark, sf_dir):
    """The same from a stream, with event-time timers, as far as its watermark has come."""
    e = S.stream(spark, sf_dir).withColumn("key", F.concat_ws(":", "event_type", "user_id"))
    return SB.transitions(spark, e, ["key"], F.unix_micros("ts"), "event_id", F.expr(_OK), "value", RULES)


@query("cost_rollup", "SELECT user_id AS tenant, event_type AS feature, round(sum(value), 4) AS cost, count(*) AS n FROM events GROUP BY ROLLUP (user_id, event_type)")
def cost_rollup(spark, sf_dir):
    return events(spark, sf_dir).rollup(F.col("user_id").alias("tenant"), F.col("event_type").alias("feature")).agg(F.round(F.sum("value"), 4).alias("cost"), F.count("*").alias("n"))


@query("rate_limit", "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, count(*) > 3 AS limited FROM events GROUP BY 1, 2")
def rate_limit(spark, sf_dir):
    g = events(spark, sf_dir).groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))
    return g.withColumn("limited", F.col("n") > 3)


@query("budget_running_total", "SELECT event_id, round(sum(value) OVER w, 4) AS spent, sum(value) OVER w <= 500 AS within FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def budget_running_total(spark, sf_dir):
    return W.running_total(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 500).select("event_id", F.round("spent", 4).alias("spent"), "within")


@query("leaky_budget", "WITH w AS (SELECT *, epoch(ts - TIMESTAMP '2024-01-01') * 0.001::DOUBLE AS t, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS a FROM events), m AS (SELECT *, a - t - min(a - value - t) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS level FROM w) SELECT event_id, round(level, 3) AS level, level > 100 AS limited FROM m")
def leaky_budget(spark, sf_dir):
    """Token pacing: a bucket that leaks 0.001 a second."""
    at = F.unix_micros("ts") / 1e6 - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    return W.leaky_bucket(events(spark, sf_dir), ["user_id"], at, ["ts", "event_id"], "value", 0.001, 100).select("event_id", F.round("level", 3).alias("level"), "limited")


@query("provider_unhealthy", "WITH w AS (SELECT *, count(*) OVER w AS n, avg(CASE WHEN value >= 10 THEN 0.0 ELSE 1.0 END) OVER w AS error_rate, list_sort(list(value) OVER w) AS vs FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), p AS (SELECT *, vs[least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1] AS p95 FROM w) SELECT event_id, round(error_rate, 6) AS error_rate, p95, n >= 5 AND (error_rate >= 0.5 OR p95 > 90) AS trip FROM p")
def provider_unhealthy(spark, sf_dir):
    """Error rate and 95th percentile of a key's last 20 calls, and whether they open its breaker."""
    return W.unhealthy(events(spark, sf_dir), ["event_type", "user_id"], ["ts", "event_id"], F.col("ok"), "value").select("event_id", F.round("error_rate", 6).alias("error_rate"), "p95", "trip")


#: Each key's next outcome is a step of the recursion.
_IN_A_ROW = "WITH RECURSIVE ev AS (SELECT event_type, user_id, value >= 10 AS ok, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS i FROM events), s AS (SELECT DISTINCT event_type, user_id, 0::BIGINT AS i, 'closed' AS st, 0::BIGINT AS f, 0::BIGINT AS o FROM ev UNION ALL SELECT event_type, user_id, i, CASE WHEN now = 'open' OR opens THEN 'open' WHEN ok THEN 'closed' ELSE now END, CASE WHEN now = 'open' THEN f ELSE nf END, CASE WHEN opens THEN t ELSE o END FROM (SELECT *, now <> 'open' AND NOT ok AND (now = 'half_open' OR nf >= 3) AS opens FROM (SELECT s.event_type, s.user_id, ev.i, ev.ok, ev.t, s.f, s.o, CASE WHEN s.st = 'open' AND ev.t >= s.o + 600 THEN 'half_open' ELSE s.st END AS now, CASE WHEN ev.ok THEN 0 ELSE s.f + 1 END AS nf FROM s JOIN ev ON ev.event_type = s.event_type AND ev.user_id = s.user_id AND ev.i = s.i + 1))) SELECT event_type, user_id, st AS state, CAST(f AS INTEGER) AS failures FROM s QUALIFY i = max(i) OVER (PARTITION BY event_type, user_id)"


@query("breaker_state", _IN_A_ROW)
def breaker_state(spark, sf_dir):
    return W.breaker(events(spark, sf_dir), ["event_type", "user_id"], "event_id", F.col("ok"), F.unix_seconds("ts"))


@query("failover_order", "SELECT user_id, arg_min(event_type, event_id) FILTER (WHERE value >= 10) AS provider, count(*) FILTER (WHERE value < 10) AS failures FROM events GROUP BY 1")
def failover_order(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.min_by("event_type", F.when(F.col("ok"), F.col("event_id"))).alias("provider"), F.count_if(~F.col("ok")).alias("failures"))


@query("hedged_first", "SELECT user_id, day, arg_min(event_type, (value, event_id)) AS winner, min(value) AS latency FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP AS day FROM events) GROUP BY 1, 2")
def hedged_first(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.min_by("event_type", F.struct("value", "event_id")).alias("winner"), F.min("value").alias("latency"))


@query("backoff_schedule", "SELECT event_id, unnest([0, 1, 2, 3]) AS attempt, least(60.0, 1.5 * pow(2.0, unnest([0, 1, 2, 3])))::DOUBLE AS delay FROM events WHERE value < 10")
def backoff_schedule(spark, sf_dir):
    e = events(spark, sf_dir).where("not ok").select("event_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
    return e.withColumn("delay", W.backoff(F.col("attempt"), 1.5))


@query("backoff_jitter", "SELECT event_id, round(d * (0.5 + ('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':' || attempt), 1, 6))::BIGINT / 16777216.0::DOUBLE / 2), 6) AS delay, attempt FROM (SELECT event_id, attempt, least(60.0, 1.5 * pow(2.0, attempt))::DOUBLE AS d FROM events, (SELECT unnest([0, 1, 2, 3]) AS attempt) WHERE value < 10)")
def backoff_jitter(spark, sf_dir):
    e = events(spark, sf_dir).where("not ok").select("event_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
    return e.select("event_id", F.round(W.jittered(W.backoff(F.col("attempt"), 1.5), F.concat_ws(":", "event_id", "attempt")), 6).alias("delay"), "attempt")


_SPANS = "SELECT epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) AS e, event_type AS provider FROM events"


def _spans(spark, sf_dir):
    """Calls as spans of microseconds: each takes its value in minutes."""
    at = F.unix_micros("ts")
    return events(spark, sf_dir).select("event_id", "user_id", "ok", F.col("event_type").alias("provider"), at.alias("s"), (at + F.round(F.col("value") * 60_000_000).cast("long")).alias("e"))


@query("queue_depth", f"WITH p AS ({_SPANS}), d AS (SELECT provider, s AS t, 1 AS a, 0 AS l FROM p UNION ALL SELECT provider, e, 0, 1 FROM p), m AS (SELECT provider, t, sum(a)::BIGINT AS arrived, sum(l)::BIGINT AS left FROM d GROUP BY 1, 2) SELECT provider, t AS \"at\", arrived, \"left\", CAST(sum(arrived - \"left\") OVER (PARTITION BY provider ORDER BY t) AS BIGINT) AS depth FROM m")
def queue_depth(spark, sf_dir):
    """How many calls each provider has under way from each moment at which that changes."""
    return I.depth(_spans(spark, sf_dir), "s", "e", ["provider"])


@query("queue_timeline", f"WITH p AS ({_SPANS}), d AS (SELECT s AS t, 1 AS x FROM p UNION ALL SELECT e, -1 FROM p), m AS (SELECT t, sum(x) AS x FROM d GROUP BY 1), c AS (SELECT t, sum(x) OVER (ORDER BY t) AS depth FROM m) SELECT time_bucket(INTERVAL '1 day', make_timestamp(t))::TIMESTAMP AS day, CAST(max(depth) AS BIGINT) AS deepest, CAST(arg_max(depth, t) AS BIGINT) AS at_end FROM c GROUP BY 1")
def queue_timeline(spark, sf_dir):
    """The deepest queue of each day over all providers, and what the last change of the day left."""
    d = I.depth(_spans(spark, sf_dir), "s", "e")
    day = F.date_trunc("day", F.timestamp_micros("at")).cast("timestamp_ntz")
    return d.groupBy(day.alias("day")).agg(F.max("depth").alias("deepest"), F.max_by("depth", "at").alias("at_end"))


@query("breaker_timeline", B.sql(RULES, _CALLS.format(h="(SELECT max(epoch_us(ts)) FROM events)", w=""), "k") + ", tl AS (SELECT k, c.state AS state, c.moment AS f, lead(c.moment) OVER (PARTITION BY k ORDER BY c.moment) AS t FROM g) SELECT k AS key, state, count(*) AS times, CAST(sum(coalesce(t, (SELECT max(epoch_us(ts)) FROM events)) - f) AS BIGINT) AS micros FROM tl GROUP BY 1, 2")
def breaker_timeline(spark, sf_dir):
    """How often and how long each key's breaker was in each state after its first change."""
    e = events(spark, sf_dir).withColumn("key", F.concat_ws(":", "event_type", "user_id"))
    last = e.agg(F.unix_micros(F.max("ts")).alias("h")).first()["h"] or 0
    t = B.transitions(e, ["key"], F.unix_micros("ts"), "event_id", F.col("ok"), "value", F.lit(last), RULES)
    until = F.coalesce(F.lead("at").over(Window.partitionBy("key").orderBy("at")), F.lit(last))
    return t.withColumn("_for", until - F.col("at")).groupBy("key", "state").agg(F.count("*").alias("times"), F.sum("_for").alias("micros"))


@query("dashboard", f"WITH p AS ({_SPANS}), ds AS (SELECT provider, s AS t, 1 AS x FROM p UNION ALL SELECT provider, e, -1 FROM p), m AS (SELECT provider, t, sum(x) AS x FROM ds GROUP BY 1, 2), c AS (SELECT provider, t, sum(x) OVER (PARTITION BY provider ORDER BY t) AS depth FROM m), qd AS (SELECT provider, time_bucket(INTERVAL '1 day', make_timestamp(t))::TIMESTAMP AS day, max(depth) AS deepest FROM c GROUP BY 1, 2), lg AS (SELECT *, lag(value) OVER w AS before, lag(event_type) OVER w AS other FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), d AS (SELECT event_type AS provider, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS requests, avg(CASE WHEN value >= 10 THEN 0.0 ELSE 1.0 END) AS error_rate, list_sort(list(value))[least(count(*) - 1, CAST(floor(count(*) * 0.95) AS BIGINT)) + 1] AS p95, count(*) FILTER (WHERE value >= 10 AND before < 10 AND other <> event_type) AS failovers FROM lg GROUP BY 1, 2) SELECT provider, day, requests, round(requests / 86400.0::DOUBLE, 9) AS rps, round(error_rate, 6) AS error_rate, p95, failovers, CAST(deepest AS BIGINT) AS deepest FROM d JOIN qd USING (provider, day)")
def dashboard(spark, sf_dir):
    """Each provider's day: requests, their rate a second, errors, 95th percentile, calls that took over from another provider, deepest queue."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, sf_dir).withColumns({"_failed": ~F.lag("ok").over(order), "_other": F.lag("event_type").over(order)})
    took_over = F.coalesce(F.col("ok") & F.col("_failed") & (F.col("_other") != F.col("event_type")), F.lit(False))
    calls = e.groupBy(F.col("event_type").alias("provider"), day).agg(F.count("*").alias("requests"), F.avg((~F.col("ok")).cast("double")).alias("error_rate"), F.count_if(took_over).alias("failovers"))
    slow = Q.exact(events(spark, sf_dir).select(F.col("event_type").alias("provider"), day, "value"), ["provider", "day"], "value", [0.95]).select("provider", "day", F.col("value").alias("p95"))
    moment = F.date_trunc("day", F.timestamp_micros("at")).cast("timestamp_ntz").alias("day")
    deep = I.depth(_spans(spark, sf_dir), "s", "e", ["provider"]).groupBy("provider", moment).agg(F.max("depth").alias("deepest"))
    every = calls.join(slow, ["provider", "day"]).join(deep, ["provider", "day"])
    return every.select("provider", "day", "requests", F.round(F.col("requests") / 86400.0, 9).alias("rps"), F.round("error_rate", 6).alias("error_rate"), "p95", "failovers", "deepest")


_RETRIES = "rt AS (SELECT event_id, epoch_us(ts) AS arrived, epoch_us(ts) + CAST(least(64, pow(2, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 8)) * 3600000000 AS BIGINT) AS due, value FROM events WHERE NOT value >= 10), rd AS (SELECT *, due + CAST(round(value * 60000000) AS BIGINT) AS done, (SELECT epoch_us(max(ts)) FROM events) AS h FROM rt)"


@query("deferred_queue", f"WITH {_RETRIES} SELECT event_id, due, CASE WHEN done <= h THEN 'done' WHEN due <= h THEN 'queued' ELSE 'deferred' END AS state FROM rd")
def deferred_queue(spark, sf_dir):
    """Failed calls put off by a back-off that doubles: which are done, queued or still deferred at the end of the table."""
    e = events(spark, sf_dir)
    last = e.agg(F.unix_micros(F.max("ts")).alias("h")).first()["h"] or 0
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) % 8
    due = F.unix_micros("ts") + (W.backoff(attempt, 1.0, 64.0) * 3_600_000_000).cast("long")
    rows = e.where("not ok").select("event_id", F.unix_micros("ts").alias("arrived"), due.alias("due"), "value").withColumn("done", F.col("due") + F.round(F.col("value") * 60_000_000).cast("long"))
    return I.states(rows, "arrived", "due", "done", F.lit(last)).select("event_id", "due", "state")


#: Tiers by what a call costs: the cheapest that is good enough, one up after a failure of the same user.
_TIERS = ("small", "medium", "large")


@query("model_tier", "WITH b AS (SELECT event_id, user_id, ts, CASE WHEN value < 20 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END AS base, coalesce(lag(value < 10) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS failed FROM events) SELECT event_id, ['small', 'medium', 'large'][least(2, base + CAST(failed AS INTEGER)) + 1] AS tier FROM b")
def model_tier(spark, sf_dir):
    """Which tier serves each call: by its size, one higher where the user's last call failed."""
    e = events(spark, sf_dir)
    base = F.when(F.col("value") < 20, 0).when(F.col("value") < 60, 1).otherwise(2)
    failed = F.coalesce(~F.lag("ok").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(False))
    return e.select("event_id", F.element_at(F.array(*map(F.lit, _TIERS)), F.least(F.lit(2), base + failed.cast("int")) + 1).alias("tier"))


@query("idempotent_dedup", "SELECT user_id, event_type, props, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3")
def idempotent_dedup(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id", "event_type", "props").agg(F.min("event_id").alias("event_id"))


@query("session_activity", "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts)::TIMESTAMP AS started, count(*) AS n FROM s GROUP BY user_id, sid")
def session_activity(spark, sf_dir):
    g = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@query("stage_timing", "SELECT user_id AS trace_id, round(sum(total), 4) AS total, arg_max(stage, (total, stage)) AS slowest FROM (SELECT user_id, event_type AS stage, sum(value) AS total FROM events GROUP BY 1, 2) GROUP BY 1")
def stage_timing(spark, sf_dir):
    s = events(spark, sf_dir).groupBy(F.col("user_id").alias("trace_id"), F.col("event_type").alias("stage")).agg(F.sum("value").alias("t"))
    return s.groupBy("trace_id").agg(F.round(F.sum("t"), 4).alias("total"), F.max_by("stage", F.struct("t", "stage")).alias("slowest"))


@query("stage_maps", "WITH s AS (SELECT user_id, event_type, round(sum(value), 4) AS v FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, '|' ORDER BY event_type) AS stages, max(v) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE v > 100) AS slow, round(sum(v), 4) AS total FROM s GROUP BY 1")
def stage_maps(spark, sf_dir):
    """Each trace's stages as a map from name to time, and what is read from it."""
    s = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("v"))
    m = s.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))  # as many entries as stages
    slow, total = F.map_filter("m", lambda k, v: v > 100), F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, v: a + v)
    return m.select("user_id", F.array_join(F.array_sort(F.map_keys("m")), "|").alias("stages"), F.try_element_at("m", F.lit("error")).alias("error"), F.size(slow).cast("long").alias("slow"), F.round(total, 4).alias("total"))


@query("cumulative_counters", "SELECT event_id, count(*) OVER w AS calls, count(*) FILTER (WHERE NOT value >= 10) OVER w AS failures, round(sum(value) OVER w, 4) AS spent FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def cumulative_counters(spark, sf_dir):
    """Calls, failures and cost of each tenant at each provider so far."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, sf_dir).select("event_id", F.count("*").over(w).alias("calls"), F.sum((~F.col("ok")).cast("long")).over(w).alias("failures"), F.round(F.sum("value").over(w), 4).alias("spent"))


@query("moving_estimate", "SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda e, v: greatest(200.0::DOUBLE, 0.7::DOUBLE * e + 0.3::DOUBLE * v), 1000.0::DOUBLE), 6) AS estimate FROM events GROUP BY 1")
def moving_estimate(spark, sf_dir):
    """0.7 old + 0.3 new, at least 200, over all calls of each user."""
    o = events(spark, sf_dir).select("user_id", "event_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("i"))
    rows = o.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("r"))
    return rows.select("user_id", F.round(F.aggregate("r", F.lit(1000.0), lambda e, x: F.greatest(F.lit(200.0), e * 0.7 + x["value"] * 0.3)), 6).alias("estimate"))


@query("stream_tumbling", _TUMBLE)
def stream_tumbling(spark, sf_dir):
    return _plain(S.drain(spark, W.health(S.stream(spark, sf_dir), "event_type", "ts", F.expr(_OK), "value"), "complete"))


@query("stream_sliding", _SLIDE)
def stream_sliding(spark, sf_dir):
    return _plain(S.drain(spark, W.health(S.stream(spark, sf_dir), "event_type", "ts", F.expr(_OK), "value", "1 hour", "30 minutes"), "complete"))


@query("stream_session", "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts)::TIMESTAMP AS started, count(*) AS n FROM s GROUP BY user_id, sid")
def stream_session(spark, sf_dir):
    s = S.stream(spark, sf_dir).groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return S.drain(spark, s.select("user_id", F.col("w.start").alias("started"), "n"), "complete").withColumn("started", F.col("started").cast("timestamp_ntz"))


@query("stream_dedup", "SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS day, user_id, event_type, props FROM events")
def stream_dedup(spark, sf_dir):
    """Requests of each day without repeats: a key counts once a day, however the stream is cut into batches, and leaves the state after it."""
    day = S.stream(spark, sf_dir).select(F.window("ts", "1 day").alias("day"), "user_id", "event_type", "props")
    return S.drain(spark, day.dropDuplicates(["day", "user_id", "event_type", "props"]).select(F.col("day.start").alias("day"), "user_id", "event_type", "props"), "append").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("stream_breaker", _IN_A_ROW)
def stream_breaker(spark, sf_dir):
    """Stateful twin of breaker_state."""
    return S.breaker(spark, S.stream(spark, sf_dir).withColumn("ok", F.expr(_OK)))
