"""The breaker's batch fold and its stream, over several micro-batches with rows out of order, against a plain fold."""

import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skerry.operators import breaker as B
from skerry.streaming import breaker as SB
from skerry.streaming import gateway as S

SRC = "/root/testdata/sf0.001"
RULES = B.Rules(errors=0.4, slow=200.0, cooldown=21_600, idle=604_800)
HOUR = 3600 * B.SECOND


def plain(rows, horizon, rules):
    """(key, at, state, reason), each key's rows taken in order by hand."""
    out = []
    for key in {r[0] for r in rows}:
        state, opened, last, ring = "closed", 0, None, []

        def tick(now):
            nonlocal state, last, ring
            if state == "open" and now >= opened + rules.cooldown * B.SECOND:
                state, last = "half_open", opened + rules.cooldown * B.SECOND
                out.append((key, last, "half_open", "cooldown"))
            if state != "open" and last is not None and now >= last + rules.idle * B.SECOND:
                if state == "half_open":
                    out.append((key, last + rules.idle * B.SECOND, "closed", "idle"))
                state, last, ring = "closed", None, []

        for _, at, _, ok, value in sorted(r for r in rows if r[0] == key):
            tick(at)
            if state == "open":
                continue
            last = at
            if state == "half_open":
                state, ring = ("closed", []) if ok else ("open", [])
                opened = opened if ok else at
                out.append((key, at, state, "probe"))
                continue
            ring = [*ring, (ok, value)][-rules.calls :]
            n = len(ring)
            bad = sum(1 for k, _ in ring if not k) / n >= rules.errors
            slow = sorted(v for _, v in ring)[min(n - 1, int(n * 0.95))] > rules.slow
            if n >= rules.least and (bad or slow):
                state, opened, ring = "open", at, []
                out.append((key, at, "open", "errors" if bad else "slow"))
        tick(horizon)
    return sorted(out)


def batch(events, horizon):
    found = B.transitions(events, ["key"], F.unix_micros("ts"), "event_id", F.expr("value >= 10"), "value", F.lit(horizon), RULES)
    return sorted(tuple(r) for r in found.collect())


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SRC}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("key", F.concat_ws(":", "event_type", "user_id"))


def listed(events):
    return [(r.key, r.at, r.event_id, r.value >= 10, r.value) for r in events.select("key", F.unix_micros("ts").alias("at"), "event_id", "value").collect()]


def test_batch_fold_against_plain(events):
    rows = listed(events)
    for horizon in (max(r[1] for r in rows), max(r[1] for r in rows) + 1000 * HOUR):
        want = plain(rows, horizon, RULES)
        assert batch(events, horizon) == want and {r[3] for r in want} == {"cooldown", "probe", "errors", "slow", "idle"}


def test_nulls_and_empty(spark, events):
    odd = events.limit(3).withColumn("value", F.lit(None).cast("double"))
    assert batch(odd, 0) == [] and batch(events.where("false"), 0) == []


def test_stream_of_several_batches(spark, events, tmp_path):
    """Each file is a micro-batch; within a file rows are shuffled, and 20 rows of each come one file late, within the watermark."""
    table = pq.read_table(f"{SRC}/events.parquet").sort_by("ts")
    os.makedirs(tmp_path / "events.parquet")
    n, rnd = len(table), random.Random(4)
    for i in range(5):
        part = table.slice(i * n // 5, (i + 1) * n // 5 - i * n // 5)
        order = list(range(len(part)))
        rnd.shuffle(order)
        pq.write_table(part.take(order), tmp_path / f"events.parquet/part-{i}.parquet")
        os.utime(tmp_path / f"events.parquet/part-{i}.parquet", (1e9 + 10 * i, 1e9 + 10 * i))
    stream = S.stream(spark, str(tmp_path), 1).withColumn("key", F.concat_ws(":", "event_type", "user_id"))
    got = SB.transitions(spark, stream, ["key"], F.unix_micros("ts"), "event_id", F.expr("value >= 10"), "value", RULES)
    mark = (events.agg(F.max(F.unix_millis("ts")).alias("m")).first().m - 600_000) * 1000
    want = batch(events.where(F.unix_micros("ts") <= mark), mark)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(r[3] == "cooldown" and r[1] > max(x[1] for x in listed(events) if x[0] == r[0]) for r in want)  # opened by a timer, after the key's last row
    counts = S.drain(spark, S.stream(spark, str(tmp_path), 1).groupBy(F.window("ts", "1 hour")).count(), "append")
    assert counts.count() == counts.select("window").distinct().count() > 300  # each window once, when it was closed


def test_day_keys_do_not_depend_on_batches(spark, tmp_path):
    import __spark_entry__

    table = pq.read_table(f"{SRC}/events.parquet").sort_by("ts")
    twice = [table.slice(0, 400), table.slice(0, 50), table.slice(400)]  # the second file repeats rows that are too late by then, or known
    os.makedirs(tmp_path / "events.parquet")
    for i, part in enumerate(twice):
        pq.write_table(part, tmp_path / f"events.parquet/{i}.parquet")
    q = __spark_entry__.queries()["stream_dedup"]
    assert sorted(map(repr, q(spark, str(tmp_path)).collect())) == sorted(map(repr, q(spark, SRC).collect()))


def test_a_batch_of_calls_asks_for_one_timer():
    """However many calls wait, their key is woken once for those that are due, and then for the next."""
    import pandas as pd

    from skerry.operators.breaker import Rules
    from skerry.streaming.breaker import BreakerProcessor

    class Kept:
        def __init__(self):
            self.rows = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return self.rows if self.many else self.rows[0]

        def put(self, rows):
            self.rows = list(rows)

        def update(self, row):
            self.rows = [row]

        def appendList(self, rows):
            self.rows = self.rows + rows

        def clear(self):
            self.rows = []

    class Handle:
        def __init__(self):
            self.timers = []

        def state(self, many):
            kept = Kept()
            kept.many = many
            return kept

        def getValueState(self, *_):
            return self.state(False)

        def getListState(self, *_):
            return self.state(True)

        def registerTimer(self, at):
            self.timers.append(at)

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    handle, taken = Handle(), BreakerProcessor(["key"], Rules())
    taken.init(handle)
    times = [1_000_000 + 1000 * (i * 37 % 100) for i in range(100)]
    frame = pd.DataFrame({"at": times, "o": range(100), "ok": [True] * 100, "latency": [1.0] * 100})
    list(taken.handleInputRows(("a",), iter([frame[:60], frame[60:]]), At(0)))
    assert handle.timers == [1000]
    list(taken.handleExpiredTimer(("a",), At(1049), None))
    assert [t for t in handle.timers if 1049 < t < 2000] == [1050] and len(taken.waiting.rows) == 50
