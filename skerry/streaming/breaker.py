"""The circuit breaker of operators.breaker over a stream, in event time.

Rows wait in a list state until the watermark has passed them and are then taken in order, so lateness within the
watermark changes nothing. A cool-down ends by a timer, whether or not a call comes; another forgets idle keys.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.breaker import Breaker, Rules
from .gateway import drain

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BreakerProcessor(StatefulProcessor):
    """Keeps a machine, its ring and the rows to come for each key."""

    def __init__(self, by: list[str], rules: Rules) -> None:
        self.by, self.rules = by, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "state string, opened long, last long")
        self.ring = handle.getListState("ring", "ok boolean, latency double")
        self.waiting = handle.getListState("waiting", "at long, o long, ok boolean, latency double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        first = None
        for part in rows:
            got = list(zip(part["at"].tolist(), part["o"].tolist(), part["ok"].tolist(), part["latency"].tolist()))
            self.waiting.appendList([(int(a), int(o), bool(k), float(v)) for a, o, k, v in got])
            first = min((int(a) for a, *_ in got if first is None or a < first), default=first)
        if first is not None:  # one timer for all rows: those that it finds too early get the next one
            self.handle.registerTimer(-(-first // 1000))
        return iter([pd.DataFrame()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= now]
        machine = self._load()
        before, told = machine.due(), []
        for at, _, ok, latency in ready:
            told += machine.outcome(at, ok, latency)
        told += machine.advance(now)
        if ready:
            if len(ready) < len(rows):
                self.waiting.put(rows[len(ready) :])
                self.handle.registerTimer(-(-rows[len(ready)][0] // 1000))
            else:
                self.waiting.clear()
        self._save(machine)
        due = machine.due()
        if due is not None and (ready or due != before):
            self.handle.registerTimer(-(-due // 1000))
        yield pd.DataFrame([(*key, *t) for t in told], columns=[*self.by, "at", "state", "reason"]) if told else pd.DataFrame()

    def _load(self) -> Breaker:
        if not self.machine.exists():
            return Breaker(self.rules)
        state, opened, last = self.machine.get()
        ring = [(bool(k), float(v)) for k, v in self.ring.get()] if self.ring.exists() else []
        return Breaker(self.rules, state, opened, last, ring)

    def _save(self, machine: Breaker) -> None:
        if machine.last is None and machine.state == "closed":  # forgotten: no row of the key stays
            self.machine.clear()
            self.ring.clear()
            return
        self.machine.update((machine.state, machine.opened, machine.last))
        if machine.ring:
            self.ring.put(machine.ring)
        else:
            self.ring.clear()

    def close(self) -> None:
        pass


def transitions(spark: SparkSession, events: DataFrame, by: list[str], at: Column, order: str, ok: Column, latency: str, rules: Rules = Rules()) -> DataFrame:
    """by, at, state and reason of each change until the watermark, drained from a stream that has one; rows and times are those of operators.breaker.transitions."""
    kinds = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in by)
    rows = events.select(*by, "ts", at.cast("long").alias("at"), F.col(order).cast("long").alias("o"), ok.alias("ok"), F.col(latency).cast("double").alias("latency"))
    rows = rows.where("at is not null and ok is not null and latency is not null")
    out = rows.groupBy(*by).transformWithStateInPandas(BreakerProcessor(by, rules), f"{kinds}, at long, state string, reason string", "append", "EventTime")
    kept = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)  # the store that timers and list states need
    try:
        return drain(spark, out, "append")
    finally:
        spark.conf.set(_STORE, kept)
