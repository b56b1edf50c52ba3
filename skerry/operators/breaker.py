"""Circuit breaker on error rate and latency, as one machine that a batch fold and a stream share.

A closed breaker keeps a ring of its key's last outcomes and opens when too many failed or their 95th percentile is
too slow. An open one rejects calls until its cool-down ends, which needs no call to happen: from then on it is half
open, and the next call is its probe. A key of which nothing was seen for `idle` is forgotten. Times are microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000


class Rules(NamedTuple):
    """Calls in the ring and the least of them that decide; share of errors and seconds (of latency's unit) that open; seconds of cool-down and of idleness."""

    calls: int = 20
    least: int = 5
    errors: float = 0.5
    slow: float = 90.0
    cooldown: int = 600
    idle: int = 86_400


@dataclass
class Breaker:
    """State of one key; `ring` holds (ok, latency)."""

    rules: Rules
    state: str = "closed"
    opened: int = 0
    last: int | None = None
    ring: list[tuple[bool, float]] = field(default_factory=list)

    def due(self) -> int | None:
        """When time alone changes the state next."""
        if self.state == "open":
            return self.opened + self.rules.cooldown * SECOND
        return None if self.last is None else self.last + self.rules.idle * SECOND

    def advance(self, now: int) -> Iterator[tuple[int, str, str]]:
        """What time has changed until `now`: (at, state, reason)."""
        while (at := self.due()) is not None and at <= now:
            if self.state == "open":
                self.state, self.last = "half_open", at
                yield at, "half_open", "cooldown"
            else:
                probing = self.state != "closed"
                self.state, self.last, self.ring = "closed", None, []
                if probing:
                    yield at, "closed", "idle"

    def outcome(self, at: int, ok: bool, latency: float) -> Iterator[tuple[int, str, str]]:
        """What an outcome changes, and what time has until then."""
        yield from self.advance(at)
        if self.state == "open":
            return
        self.last = at
        if self.state == "half_open":
            self.ring = []
            self.state = "closed" if ok else "open"
            self.opened = self.opened if ok else at
            yield at, self.state, "probe"
            return
        self.ring = [*self.ring, (ok, latency)][-self.rules.calls :]
        n = len(self.ring)
        if n < self.rules.least:
            return
        reason = None
        if sum(not k for k, _ in self.ring) >= self.rules.errors * n:
            reason = "errors"
        elif sorted(v for _, v in self.ring)[min(n - 1, int(n * 0.95))] > self.rules.slow:
            reason = "slow"
        if reason:
            self.state, self.opened, self.ring = "open", at, []
            yield at, "open", reason


_SCHEMA = "at long, state string, reason string"


def transitions(events: DataFrame, by: list[str], at: Column, order: str, ok: Column, latency: str, horizon: Column, rules: Rules = Rules()) -> DataFrame:
    """by, at, state and reason of each change of each key's breaker until `horizon`.

    Rows are sorted by key, time and `order` and stream past one machine at a time, so a key of any number of rows
    takes the memory of its ring. `horizon` is a constant column; rows with a null time, outcome or latency are left out.
    """
    kinds = [(c, events.schema[c].dataType) for c in by]
    rows = events.select(*by, at.cast("long").alias("_at"), F.col(order).alias("_order"), ok.alias("_ok"), F.col(latency).cast("double").alias("_latency"), horizon.cast("long").alias("_horizon"))
    rows = rows.where("_at is not null and _ok is not null and _latency is not null").repartition(*by).sortWithinPartitions(*by, "_at", "_order")

    def run(batches):
        key = machine = until = None
        keys: list[tuple] = []
        found: list[tuple[int, str, str]] = []

        def told(changes) -> None:
            for change in changes:
                keys.append(key)
                found.append(change)

        def out(types) -> pa.RecordBatch:
            ks, cs = list(zip(*keys)) or [()] * len(by), list(zip(*found)) or [()] * 3
            batch = pa.RecordBatch.from_arrays([*(pa.array(k, t) for k, t in zip(ks, types)), pa.array(cs[0], pa.int64()), pa.array(cs[1], pa.string()), pa.array(cs[2], pa.string())], [*by, "at", "state", "reason"])
            keys.clear()
            found.clear()
            return batch

        types = None
        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            cols = [c.to_pylist() for c in batch.columns]
            for *this, t, _, good, value, horizon_at in zip(*cols):
                if tuple(this) != key:
                    if machine:
                        told(machine.advance(until))
                    key, machine, until = tuple(this), Breaker(rules), horizon_at
                told(machine.outcome(t, good, value))
            yield out(types)
        if machine:
            told(machine.advance(until))
            yield out(types)

    schema = ", ".join([*(f"`{c}` {t.simpleString()}" for c, t in kinds), _SCHEMA])
    return rows.mapInArrow(run, schema)


def sql(rules: Rules, events: str, key: str) -> str:
    """SQL of transitions() over a table expression (key, t, o, ok, v, horizon), a step of a recursion for each key's next row."""
    r = rules
    return f"""
WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY t, o) AS i FROM ({events})),
s AS (SELECT DISTINCT {key}, 0::BIGINT AS i, 'closed' AS st, 0::BIGINT AS opened, NULL::BIGINT AS last, []::DOUBLE[] AS vs, []::BOOLEAN[] AS oks, []::STRUCT(moment BIGINT, state VARCHAR, reason VARCHAR)[] AS told, 0::BIGINT AS horizon FROM ev
UNION ALL
SELECT {key}, i, CASE WHEN trip IS NOT NULL THEN 'open' WHEN st2 = 'half_open' THEN CASE WHEN ok THEN 'closed' ELSE 'open' END ELSE st2 END,
    CASE WHEN trip IS NOT NULL OR (st2 = 'half_open' AND NOT ok) THEN t ELSE opened END, CASE WHEN st2 = 'open' THEN last2 ELSE t END,
    CASE WHEN trip IS NOT NULL OR st2 <> 'closed' THEN [] ELSE vs3 END, CASE WHEN trip IS NOT NULL OR st2 <> 'closed' THEN [] ELSE oks3 END,
    told2 || CASE WHEN trip IS NOT NULL THEN [{{'moment': t, 'state': 'open', 'reason': trip}}] WHEN st2 = 'half_open' THEN [{{'moment': t, 'state': CASE WHEN ok THEN 'closed' ELSE 'open' END, 'reason': 'probe'}}] ELSE [] END, horizon
FROM (SELECT *, CASE WHEN st2 <> 'closed' OR len(vs3) < {r.least} THEN NULL WHEN len(list_filter(oks3, lambda x: NOT x)) >= {r.errors}::DOUBLE * len(oks3) THEN 'errors'
        WHEN list_sort(vs3)[least(len(vs3) - 1, CAST(floor(len(vs3) * 0.95) AS BIGINT)) + 1] > {r.slow} THEN 'slow' END AS trip
  FROM (SELECT *, CASE WHEN idle THEN 'closed' ELSE st1 END AS st2, CASE WHEN idle THEN NULL ELSE last1 END AS last2,
        CASE WHEN idle THEN [v] ELSE (vs || [v])[-{r.calls}:] END AS vs3, CASE WHEN idle THEN [ok] ELSE (oks || [ok])[-{r.calls}:] END AS oks3,
        CASE WHEN half THEN [{{'moment': last1, 'state': 'half_open', 'reason': 'cooldown'}}] ELSE [] END || CASE WHEN idle AND st1 <> 'closed' THEN [{{'moment': last1 + {r.idle * SECOND}, 'state': 'closed', 'reason': 'idle'}}] ELSE [] END AS told2
    FROM (SELECT *, st1 <> 'open' AND last1 IS NOT NULL AND t >= last1 + {r.idle * SECOND} AS idle
      FROM (SELECT *, CASE WHEN half THEN 'half_open' ELSE st END AS st1, CASE WHEN half THEN opened + {r.cooldown * SECOND} ELSE last END AS last1
        FROM (SELECT s.{key}, ev.i, s.st, s.opened, s.last, s.vs, s.oks, ev.t, ev.ok, ev.v, ev.horizon, s.st = 'open' AND ev.t >= s.opened + {r.cooldown * SECOND} AS half
          FROM s JOIN ev ON ev.{key} = s.{key} AND ev.i = s.i + 1)))))),
f AS (SELECT *, st = 'open' AND horizon >= opened + {r.cooldown * SECOND} AS half FROM s QUALIFY i = max(i) OVER (PARTITION BY {key})),
g AS (SELECT {key}, unnest(told) AS c FROM s
  UNION ALL SELECT {key}, {{'moment': opened + {r.cooldown * SECOND}, 'state': 'half_open', 'reason': 'cooldown'}} FROM f WHERE half
  UNION ALL SELECT {key}, {{'moment': CASE WHEN half THEN opened + {(r.cooldown + r.idle) * SECOND} ELSE last + {r.idle * SECOND} END, 'state': 'closed', 'reason': 'idle'}} FROM f
    WHERE (half AND horizon >= opened + {(r.cooldown + r.idle) * SECOND}) OR (st = 'half_open' AND horizon >= last + {r.idle * SECOND}))
"""
