"""Model providers, and work that calls them: a batch at a time, resumable, inside tasks.

Nothing here reaches a network. A provider is any picklable object with the methods of Provider; each task
calls it with the texts of one batch, and retries what fails. StubProvider answers from the text alone.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import pending


class Provider(Protocol):
    """What a model has to offer; answers come in the order of the texts."""

    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def complete(self, prompts: list[str]) -> list[str]: ...


class StubProvider:
    """Unit vectors and answers that a text's digest decides; `fails` are texts that it can't do."""

    name = "stub"

    def __init__(self, dim: int = 16, fails: tuple[str, ...] = ()):
        self.dim, self.fails = dim, fails

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            if text in self.fails:
                raise ValueError(f"can't embed {text!r}")
            raw = hashlib.shake_128(text.encode()).digest(2 * self.dim)
            x = [int.from_bytes(raw[i : i + 2], "big") / 32767.5 - 1 for i in range(0, len(raw), 2)]
            size = sum(v * v for v in x) ** 0.5 or 1.0
            out.append([v / size for v in x])
        return out

    def complete(self, prompts: list[str]) -> list[str]:
        return [hashlib.sha256(p.encode()).hexdigest() for p in prompts]


class RuleExtractor:
    """Payloads by a rule: each prompt's names, words that begin with a capital, are companies, each of which supplies the next; `fails` are words that it gives up on."""

    name = "rules"

    def __init__(self, fails: tuple[str, ...] = ()):
        self.fails = fails

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError("rules don't embed")

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            if any(f in prompt for f in self.fails):
                raise ValueError("gave up")
            names = re.findall(r"\b[A-Z]\w*(?:#\w+)?", prompt)
            out.append(json.dumps({"entities": [{"name": n, "type": "Company", "confidence": 0.5} for n in names], "relations": [{"source": a, "type": "PARTNERED_WITH", "target": b} for a, b in zip(names, names[1:])]}))
        return out


def _asked(call, texts: list[str], attempts: int, wait: float) -> list[tuple]:
    """(answer, error) of each text: a batch that fails is asked again with waits that double, and then text by text, so one bad text costs no other."""
    error = ""
    for n in range(attempts):
        try:
            return [(v, None) for v in call(texts)]
        except Exception as e:  # whatever a provider raises is that batch's result
            error = str(e)
            time.sleep(wait * 2**n)
    return [(None, error)] if len(texts) == 1 else [x for t in texts for x in _asked(call, [t], attempts, wait)]


def completed(items: DataFrame, provider: Provider, key: str, text: str, attempts: int = 3, wait: float = 0.0) -> DataFrame:
    """key, answer, error: what the model answers to each text, or why there is no answer."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            got = _asked(provider.complete, [t or "" for t in batch[text].tolist()], attempts, wait) if len(batch) else []
            yield pd.DataFrame({key: batch[key], "answer": [v for v, _ in got], "error": [e for _, e in got]})

    return items.select(key, text).mapInPandas(run, f"`{key}` {dict(items.dtypes)[key]}, answer string, error string")


def embedded(items: DataFrame, provider: Provider, key: str, text: str, attempts: int = 3, wait: float = 0.0) -> DataFrame:
    """key, embedding, error: each text's vector, or why there is none."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            got = _asked(provider.embed, [t or "" for t in batch[text].tolist()], attempts, wait) if len(batch) else []
            yield pd.DataFrame({key: batch[key], "embedding": [v for v, _ in got], "error": [e for _, e in got]})

    kind = dict(items.dtypes)[key]
    return items.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<double>, error string")


def backfill(spark: SparkSession, items: DataFrame, provider: Provider, key: str, text: str, done: str, failed: str, batch: int = 100_000, rounds: int | None = None, work=embedded) -> int:
    """Embed (or do other `work`, as completed() does) what the table at `done` lacks, `batch` items a round in key order, each round appended at once; returns the rounds.

    Failures go to `failed` and aren't asked again. A job that dies has lost one round at most; the next call goes on.
    """
    n = 0
    while rounds is None or n < rounds:
        todo = items
        for path in (done, failed):
            there = _stored(spark, path)
            if there is not None:
                todo = pending(todo, there, [key])
        some = todo.orderBy(key).limit(batch)
        if some.isEmpty():
            break
        got = work(some, provider, key, text).withColumn("model", F.lit(provider.name)).persist()
        try:
            got.where("error is null").drop("error").write.mode("append").parquet(done)
            got.where("error is not null").select(key, "error", "model").write.mode("append").parquet(failed)
        finally:
            got.unpersist()
        n += 1
    return n


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(where) else None
