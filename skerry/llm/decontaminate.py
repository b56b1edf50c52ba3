"""Benchmark decontamination by a prefix-filtered set join.

A window of an item is the set of its `gram`-word shingles. Its shingles are ordered by rarity in the corpus
(document occurrences counted over all texts), and only the prefix that a contained window must share is
joined: |S| - ceil(t |S|) + 1 shingles for a containment of t; here t is 1, so it is the rarest one. A hit
fixes the window's place in the text: the positional bound (it must begin in the text and end in it, which
also bounds its length) comes next, then the exact comparison of all words over the item-sized window.

The item side is broadcast, in blocks of about `block_windows` windows, whose size is thus known; a larger
benchmark takes more passes over the texts, each checkpointed, and one block is sent at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import repeats, vec
from .rest import packed

BLOCK_WINDOWS = 500_000


def item_words(text: str | None) -> list[bytes]:
    """Words of a text: digits, small letters (A-Z lower-cased) and all beyond ASCII."""
    buf = vec.lower_ascii(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8))
    starts, ends, _ = vec.word_places(buf, np.array([0, len(buf)]), vec.ALNUM)
    raw = buf.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


def _shingles(hashes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` words from each place on."""
    at = np.arange(max(0, len(hashes) - gram + 1))
    return vec.ranged(vec.prefix(hashes), at, at + gram)


def _hash(words: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return vec.word_hashes(buf, ends - [len(w) for w in words], ends)


class _Block:
    """Distinct windows of a block of items, with the items of each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int, gram: int):
        self.windows: list[tuple[bytes, ...]] = []
        self.items: list[list[str]] = []
        known: dict[tuple[bytes, ...], int] = {}
        for item, words in items:
            for i in range(max(1, len(words) - size + 1) if words else 0):
                w = tuple(words[i : i + size])
                k = known.setdefault(w, len(self.windows))
                if k == len(self.windows):
                    self.windows.append(w)
                    self.items.append([])
                if not self.items[k] or self.items[k][-1] != item:
                    self.items[k].append(item)
        self.grams = [min(gram, len(w)) for w in self.windows]
        self.hashes = [_hash(list(w)) for w in self.windows]
        self.shingles = [_shingles(h, g) for h, g in zip(self.hashes, self.grams)]


def _tokenize(batch_column):
    for row, buf, offsets in vec.text_chunks(batch_column):
        buf = vec.lower_ascii(buf)
        starts, ends, first = vec.word_places(buf, offsets, vec.ALNUM)
        yield row, buf, starts, ends, first, vec.word_hashes(buf, starts, ends)


def find_windows(docs: DataFrame, items: DataFrame, size: int = 10, gram: int = 3, block_windows: int = BLOCK_WINDOWS, keep: bool = False) -> DataFrame:
    """doc_id, n_words, hits and item_ids: spans of words inside occurrences of the items' windows.

    With `keep` the text and the other columns (as `rest`) are handed on.
    A window is `size` consecutive words of an item; an item of fewer, but not none, is one window. Null
    texts have no words; repeated rows and items count as they are; items with a null id are called "null";
    an empty benchmark hits nothing; other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([packed(docs)] if keep else []))
    found = whole.select(*whole.columns[:2], F.lit(0).cast("long").alias("n_words"), F.array().cast(_HITS).alias("hits"), F.array().cast("array<string>").alias("item_ids"), *whole.columns[2:])
    sent = None
    for block in _blocks(items, size, gram, block_windows):
        if sent is not None:  # a block is done with before the next is sent
            found = cut(found)
            sent.destroy()
        found, sent = _find(base, found, block)
    if sent is None:
        found, _ = _find(base, found, _Block([], size, gram))
    return found if keep else found.drop("text")


_HITS = "array<struct<start:int,end:int>>"


def _blocks(items: DataFrame, size: int, gram: int, limit: int):
    held: list[tuple[str, list[bytes]]] = []
    count = 0
    for row in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").toLocalIterator():
        words = item_words(row.text)
        held.append((row.item_id, words))
        count += max(1, len(words) - size + 1) if words else 0
        if count >= limit:
            yield _Block(held, size, gram)
            held, count = [], 0
    if held:
        yield _Block(held, size, gram)


def _find(base: DataFrame, found: DataFrame, block: _Block) -> tuple[DataFrame, Broadcast]:
    """One more block's hits, added to those found so far, and the broadcast that they need."""
    spark = base.sparkSession
    sizes = sorted(set(block.grams))
    every = {g: np.unique(np.concatenate([s for s, k in zip(block.shingles, block.grams) if k == g])) for g in sizes}
    sent = spark.sparkContext.broadcast(every)

    def count(batches):
        """How often each of the items' shingles occurs in the texts."""
        sums = {g: np.zeros(len(v), np.int64) for g, v in sent.value.items()}
        for batch in batches:
            for *_, hashes in _tokenize(batch.column(0)):
                for g, wanted in sent.value.items():
                    mine = _shingles(hashes, g)
                    at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
                    sums[g] += np.bincount(at[wanted[at] == mine], minlength=len(wanted))
        for g, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), g, np.int32)), pa.array(some), pa.array(n[some])], ["g", "i", "n"])

    often = {g: np.zeros(len(v), np.int64) for g, v in every.items()}
    if every:
        for r in base.select("text").mapInArrow(count, "g int, i long, n long").groupBy("g", "i").agg(F.sum("n").alias("n")).collect():  # bounded by the block
            often[r.g][r.i] = r.n
    sent.destroy()
    prefix: dict[int, list[tuple[int, int, int]]] = {g: [] for g in sizes}
    for k, (shingles, g) in enumerate(zip(block.shingles, block.grams)):
        seen = often[g][np.searchsorted(every[g], shingles)]
        i = int(np.lexsort((shingles, seen))[0])
        if seen[i]:  # else a shingle that no text has: the window is in none
            prefix[g].append((int(shingles[i]), k, i))
    table = {}
    for g, rows in prefix.items():
        if rows:
            rows.sort()
            table[g] = tuple(np.array(c, t) for c, t in zip(zip(*rows), (np.uint64, np.int64, np.int64)))
    lengths = np.array([len(w) for w in block.windows], np.int64)
    lookup = spark.sparkContext.broadcast((table, block.hashes, block.windows, block.items, lengths))

    names = found.columns

    def join(batches):
        table, hashed, windows, items, lengths = lookup.value
        for batch in batches:
            ids = batch.column(0)
            for row, buf, starts, ends, first, hashes in _tokenize(batch.column(1)):
                n = len(first) - 1
                hits: list[list[dict]] = batch.column(3).slice(row, n).to_pylist()
                which: list[set[str]] = [set(x) for x in batch.column(4).slice(row, n).to_pylist()]
                raw = None
                for g, (keys, window, offset) in table.items():
                    mine = _shingles(hashes, g)
                    low = np.searchsorted(keys, mine)
                    place = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == mine)
                    for p in place.tolist():
                        doc = int(np.searchsorted(first, p, side="right")) - 1
                        k = int(low[p])
                        while k < len(keys) and keys[k] == mine[p]:
                            w, begin = int(window[k]), p - int(offset[k])
                            stop = begin + int(lengths[w])
                            k += 1
                            if begin < first[doc] or stop > first[doc + 1] or not np.array_equal(hashes[begin:stop], hashed[w]):
                                continue
                            raw = raw if raw is not None else buf.tobytes()
                            if tuple(raw[s:e] for s, e in zip(starts[begin:stop].tolist(), ends[begin:stop].tolist())) == windows[w]:
                                hits[doc].append({"start": begin - int(first[doc]), "end": stop - int(first[doc])})
                                which[doc].update(items[w])
                spans = [[{"start": s, "end": e} for s, e in repeats.runs([{"starts": [0], "lo": [x["start"] for x in h], "hi": [x["end"] for x in h]}] if h else None, 1 << 30)] for h in hits]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, n), batch.column(1).slice(row, n), pa.array(np.diff(first)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([sorted(w) for w in which], pa.list_(pa.string())), *(batch.column(c).slice(row, n) for c in range(5, batch.num_columns))],
                    names,
                )

    return found.mapInArrow(join, found.schema), lookup


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, of find_windows()."""
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"]).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
