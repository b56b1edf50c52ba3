"""Where a corpus repeats itself: the part that byte-wise and word-wise removal share.

All windows of `window` units (bytes, or words) of all strings are assigned to winnowed anchors, which depend
on the window's content alone (vec.anchors). Equal windows have equal anchors, so windows whose anchor occurs
once in the corpus repeat nowhere, and the rest need only be compared within their anchor's group. Members of
a group that agree in all units their windows cover are one `context`, told apart by a keyed digest, and the
units of one member of each context go to the operator's own method, a group at a time, with the number of
members; what it finds goes back to them all. A group of more than `bound` units is never brought together:
its contexts are strings for the same steps again, with a longer piece as anchor, up to the whole window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, stored
from . import vec
from .rest import packed

#: Sorts before all doc_ids: stands for a null one.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """(d, key, doc_id, text, rest): rows of one doc_id and one text share a key and are treated alike."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text", packed(docs))


def units_of(buf: np.ndarray, offsets: np.ndarray, by_word: bool) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Unit hashes of a chunk of texts, where each text's units begin, their bytes (words joined by a space), and where each unit begins and ends there."""
    if by_word:
        starts, ends, first = vec.word_places(buf, offsets, vec.NOT_SPACE)
        return vec.word_hashes(buf, starts, ends), first, *vec.joined(buf, starts, ends)
    at = np.arange(len(buf) + 1)
    return vec.BYTE[buf], offsets, buf.tobytes(), at[:-1], at[1:]


def _anchors(strings: DataFrame, by_word: bool, window: int, gram: int) -> DataFrame:
    """(anchor, n): how often each occurs in a batch."""

    def run(batches):
        for batch in batches:
            weight = batch.column(1).to_numpy()
            found, counts = [], []
            for row, buf, offsets in vec.text_chunks(batch.column(0)):
                text, anchor, *_ = vec.anchors(*units_of(buf, offsets, by_word)[:2], window, gram)
                found.append(anchor)
                counts.append(weight[row + text])
            if found:
                anchor, at = np.unique(np.concatenate(found), return_inverse=True)
                n = np.bincount(at, np.concatenate(counts), len(anchor)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return strings.select("text", "c").mapInArrow(run, "anchor long, n long")


def _members(strings: DataFrame, by_word: bool, window: int, gram: int, bits: np.ndarray) -> DataFrame:
    """A row for each context in each string whose anchor may be in the bitmap; `held` is its number of windows and then all its starts there, in order."""
    sent = strings.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            own = [batch.column(i).to_numpy() for i in range(4)]
            for row, buf, offsets in vec.text_chunks(batch.column(4)):
                units, first, data, lo, hi = units_of(buf, offsets, by_word)
                found = vec.anchors(units, first, window, gram)
                some = _in_bits(sent.value, found[1])
                text, anchor, start, n, begin = (x[some] for x in found)
                context = vec.digests(data, lo[begin], hi[begin + n + window - 2])
                order = np.lexsort((start, context, anchor, text))
                text, anchor, context, start, n = (x[order] for x in (text, anchor, context, start, n))
                new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])])) if len(text) else order
                held = pa.ListArray.from_arrays(pa.array(np.append(new, len(text)) + np.arange(len(new) + 1), pa.int32()), pa.array(np.insert(start, new, n[new]), pa.int32()))
                of = row + text[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[new].view(np.int64)), pa.array(context[new]), *(pa.array(x[of]) for x in own), held],
                    ["anchor", "context", "d", "key", "start", "c", "held"],
                )

    return strings.select("d", "key", "start", "c", "text").mapInArrow(run, "anchor long, context long, d long, key long, start int, c long, held array<int>")


#: log2 of the bits that key_bits() has at least and at most (16 MB).
BITS = (16, 27)


def key_bits(rows: DataFrame) -> np.ndarray:
    """A bitmap of the rows' keys, by their upper bits: 64 bits a row, within BITS. A full one lets all texts pass, which costs a shuffle of them and nothing else."""
    bits = min(max(BITS[0], (64 * rows.count()).bit_length()), BITS[1])
    words = rows.select(F.expr(f"shiftrightunsigned(key, {64 - bits})").alias("b")).groupBy(F.expr("shiftright(b, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("m"))
    got = words.toArrow()  # 2^(bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out


def _in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) >> np.uint64(65 - (64 * len(bits)).bit_length())
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def picked(base: DataFrame, bits: np.ndarray, inside: bool, of: int = 1) -> DataFrame:
    """Rows, of keyed() or with the key as column `of`, whose key may be in the bitmap, or surely isn't: so no text is shuffled in vain."""
    sent = base.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            hit = _in_bits(sent.value, batch.column(of).to_numpy())
            yield batch.filter(pa.array(hit if inside else ~hit))

    return base.mapInArrow(run, base.schema)


#: Units [s + lo, s + hi) for each of the starts s and each pair of lo and hi.
MARKS = "array<struct<starts:array<int>,lo:array<int>,hi:array<int>>>"


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text, marks (null where none) and the other columns as `rest` of all documents; only texts that may have spans are shuffled."""
    base, bits = keyed(docs), key_bits(spans)
    some = picked(base, bits, True).join(spans, ["d", "key"], "left").select("doc_id", "text", "marks", "rest")
    none = picked(base, bits, False).select("doc_id", "text", F.lit(None).cast(MARKS).alias("marks"), "rest")
    return some.unionByName(none)


class Context(NamedTuple):
    """One of a group's contexts: the earliest place it has, how many members, and their units as bytes, words joined by a space."""

    anchor: int
    context: int
    d: int
    place: int
    key: int
    c: int
    units: bytes


#: Spans (lo, hi) of a context's units that repeat: as its first member has it, and as the others have it.
Spans = tuple[list[tuple[int, int]], list[tuple[int, int]]]
#: Gets whole groups, ordered by anchor, d and place.
Method = Callable[[list[Context]], list[Spans]]


def repeated_spans(docs: DataFrame, by_word: bool, window: int, gram: int, method: Method, keep_first: bool, bound: int, batch_bytes: int = 1 << 18) -> DataFrame:
    """(d, key, marks): for each text with any, the units covered by repeated windows.

    With keep_first a window counts only if it starts earlier elsewhere, by (d, start); else if it starts
    elsewhere at all. `bound` is what a task may hold of one group, in units.
    """
    strings = keyed(docs).select("d", "key", F.lit(0).alias("start"), F.lit(1).cast("long").alias("c"), "text")
    return _resolve(strings, True, by_word, window, gram, method, keep_first, bound, batch_bytes).select("d", "key", "marks")


def _resolve(strings: DataFrame, texts: bool, by_word: bool, window: int, gram: int, method: Method, keep_first: bool, bound: int, batch_bytes: int) -> DataFrame:
    """(d, key, start, marks) of strings (d, key, start, c, text); `texts`: they are the documents themselves."""
    # a changed column hides how the rows lie, so that the join deals both sides and AQE can split hot anchors
    twice = cut(_anchors(strings, by_word, window, gram).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select(F.expr("anchor + 0L").alias("anchor")))
    bits = key_bits(twice.select(F.col("anchor").alias("key")))  # so that what occurs once is hardly shuffled
    members = _members(strings, by_word, window, gram, bits)
    if texts:  # what is the same in all rows stays out
        members = stored(members.drop("start", "c").join(twice, "anchor")).withColumns({"start": F.lit(0), "c": F.lit(1).cast("long")})
    else:
        members = stored(members.join(twice, "anchor"))
    members = members.withColumns({"n": F.col("held")[0], "starts": F.slice("held", F.lit(2), F.size("held") - 1)}).drop("held")
    first = F.struct("d", (F.col("start") + F.col("starts")[0]).alias("place"), "key", "start", F.col("starts")[0].alias("rel"), "n")
    contexts = stored(members.groupBy("anchor", "context").agg(F.sum(F.col("c") * F.size("starts")).alias("c"), F.min(first).alias("first")))
    large = contexts.groupBy("anchor").agg(F.sum(F.col("first.n") + (window - 1)).alias("units")).where(F.col("units") > bound)
    if gram == window:  # a group is one context
        large = large.where("false")
    large = cut(large.select("anchor"))

    def pieces(asked: DataFrame) -> DataFrame:
        """The contexts' units, cut out of the string that has the first member."""
        m = F.struct("anchor", "context", "c", "first.place", "first.rel", (F.col("first.n") + (window - 1)).alias("size"))
        by_text = asked.groupBy("first.d", "first.key", "first.start").agg(F.collect_list(m).alias("ms"))  # bounded by the text's own length
        source = strings.select("d", "key", "start", "text")
        if texts:
            by_text = cut(by_text)
            source = picked(source, key_bits(by_text), True)
        return source.join(by_text, ["d", "key", "start"]).select("d", "key", "text", "ms").mapInArrow(lambda batches: _cut_out(batches, by_word), "anchor long, context long, d long, place int, key long, c long, text binary")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Context] = []
        size = 0

        def done() -> pa.RecordBatch:
            rows = [(*x[:5], *([p[i] for p in side] for side in spans for i in (0, 1))) for x, spans in zip(held, method(held)) if spans[0] or spans[1]]
            cols = list(zip(*rows)) or [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS)], _FOUND)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:2] == held[-1][:2]:
                    continue  # a repeated row of the table
                if size >= batch_bytes and row[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(Context(*row))
                size += len(row[6])
        if held:
            yield done()

    schema = "anchor long, context long, d long, place int, key long, lo array<int>, hi array<int>, rlo array<int>, rhi array<int>"
    calm = pieces(contexts.join(large, "anchor", "left_anti")).repartition("anchor").sortWithinPartitions("anchor", "d", "place", "key", "context")
    found = calm.mapInArrow(groups, schema)
    if not large.isEmpty():
        crowd = contexts.join(large, "anchor", "left_semi")
        inner = cut(pieces(crowd).select("d", "key", F.col("place").alias("start"), F.lit(1).cast("long").alias("c") if keep_first else "c", "text").dropDuplicates(["d", "key", "start"]))
        spans = _resolve(inner, False, by_word, window, window - (window - gram) // 8, method, keep_first, bound, batch_bytes)
        each = "flatten(transform(marks, m -> flatten(transform(m.starts, s -> transform(m.{0}, x -> s + x)))))"
        own = spans.select("d", "key", F.col("start").alias("place"), F.expr(each.format("lo")).alias("lo"), F.expr(each.format("hi")).alias("hi"))
        ends = crowd.select("anchor", "context", "first.d", "first.place", "first.key", "c", (F.col("first.n") + (window - 1)).alias("size"))
        none = F.array().cast("array<int>")
        again = F.col("c") > 1
        resolved = ends.join(own, ["d", "place", "key"], "left").where(again | F.col("lo").isNotNull())
        found = found.unionByName(
            resolved.select("anchor", "context", "d", "place", "key", F.coalesce("lo", none).alias("lo"), F.coalesce("hi", none).alias("hi"), F.when(again, F.array(F.lit(0))).otherwise(none).alias("rlo"), F.when(again, F.array("size")).otherwise(none).alias("rhi"))
        )

    there = found.select("anchor", "context", F.col("d").alias("fd"), F.col("place").alias("fp"), "lo", "hi", "rlo", "rhi")
    hits = members.join(there, ["anchor", "context"])
    if keep_first:
        is_first = "d = fd and start + s = fp"
        marks = F.expr(f"array(named_struct('starts', filter(starts, s -> {is_first}), 'lo', lo, 'hi', hi), named_struct('starts', filter(starts, s -> not ({is_first})), 'lo', rlo, 'hi', rhi))")
        marks = F.filter(marks, lambda m: (F.size(m["starts"]) > 0) & (F.size(m["lo"]) > 0))
    else:
        marks = F.array(F.struct("starts", "lo", "hi"))
    hits = hits.select("d", "key", "start", marks.alias("marks")).where(F.size("marks") > 0)
    return cut(hits.groupBy("d", "key", "start").agg(F.flatten(F.collect_list("marks")).alias("marks")))  # bounded by the string's own length


_FOUND = ["anchor", "context", "d", "place", "key", "lo", "hi", "rlo", "rhi"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int32())] * 4]


def _cut_out(batches: Iterator[pa.RecordBatch], by_word: bool) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        d, key = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for row, buf, offsets in vec.text_chunks(batch.column(2)):
            data = buf.tobytes()
            starts, ends, first = vec.word_places(buf, offsets, vec.NOT_SPACE) if by_word else (None, None, offsets)
            cols: list[list] = [[], [], [], [], [], [], []]
            for i in range(len(offsets) - 1):
                at = int(first[i])
                for m in batch.column(3)[row + i].as_py():
                    s = at + m["rel"]
                    e = s + m["size"]
                    units = b" ".join(data[starts[s] : ends[e - 1]].split()) if by_word else data[s:e]
                    for col, x in zip(cols, (m["anchor"], m["context"], d[row + i], m["place"], key[row + i], m["c"], units)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["anchor", "context", "d", "place", "key", "c", "text"])


def runs(marks: list[dict] | None, limit: int) -> list[tuple[int, int]]:
    """Maximal runs that the marks of a text cover, cut at `limit`."""
    if not marks:
        return []
    sides = [[], []]
    for m in marks:
        at = np.array(m["starts"])[:, None]
        for side, name in zip(sides, ("lo", "hi")):
            side.append((at + np.array(m[name])[None, :]).ravel())
    start, end = (np.concatenate(x) for x in sides)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.minimum(np.maximum.accumulate(end[order]), limit)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    last = np.append(new[1:] - 1, len(start) - 1)
    return list(zip(start[new].tolist(), end[last].tolist()))
