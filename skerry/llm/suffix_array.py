"""Removal of repeated byte strings with suffix arrays sorted by bucket-pointer refinement."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import repeats, vec


#: Bits of a sort key: the bucket's number, those of the positions further on, and the position itself.
KEY_BITS = 63


def refine(data: np.ndarray, ends: np.ndarray, length: int, gram: int = 8, often: np.ndarray | None = None) -> np.ndarray:
    """Bucket of each position by its next `length` bytes; -1 where it is alone or they reach over `ends`.

    `ends[i]` is where the string that holds byte i stops; `often` marks positions that stand for more than
    one, which are never alone. Initial buckets are of `gram` bytes, or as many as a key has room for. Each round
    sorts what shares a bucket by the buckets of the positions once, twice and so on as many bytes further as the
    buckets are deep, as far as a key has room for their numbers, once at least; the refined buckets are the sort
    keys of the next round, so the depth at least doubles. Positions alone in their bucket leave at once, and so
    does each position whose later offset has left: its string is alone, too. A key ends with the position, so
    that plain numbers are sorted, which takes a fraction of the time of sorting their order.
    """
    n = len(data)
    bucket = np.full(n + length, -1, np.int32 if n < 1 << 31 else np.int64)
    if n < length:
        return bucket[:n]
    place = n.bit_length()
    there = np.zeros(256, bool)
    there[data] = True
    wide = max(1, int(there.sum() - 1).bit_length())
    depth = min(gram, length, max(1, (KEY_BITS - place) // wide))
    code = (np.cumsum(there) - 1).astype(np.uint8)[data]
    key = code[: n - depth + 1].astype(np.int64)
    for i in range(1, depth):
        key <<= wide
        key |= code[i : n - depth + 1 + i]
    at = np.flatnonzero(np.arange(depth, n + 1) <= ends[: n - depth + 1])
    key = key[at]
    at, own = _shared(key, depth * wide, at, place, often)
    heads = np.flatnonzero(ends[1:] != ends[:-1]) + 1
    while depth < length and len(at):
        bucket[:] = -1
        bucket[at] = own
        bucket[heads] = -1  # what goes on there has reached its string's end
        wide = max(1, int(own[-1]).bit_length())
        parts = max(2, (KEY_BITS - place) // wide)
        steps = [min(i * depth, length - depth) for i in range(1, min(parts, -(-length // depth)))]
        key, fits = own, np.ones(len(at), bool)
        for step in steps:  # all up to a step being there, the step is in the same string
            later = bucket[at + step]
            fits &= later >= 0
            key = key << wide | later
        key, at = key[fits], at[fits]
        at, own = _shared(key, (len(steps) + 1) * wide, at, place, often)
        depth += steps[-1]
    bucket[:] = -1
    bucket[at] = own
    return bucket[:n]


def _shared(key: np.ndarray, wide: int, at: np.ndarray, place: int, often: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sort positions by key, in its place: those that share one, and the number of each one's bucket, from 0 in the sorted order. A key has `wide` bits, a position `place`."""
    if wide + place <= KEY_BITS:
        key <<= place
        key |= at
        key.sort()
        at = key & ((1 << place) - 1)
        key >>= place
    else:
        order = np.argsort(key)
        key, at = key[order], at[order]
    same = np.zeros(len(at) + 1, bool)
    np.equal(key[1:], key[:-1], out=same[1 : len(at)])
    shared = same[:-1] | same[1:]
    if often is not None:
        shared |= often[at]
    return at[shared], np.cumsum(~same[:-1][shared]) - 1


def shared_windows(length: int):
    """The method for repeats.repeated_spans: what two strings share over `length` bytes."""

    def method(rows: list[repeats.Context]) -> list[repeats.Spans]:
        sizes = np.array([len(r.units) for r in rows])
        stops = np.cumsum(sizes)
        data = np.frombuffer(b"".join(r.units for r in rows), np.uint8)
        often = np.repeat(np.array([r.c > 1 for r in rows]), sizes)
        hit = np.flatnonzero(refine(data, np.repeat(stops.astype(np.int32), sizes), length, often=often) >= 0)
        row = np.searchsorted(stops, hit, side="right")
        new = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (row[1:] != row[:-1])])) if len(hit) else []
        out: list[repeats.Spans] = [([], []) for _ in rows]
        for a, b in zip(new, [*new[1:], len(hit)]):
            begin = stops[row[a]] - sizes[row[a]]
            out[row[a]][0].append((int(hit[a] - begin), int(hit[b - 1] - begin + length)))
        return out

    return method


def _dense(docs: DataFrame, words: int, length: int) -> DataFrame:
    """Documents with `words` words in a row that stand in fewer than `length` bytes."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for row, buf, offsets in vec.text_chunks(batch.column(1)):
                starts, ends, first = vec.word_places(buf, offsets, vec.NOT_SPACE)
                if len(starts) >= words:
                    tight = np.flatnonzero(ends[words - 1 :] - starts[: len(starts) - words + 1] < length)
                    of = np.searchsorted(first, tight, side="right") - 1
                    keep[row + of[tight + words <= first[of + 1]]] = True
            yield batch.filter(pa.array(keep))

    some = docs.select("doc_id", "text")
    return some.mapInArrow(run, some.schema)


#: Bytes of one group that a task refines at once; its arrays take about 60 times that.
GROUP_BYTES = 1 << 21
#: Bytes of whole groups that are refined together, if one alone isn't more: so few that a key has room for several bucket numbers.
BATCH_BYTES = 1 << 16


def passage_spans(docs: DataFrame, words: int, length: int = 200, gram: int = 32, bound: int = GROUP_BYTES) -> DataFrame:
    """(d, key, marks) that cover each passage of over `words` words that also starts anywhere else.

    A passage of `length` bytes or more has strings of that length. A shorter one is in texts that hold so
    many words in so few bytes, and only those are searched for strings of 2 * words + 1 bytes, the least
    that more than `words` words can have.
    """
    least = 2 * words + 1
    wide = repeats.repeated_spans(docs, False, length, gram, shared_windows(length), keep_first=False, bound=bound, batch_bytes=BATCH_BYTES)
    tight = repeats.repeated_spans(_dense(docs, words + 1, length), False, least, gram, shared_windows(least), keep_first=False, bound=bound, batch_bytes=BATCH_BYTES)
    return wide.unionByName(tight).groupBy("d", "key").agg(F.flatten(F.collect_list("marks")).alias("marks"))


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 32, bound: int = GROUP_BYTES, keep_text: bool = False, over: int | None = None) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts anywhere else.

    With `over`, runs of more than so many words go, too, whatever their length: see passage_spans().
    Texts are UTF-8 bytes; strings never cross texts and are judged on the input. Returns doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs) and kept_sha256, and if asked for the kept text (what is left of a character
    cut in two is dropped there) and the other columns as `rest`. Null texts are empty; texts shorter than `length` stay
    whole; repeated rows are copies of each other, and all their bytes go; a null doc_id is kept; an empty
    table gives no rows; other columns are not read. Memory of a task follows its batches, its longest text and `bound`.
    """
    if over is None:
        spans = repeats.repeated_spans(docs, False, length, gram, shared_windows(length), keep_first=False, bound=bound, batch_bytes=BATCH_BYTES)
    else:
        spans = passage_spans(docs, over, gram=gram, bound=bound)
    joined = repeats.with_spans(docs, spans)

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, 1):
                cols: list[list] = [[], [], [], [], []]
                for text, marks in zip(part.column(1).to_pylist(), part.column(2)):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    runs = repeats.runs(marks.as_py(), len(raw))
                    if over is not None:
                        runs = [(s, e) for s, e in runs if e - s >= length or len(raw[s:e].split()) > over]
                    kept, pos = [], 0
                    for s, e in runs:
                        kept.append(raw[pos:s])
                        pos = e
                    kept.append(raw[pos:])
                    left = b"".join(kept)
                    for col, x in zip(cols, (len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if keep_text else None)):
                        col.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                arrays = [part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds)), part.column(3)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "rest"]
                n = 7 if keep_text else 5
                yield pa.RecordBatch.from_arrays(arrays[:n], names[:n])

    schema = StructType().add("doc_id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if keep_text:
        schema = schema.add("kept", "string").add(joined.schema["rest"])
    return joined.mapInArrow(run, schema)
