"""Removal of repeated word windows by matching statistics against suffix automata.

The literal form, automata of a whole corpus broadcast to all executors, has no bound and makes every
document stream past every shard. Here the reference is dealt into shards so that a window and all places it
could match share one (repeats.py: anchor groups, of at most `bound` words), and the automaton of a shard is
built where its documents stream past. For a reference with a proven bound, remove_reference() broadcasts
the automata.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, vec

#: Words of a reference shard of remove_reference(), and of all its shards together.
SHARD_WORDS, REFERENCE_WORDS = 200_000, 2_000_000


class SuffixAutomaton:
    """Automaton of all substrings of the sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            q = nexts[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._split(last, c, q)
                continue
            new = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def _split(self, p: int, c, q: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(nexts)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nexts[p].get(c) == q:
            nexts[p][c] = copy
            p = link[p]
        return copy

    def statistics(self, sequence) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for c in sequence:
            while state and c not in nexts[state]:
                state = link[state]
                matched = length[state]
            state = nexts[state].get(c, 0)
            matched = matched + 1 if state else 0
            out.append(matched)
        return out


def spans_over(statistics: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal spans covered by matches of at least `window` units."""
    out: list[list[int]] = []
    for i, m in enumerate(statistics):
        if m >= window:
            s = i + 1 - m
            if out and s <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([s, i + 1])
    return [(s, e) for s, e in out]


def earlier_windows(window: int):
    """The method for repeats.repeated_spans: what also stands in an earlier context of the group, or in an earlier member."""

    def method(rows: list[repeats.Context]) -> list[repeats.Spans]:
        out = []
        anchor = automaton = None
        for r in rows:
            words, own = r.units.split(), []
            if r.anchor != anchor:
                anchor, automaton = r.anchor, SuffixAutomaton()
            else:
                own = spans_over(automaton.statistics(words), window)
            automaton.add(words)
            out.append((own, spans_over(automaton.statistics(words), window) if r.c > 1 else []))
        return out

    return method


def _without(text: str | None, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(words, words removed, kept words joined by one space)."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    kept, pos = [], 0
    for s, e in spans:
        kept += words[pos:s]
        pos = e
    kept += words[pos:]
    return len(words), len(words) - len(kept), b" ".join(kept)


_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _result(part: pa.RecordBatch, found: list[tuple[int, int, bytes]], keep_text: bool) -> pa.RecordBatch:
    arrays = [part.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([hashlib.sha256(f[2]).hexdigest() for f in found], pa.string())]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    if keep_text:
        arrays.append(pa.array([f[2].decode("utf-8") for f in found], pa.string()))
        names.append("kept")
    return pa.RecordBatch.from_arrays(arrays, names)


#: Words of one group that a task builds an automaton of; a word takes about 0.5 KB there.
GROUP_WORDS = 1 << 17


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 6, bound: int = GROUP_WORDS, keep_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts earlier in the corpus.

    Earlier is by doc_id, then by place; windows are judged on the input. Returns doc_id, n_words, n_removed
    and kept_sha256, of the kept words joined by one space, with these as `kept` if asked for. Null texts
    have no words; rows of the same doc_id and text are one document (none is earlier than the other); a
    null doc_id is kept and comes before all others; an empty table gives no rows; other columns are not read.
    """
    spans = repeats.repeated_spans(docs, True, window, gram, earlier_windows(window), keep_first=True, bound=bound)
    joined = repeats.with_spans(docs, spans)

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, 1):
                found = [_without(t, repeats.runs(m.as_py(), 1 << 30)) for t, m in zip(part.column(1).to_pylist(), part.column(2))]
                yield _result(part, found, keep_text)

    return joined.mapInArrow(run, _SCHEMA + (", kept string" if keep_text else ""))


def remove_reference(docs: DataFrame, reference: DataFrame, window: int = 20, keep_text: bool = False) -> DataFrame:
    """Remove from each text the maximal spans of `window` or more words that a reference text holds, too.

    The reference's column `text` is dealt into shards of SHARD_WORDS words, whose automata are broadcast;
    one of more than REFERENCE_WORDS words in all is refused. Results and edge cases are those of remove_repeats().
    """
    spark = docs.sparkSession
    size = reference.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).first()["n"] or 0
    if size > REFERENCE_WORDS:
        raise ValueError(f"the reference has {size} words; at most {REFERENCE_WORDS} can be broadcast")
    shards, held = [SuffixAutomaton()], 0
    for row in reference.select("text").where("text is not null").toLocalIterator():
        words = row.text.encode("utf-8", "surrogatepass").split()
        if held and held + len(words) > SHARD_WORDS:
            shards.append(SuffixAutomaton())
            held = 0
        shards[-1].add(words)
        held += len(words)
    sent = spark.sparkContext.broadcast(shards)

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, 1):
                found = []
                for text in part.column(1).to_pylist():
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    spans = [x for shard in sent.value for x in spans_over(shard.statistics(words), window)]
                    marks = [{"starts": [0], "lo": [s for s, _ in spans], "hi": [e for _, e in spans]}] if spans else None
                    found.append(_without(text, repeats.runs(marks, len(words))))
                yield _result(part, found, keep_text)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA + (", kept string" if keep_text else ""))
