"""Spelling variants: words of a corpus that are one edit apart, and the form each goes back to.

The corpus' frequent words are dealt by hash to shards, each a pair of compact tries of a bounded size. One shard at a
time is broadcast; each word's Levenshtein automaton for distance one is walked through it depth-first, and its
accepting words are reduced at once to their number and the best of them. Over shards, numbers add up and the
best of the bests is kept, so no list of neighbours is ever shuffled.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import vec

LETTERS = "A-Za-zÀ-ÿ"
#: Words and letters of a trie shard; with twice that, its two tries take 145 MB at the very most, and usually a third.
SHARD_WORDS, SHARD_LETTERS = 1 << 18, 1 << 21
#: Distinct words that a task counts before it hands them on.
COUNTED = 1 << 17
_LOWER = {c: c + 32 for c in range(65, 91)}


def word_counts(docs: DataFrame, least_length: int = 5, drop: int = 97) -> DataFrame:
    """(word, n): how often each word of at least `least_length` letters occurs.

    Words are maximal runs of letters, A-Z lower-cased. Where `drop` divides the crc32 of `<doc_id>:<word>`, one letter is left
    out, at the crc32 modulo the word's length; with drop=0 none is. A null text has no words; a null doc_id is as an empty one.
    """
    run = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        get = total.get

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in vec.slices(batch, 1, 64, 1 << 20):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for w in run.findall((text or "").translate(_LOWER)):
                        if drop:
                            h = zlib.crc32(w.encode(), start)
                            if h % drop == 0:
                                at = h % len(w)
                                w = w[:at] + w[at + 1 :]
                                if len(w) < least_length:
                                    continue
                        total[w] = get(w, 0) + 1
                if len(total) >= COUNTED:
                    yield out()
                    total.clear()
        yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Side:
    """Words with counts in arrays: nodes in breadth-first order, so a node's children lie side by side.

    Node i's children are first[i] to first[i + 1], `labels` has the letter that leads to each node, `parent` is
    the node above it, and `counts` is not zero where a word ends: 17 bytes a node.
    """

    def __init__(self, words: list[str], counts: list[int]) -> None:
        """`words` in code-point order, without repeats."""
        labels, first, ends = ["\0"], array("I"), []
        level = [(0, len(words))]
        depth = 0
        while level:
            below = []
            for lo, hi in level:
                first.append(len(labels))
                if lo < hi and len(words[lo]) == depth:
                    ends.append((len(first) - 1, counts[lo]))
                    lo += 1
                while lo < hi:
                    letter = words[lo][depth]
                    end = _first_after(words, lo, hi, depth, letter)
                    labels.append(letter)
                    below.append((lo, end))
                    lo = end
            level, depth = below, depth + 1
        first.append(len(labels))
        self.labels, self.first = "".join(labels), first
        self.parent = array("I", bytes(4 * len(labels)))
        for node in range(len(labels)):
            for child in range(first[node], first[node + 1]):
                self.parent[child] = node
        self.counts = array("q", bytes(8 * len(labels)))
        for node, n in ends:
            self.counts[node] = n

    def edits(self, word: str, low: int, low_insert: int, mirrored: bool) -> Iterator[tuple[str, int]]:
        """Words here that one edit of `word` gives: a letter replaced or deleted at a place from `low` on, or put in at one from `low_insert` on.

        States of the automaton are (letters read, edits made): the walk without an edit is the path below, its nodes are left
        by an edit in all ways the trie has, and what remains must match to its end. Of equal letters in a row the first is the one
        that is deleted, and a letter like the one before is put in after it, so no word comes twice; `mirrored`: the word is read backward.
        """
        labels, first, parent, counts = self.labels, self.first, self.parent, self.counts
        find, size = labels.find, len(word)

        def rest(node: int, i: int) -> int:
            while i < size:
                node = find(word[i], first[node], first[node + 1])
                if node < 0:
                    return 0
                i += 1
            return counts[node]

        node = 0
        for i in range(size + 1):
            if i >= low:
                letter = word[i] if i < size else ""
                if i < size and ((i + 1 == size or word[i + 1] != letter) if mirrored else (i == 0 or word[i - 1] != letter)):
                    n = rest(node, i + 1)
                    if n:
                        yield word[:i] + word[i + 1 :], n
                like = (word[i - 1] if i else "") if mirrored else letter
                lo, hi = first[node], first[node + 1]
                if i + 1 >= size:  # what is replaced, or put in, is the last letter
                    for child in range(lo, hi):
                        n, other = counts[child], labels[child]
                        if n and other != letter and i < size:
                            yield word[:i] + other, n
                        if n and i == size and i >= low_insert and other != like:
                            yield word + other, n
                lo, hi = first[lo], first[hi]  # all that is two letters on lies side by side, too
                if i + 1 < size:
                    after = word[i + 1]
                    at = find(after, lo, hi)
                    while at >= 0:
                        other = labels[parent[at]]
                        if other != letter:
                            n = rest(at, i + 2)
                            if n:
                                yield word[:i] + other + word[i + 1 :], n
                        at = find(after, at + 1, hi)
                if low_insert <= i < size:
                    at = find(letter, lo, hi)
                    while at >= 0:
                        other = labels[parent[at]]
                        if other != like:
                            n = rest(at, i + 1)
                            if n:
                                yield word[:i] + other + word[i:], n
                        at = find(letter, at + 1, hi)
            if i < size:
                node = find(word[i], first[node], first[node + 1])
                if node < 0:
                    return


class Trie:
    """A shard: its words from their first letters on, and from their last ones.

    An edit leaves one half of a word as it is. So the walk keeps to the word's own path until the half is read, where a
    trie has few branches left: forward for edits in the second half, backward for those in the first.
    """

    def __init__(self, words: list[str], counts: list[int]) -> None:
        """`words` in code-point order, without repeats."""
        self.forward = Side(words, counts)
        back = sorted((w[::-1], n) for w, n in zip(words, counts))
        self.backward = Side([w for w, _ in back], [n for _, n in back])

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """(word, count) of each word one inserted, deleted or replaced letter away, once."""
        half = len(word) // 2
        yield from self.forward.edits(word, half, half, False)
        for found, n in self.backward.edits(word[::-1], len(word) - half, len(word) - half + 1, True):
            yield found[::-1], n


def _first_after(words: list[str], lo: int, hi: int, depth: int, letter: str) -> int:
    """End of the words from `lo` that have this letter at this depth."""
    if words[hi - 1][depth] == letter:
        return hi
    step = 1
    while lo + step < hi and words[lo + step][depth] == letter:
        lo, step = lo + step, step * 2
    hi = min(hi, lo + step)
    while hi - lo > 1:
        middle = (lo + hi) // 2
        lo, hi = (middle, hi) if words[middle][depth] == letter else (lo, middle)
    return hi


def tries(words: DataFrame) -> DataFrame:
    """(shard, trie): the words (word, n) as pickled tries of bounded size, dealt by hash."""
    n, letters = words.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_WORDS), -(-letters // SHARD_LETTERS))
    while True:  # dealing by hash is even but for chance and giant words: the bound is checked
        dealt = words.withColumn("shard", F.pmod(F.xxhash64("word"), F.lit(shards)))
        over = dealt.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("l")).where(((F.col("n") > 2 * SHARD_WORDS) | (F.col("l") > 2 * SHARD_LETTERS)) & (F.col("n") > 1))
        if over.isEmpty():
            break
        shards *= 2

    def build(batches):
        shard, held, counts = None, [], []

        def done():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([pickle.dumps(Trie(held, counts))], pa.binary())], ["shard", "trie"])

        for batch in batches:
            for s, w, c in zip(*(x.to_pylist() for x in batch.columns)):
                if s != shard:
                    if held:
                        yield done()
                    shard, held, counts = s, [], []
                held.append(w)
                counts.append(c)
        if held:
            yield done()

    return dealt.select("shard", "word", "n").repartition("shard").sortWithinPartitions("shard", "word").mapInArrow(build, "shard long, trie binary")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have a word one edit away; the best is the most frequent, of equals the first in code-point order."""
    spark = words.sparkSession
    built = cut(tries(words))
    found = None
    for (shard,) in built.select("shard").orderBy("shard").collect():  # ids alone; one trie at a time follows
        sent = spark.sparkContext.broadcast(built.where(F.col("shard") == shard).first()["trie"])

        def run(batches, sent=sent):
            trie = pickle.loads(sent.value)
            for batch in batches:
                rows = []
                for word in batch.column(0).to_pylist():
                    near = list(trie.near(word))
                    if near:
                        best, n = min(near, key=lambda x: (-x[1], x[0]))
                        rows.append((word, len(near), n, best))
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])

        part = cut(words.select("word").mapInArrow(run, "word string, n_near long, best_n long, best string"))
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(word, root) for each word that has a form: forms are followed to the last, in steps that double."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        step = cut(now.join(ahead, now.root == ahead["at"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now
    raise RuntimeError("forms run in a circle")


def group_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, drop: int = 97, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word with `least_length` letters that occurs `least_count` times or more.

    A word's form is its most frequent neighbour, if that occurs `ratio` times as often at least, else null; its root is where
    forms lead, or the word itself. See word_counts() for what a word is, for nulls and for `drop`; repeated rows count again; a
    text of any length is read whole; an empty table gives no rows; other columns are not read.
    """
    words = cut(word_counts(docs, least_length, drop).where(F.col("n") >= least_count))
    near = words.join(neighbours(words), "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    named = cut(near.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")))
    last = roots(named.where("form is not null").select("word", "form"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
