"""Similarity join of word n-gram sets with prefix trees.

Equal sets are one node. Two sets of a size class that are similar enough differ in at most so many members;
with the hash range cut into more pieces than that, they agree on a whole piece, so sets are keyed by their pieces
and sets that share a key hang together in a cluster. No similar pair is missed by that, and few others meet. In a
cluster the sets are strings in one global order, rarest members first, and lie in a prefix tree. A set is
sent down the tree: all sets below a branch share its overlap so far, and a branch is left when what remains on
both sides can't reach the overlap that the least similar sizes below need. Links leave as a spanning forest: what
was reached is taken out of the tree, so groups of near copies are passed once. Clusters too large for a task are
dealt to trees of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut
from . import repeats, vec

#: Members of the sets that a task holds of one cluster; a tree takes about 40 bytes for each.
TREE_MEMBERS = 1 << 19
#: Members of a branch that are looked at before it is judged again.
RUN = 16
#: Sets of a large cluster that all others are first compared with.
LEADERS = 32
#: Keys that a task holds before it hands them on.
HELD_KEYS = 1 << 18


class Threshold:
    """Jaccard similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def slack(self, overlap: int, x: int, y: int) -> int:
        """Not negative if sets of sizes x and y with this overlap are similar."""
        return (self.num + self.den) * overlap - self.num * (x + y)

    def apart(self, size: int) -> int:
        """How many members similar sets of at most `size` each can differ in."""
        return 2 * size * (self.den - self.num) // (self.num + self.den)

    def largest(self, size: int) -> int:
        """Size of the largest set similar to one of this size."""
        return size * self.den // self.num


class PrefixTree:
    """Sets of whole numbers by their members in one order, least frequent first; see near().

    With `alone` only the tree's own sets will be looked for: members that one set alone has can't be shared and are left out.
    """

    def __init__(self, sets: list[np.ndarray], threshold: Threshold, alone: bool = False) -> None:
        self.threshold, self.sizes = threshold, np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        self.values, at, often = np.unique(every, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(self.values), np.int64)
        self.rank[np.lexsort((self.values, often))] = np.arange(len(self.values))
        ranks, ends = self.rank[at.ravel()], np.concatenate([[0], np.cumsum(self.sizes)])
        self.first = np.count_nonzero(often == 1) if alone else 0
        self.strings = [np.sort(r[r >= self.first]) for r in (ranks[s:e] for s, e in zip(ends[:-1], ends[1:]))]
        order = sorted(range(len(sets)), key=lambda i: self.strings[i].astype(">u4").tobytes())
        self._build(order)

    def _build(self, order: list[int]) -> None:
        """Branches as arrays, each level's side by side: a run of members, members before it, the set that ends there, least and largest sizes and live sets below."""
        run: list[tuple[int, int, int]] = [(0, 0, 0)]  # set that has it, from, to
        below: list[list[int]] = [[]]
        ending: list[list[int]] = [[]]
        last, path = np.empty(0, np.int64), [0]

        def add(of: int, lo: int, hi: int) -> int:
            run.append((of, lo, hi))
            below.append([])
            ending.append([])
            return len(run) - 1

        for i in order:
            mine = self.strings[i]
            common = min(len(last), len(mine))
            differ = np.flatnonzero(last[:common] != mine[:common])
            shared = int(differ[0]) if len(differ) else common
            while len(path) > 1 and run[path[-1]][1] >= shared:
                path.pop()
            top = path[-1]
            of, lo, hi = run[top]
            if hi > shared:  # the branch is split where the strings part
                lower = add(of, shared, hi)
                below[lower], ending[lower] = below[top], ending[top]
                below[top], ending[top], run[top] = [lower], [], (of, lo, shared)
            node = top
            for start in range(shared, len(mine), RUN):
                lower = add(i, start, min(start + RUN, len(mine)))
                below[node].append(lower)
                path.append(lower)
                node = lower
            ending[node].append(i)
            last = mine
        level, numbered = [0], []
        while level:
            numbered += level
            level = [c for n in level for c in below[n]]
        self.members = np.concatenate([self.strings[of][lo:hi] for of, lo, hi in (run[n] for n in numbered)]) if self.strings else np.empty(0, np.int64)
        size = np.array([run[n][2] - run[n][1] for n in numbered])
        self.run = np.concatenate([[0], np.cumsum(size)])
        self.depth = np.array([run[n][2] for n in numbered])  # members up to its end
        held = [len(ending[n]) for n in numbered]
        self.ends = np.concatenate([[0], np.cumsum(held)])
        self.ending = np.array([i for n in numbered for i in ending[n]], np.int64)  # sets by the branch they end at
        children = np.array([len(below[n]) for n in numbered])
        self.below = 1 + np.concatenate([[0], np.cumsum(children)])
        self.parent = np.concatenate([[-1], np.repeat(np.arange(len(numbered)), children)])
        self.live = np.zeros(len(numbered), np.int64)
        self.least, self.most, self.longest = np.full(len(numbered), 1 << 62), np.zeros(len(numbered), np.int64), np.zeros(len(numbered), np.int64)
        self.where = np.zeros(len(self.sizes), np.int64)
        self.where[self.ending] = np.repeat(np.arange(len(numbered)), held)
        self.alive = np.ones(len(self.sizes), bool)
        ends = np.flatnonzero(held)
        self.live[ends], self.longest[ends] = np.bincount(self.where, minlength=len(numbered))[ends], self.depth[ends]
        for i, node in enumerate(self.where.tolist()):
            self.least[node], self.most[node] = min(self.least[node], self.sizes[i]), max(self.most[node], self.sizes[i])
        for node in range(len(numbered) - 1, 0, -1):
            up = self.parent[node]
            self.live[up] += self.live[node]
            self.least[up], self.most[up] = min(self.least[up], self.least[node]), max(self.most[up], self.most[node])
            self.longest[up] = max(self.longest[up], self.longest[node])

    def take_out(self, i: int) -> None:
        """Set i is not found any more."""
        node = self.where[i]
        self.alive[i] = False
        while node >= 0:
            self.live[node] -= 1
            node = self.parent[node]

    def near(self, own: np.ndarray) -> list[int]:
        """The sets in the tree that are similar to the sorted set `own`: branches are followed a level at a time, from each its own overlap so far."""
        slack, size = self.threshold.slack, len(own)
        if not len(self.members):  # nothing that could be shared
            return []
        at = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        known = self.rank[at[self.values[at] == own]]
        known = known[known >= self.first]
        has = np.zeros(len(self.values) + 1, np.int64)
        has[known + 1] = 1
        passed = np.cumsum(has)  # members of `own` before each rank; those that no set has never match
        out, nodes, overlap = [], np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            lo, n = self.run[nodes], self.run[nodes + 1] - self.run[nodes]
            end = np.cumsum(n)
            met = np.concatenate([[0], np.cumsum(has[self.members[np.repeat(lo - (end - n), n) + np.arange(end[-1])] + 1])])
            overlap = overlap + met[end] - met[end - n]
            left = len(known) - np.where(n > 0, passed[self.members[np.maximum(lo + n - 1, 0)] + 1], 0)
            depth = self.depth[nodes]
            best = np.minimum(np.maximum(depth + left, self.least[nodes]), self.most[nodes])  # the size below that may have most
            stay = (self.live[nodes] > 0) & (slack(overlap + np.minimum(left, best - depth), size, best) >= 0)
            stay &= slack(overlap + np.minimum(left, self.longest[nodes] - depth), size, self.least[nodes]) >= 0
            nodes, overlap = nodes[stay], overlap[stay]
            n = self.ends[nodes + 1] - self.ends[nodes]
            end = np.cumsum(n)
            here = self.ending[np.repeat(self.ends[nodes] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
            here_too = np.repeat(overlap, n)[self.alive[here]]
            here = here[self.alive[here]]
            out += here[slack(here_too, size, self.sizes[here]) >= 0].tolist()
            n = self.below[nodes + 1] - self.below[nodes]
            end = np.cumsum(n)
            nodes, overlap = np.repeat(self.below[nodes] - (end - n), n) + np.arange(end[-1] if len(end) else 0), np.repeat(overlap, n)
        return out

    def forest(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links among the tree's own sets, as few as connect the same ones as all links do. Empties the tree."""
        out, seen = [], [False] * len(sets)
        for root in range(len(sets)):
            if seen[root]:
                continue
            seen[root] = True
            self.take_out(root)
            front = [root]
            while front:
                i = front.pop()
                for j in self.near(sets[i]):
                    seen[j] = True
                    self.take_out(j)
                    out.append((i, j))
                    front.append(j)
        return out


_SPREAD = np.uint64(vec.BASES[1])


def piece_keys(own: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Keys of a set: two different similar sets share at least one.

    Sizes are dealt to classes, each half as large again as the one before. In a class whose sets differ in at
    most d members if they are similar, there are d + 1 pieces and a few more; a member's hash names its piece. At
    least 1 + extra pieces agree then, so empty ones can stay out unless a set has more than `extra` of them. A
    set also has keys of the next class if a set there can be similar to it.
    """
    out = []
    for low, high in classes(len(own), threshold):
        apart = threshold.apart(high)
        extra = 3 if apart >= 8 else 1
        pieces = apart + 1 + extra
        which = ((vec.mix(own * _SPREAD + vec.U(low)) >> vec.U(32)) * vec.U(pieces) >> vec.U(32)).astype(np.int64)
        total = np.zeros(pieces, vec.U)
        np.add.at(total, which, vec.mix(own ^ vec.U(low)))
        empty = np.bincount(which, minlength=pieces) == 0
        keep = ~empty if empty.sum() <= extra else np.ones(pieces, bool)
        out.append(vec.mix(vec.mix(total + np.arange(pieces, dtype=vec.U) * _SPREAD) + vec.U(low))[keep])
    return np.concatenate(out)


def classes(size: int, threshold: Threshold) -> Iterator[tuple[int, int]]:
    """(least, largest) sizes of the classes that a set of this size has keys in: its own, and the next if similar sets reach into it."""
    low = 1
    while True:
        high = low + low // 2
        if size <= high:
            yield low, high
            if threshold.largest(size) > high:
                yield high + 1, high + 1 + (high + 1) // 2
            return
        low = high + 1


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sets_of(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def meeting(docs: DataFrame, secret: list[int], threshold: Threshold) -> DataFrame:
    """(key, node) such that similar nodes share a key, perhaps through others.

    What meets within a task is settled there: only the least node of each key is handed on, and each of the others once, with a
    key of its own and its least. So a group of copies, however large, is a row for each task and node.
    """

    def settled(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        key, node = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        least = node[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))] if len(key) else node
        pair = least != node
        both = np.unique(np.stack([least[pair], node[pair]], 1), axis=0)
        own = vec.mix(vec.mix(both[:, 0].view(vec.U)) + both[:, 1].view(vec.U)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[new].view(np.int64), own, own])), pa.array(np.concatenate([node[new], both[:, 0], both[:, 1]]))], ["key", "node"])

    def run(batches):
        keys, nodes, size, seen = [], [], 0, set()
        for batch in batches:
            for own in _hashed(batch.column(0), secret):
                node = _node(own)
                if not len(own) or node in seen:
                    continue
                seen.add(node)
                keys.append(piece_keys(own, threshold))
                nodes.append(np.full(len(keys[-1]), node))
                size += len(keys[-1])
                if size >= HELD_KEYS:
                    yield settled(keys, nodes)
                    keys, nodes, size, seen = [], [], 0, set()
        if keys:
            yield settled(keys, nodes)

    return docs.select("text").mapInArrow(run, "key long, node long")


def _hashed(column, secret: list[int]) -> Iterator[np.ndarray]:
    for _, buf, offsets in vec.text_chunks(column):
        hashes, at = vec.shingles(buf, offsets, secret)
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            yield np.unique(hashes[s:e])


def _node(own: np.ndarray) -> int:
    got = xxhash.xxh64_intdigest(own.tobytes(), 42)
    return got - (1 << 64) if got >> 63 else got


def _starred(met: DataFrame) -> DataFrame:
    """(a, b): each key's nodes linked to its least."""

    def bucket(batches):
        key = lead = None
        for batch in batches:
            k, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            first = np.where(at >= 0, node[at], 0 if lead is None else lead)
            key, lead = k[-1], first[-1]
            pair = node != first
            yield pa.RecordBatch.from_arrays([pa.array(first[pair]), pa.array(node[pair])], ["a", "b"])

    return met.repartition("key").sortWithinPartitions("key", "node").mapInArrow(bucket, "a long, b long").distinct()


def rooted(owned: DataFrame, threshold: Threshold) -> DataFrame:
    """(node, component) within groups (group, node, own), each of a size that a task may hold; the component is its least node."""

    def run(batches):
        group, nodes, sets = None, [], []

        def done():
            up = list(range(len(nodes)))
            if len(sets) > 1:
                for i, j in PrefixTree(sets, threshold, alone=True).forest(sets):
                    up[j] = up[i]  # i was reached before j
            least: dict[int, int] = {}
            for i, root in enumerate(up):
                least[root] = min(least.get(root, nodes[i]), nodes[i])
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([least[r] for r in up], pa.int64())], ["node", "component"])

        for batch in batches:
            for g, node, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _sets_of(batch.column(2))):
                if g != group:
                    if nodes:
                        yield done()
                    group, nodes, sets = g, [], []
                nodes.append(node)
                sets.append(own)
        if nodes:
            yield done()

    # a changed column hides how the rows lie: Spark would else take the shuffle of a join before for this one, and AQE may
    # read that one locally, which parts groups ("group + 0" is simplified to "group" and hides nothing)
    dealt = owned.select(F.bitwise_not("group").alias("group"), "node", "own").repartition("group")
    return dealt.sortWithinPartitions("group", "node").mapInArrow(run, "node long, component long")


def _past(trees: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """(a, b): links between sets (group, part, node, own) and the trees (group, part) of other sets of their group; of those through one set, as few as connect the same ones.

    Both are dealt by group and part, trees first, and a set goes down the tree as it passes.
    """
    both = trees.select("group", "part", F.lit(0).alias("side"), "node", "own").unionByName(sets.select("group", "part", F.lit(1).alias("side"), "node", "own"))

    def run(batches):
        at, nodes, held, tree, up = None, [], [], None, []

        def find(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for batch in batches:
            a, b = [], []
            for g, part, side, node, own in zip(*(batch.column(i).to_pylist() for i in range(4)), _sets_of(batch.column(4))):
                if (g, part) != at:
                    at, nodes, held, tree = (g, part), [], [], None
                if not side:
                    nodes.append(node)
                    held.append(own)
                    continue
                if tree is None:
                    tree, up = PrefixTree(held, threshold), list(range(len(held)))
                tops = sorted({find(i) for i in tree.near(own)})
                for t in tops[1:]:
                    up[t] = tops[0]
                a += [nodes[t] for t in tops]
                b += [node] * len(tops)
            yield _edges(a, b)

    dealt = both.repartition("group", "part").sortWithinPartitions("group", "part", "side", "node")
    return dealt.mapInArrow(run, "a long, b long").where("a <> b")


def large_links(owned: DataFrame, threshold: Threshold, bound: int) -> DataFrame:
    """(a, b): links within groups (group, node, own, members) of any size.

    Each group is dealt to shards of `bound` members. All its sets pass a tree of LEADERS of them, which goes to
    every shard, and the most that hang together by that are settled: of a group of near copies, all. What is not settled passes trees
    of all shards, so each pair of which one is not settled is compared; the work is the group times what its leaders don't join.
    """
    shards = F.greatest(F.lit(1), F.ceil(F.col("members") / F.lit(bound)).cast("int"))
    owned = cut(owned.withColumn("shards", shards).withColumn("part", F.expr("pmod(hash(node, group), shards)")))
    order = F.struct(F.xxhash64("node").alias("h"), "node")
    lead = owned.select("group", F.struct(order.alias("o"), "shards", "own").alias("m"))
    some = lead.groupBy("group").agg(F.min_by("m", "m.o").alias("first"), F.max_by("m", "m.o").alias("last"))  # two at least, and one of each shard
    each = owned.groupBy("group", "part").agg(F.min_by(F.struct("node", "own", "shards"), order).alias("m"))
    ranked = each.where(F.col("part") < LEADERS).select("group", "m.node", "m.own", "m.shards")
    ends = some.select("group", F.explode(F.array("first", "last")).alias("m")).select("group", "m.o.node", "m.own", "m.shards")
    leaders = cut(ranked.unionByName(ends).dropDuplicates(["group", "node"]))
    to_all = leaders.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    led = cut(_past(to_all, owned, threshold).join(leaders.select("group", F.col("node").alias("a")), "a"))
    rest = cut(owned.join(_settled(leaders, led), "node", "left_anti").select("group", "node", "own", "shards"))
    links = led.select("a", "b")
    if rest.isEmpty():
        return links
    sent = rest.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    return links.unionByName(_past(owned.select("group", "part", "node", "own"), sent, threshold))


def _settled(leaders: DataFrame, led: DataFrame) -> DataFrame:
    """Nodes that hang together through leaders, of each group the most: from links (group, a, b) of leaders a.

    What ties leaders to each other are the sets that several are similar to. Of those, each group has as many rows as it has pairs of leaders.
    """
    of = led.select("group", "a", "b").unionByName(leaders.select("group", F.col("node").alias("a"), F.col("node").alias("b")))
    several = of.groupBy("group", "b").agg(F.sort_array(F.collect_set("a")).alias("as")).where(F.size("as") > 1)
    ties = several.select("group", F.explode(F.slice("as", F.lit(2), F.size("as"))).alias("y"), F.col("as")[0].alias("x")).groupBy("group", "x", "y").agg(F.lit(0).cast("long").alias("n"))
    sizes = of.groupBy("group", F.col("a").alias("x")).agg(F.count("*").alias("n")).select("group", F.col("x").alias("y"), "x", "n")

    def run(batches):
        group, up, n = None, {}, {}

        def find(i):
            while up.setdefault(i, i) != i:
                i = up[i]
            return i

        def done():
            total: dict[int, int] = {}
            for x, k in n.items():
                total[find(x)] = total.get(find(x), 0) + k
            main = max(total, key=lambda r: (total[r], r))
            mine = [x for x in n if find(x) == main]
            return pa.RecordBatch.from_arrays([pa.array(mine, pa.int64())], ["a"])

        for batch in batches:
            for g, y, x, k in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group:
                    if n:
                        yield done()
                    group, up, n = g, {}, {}
                if k:
                    n[x] = n.get(x, 0) + k
                a, b = find(x), find(y)
                up[max(a, b)] = min(a, b)
        if n:
            yield done()

    rows = ties.select("group", "y", "x", "n").unionByName(sizes)
    main = rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long")
    return of.join(main, "a", "left_semi").select(F.col("b").alias("node")).distinct()


def components(owned: DataFrame, share: Fraction, bound: int = TREE_MEMBERS) -> DataFrame:
    """(node, component) of sets (group, node, own) of at least this Jaccard similarity, links being sought within groups of any size."""
    threshold = Threshold(share.numerator, share.denominator)
    crowded = cut(owned.groupBy("group").agg(F.sum(F.length("own") / 8).cast("long").alias("members")).where(F.col("members") > bound).withColumn("group", F.expr("group + 0")))
    if crowded.isEmpty():
        return rooted(owned, threshold)
    large = large_links(owned.join(crowded, "group"), threshold, bound)
    return rooted(owned.join(crowded, "group", "left_anti"), threshold).unionByName(connected_components(large))


def join_classes(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, bound: int = TREE_MEMBERS) -> DataFrame:
    """doc_id, n_shingles, node (of equal sets; null for an empty one) and class (a node of its component) of each row: see join()."""
    threshold, secret = Threshold(num, den), vec.shingle_key(words)
    base = repeats.keyed(docs).select("d", "key", "doc_id", "text")

    def named(batches):
        for batch in batches:
            node, n = [], []
            for own in _hashed(batch.column(2), secret):
                node.append(_node(own) if len(own) else None)
                n.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int64())], ["key", "doc_id", "node", "n_shingles"])

    rows = cut(base.select("key", "doc_id", "text").mapInArrow(named, "key long, doc_id long, node long, n_shingles long"))
    clusters = cut(connected_components(_starred(meeting(docs, secret, threshold))).select("node", F.col("component").alias("group")))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("key").alias("key"))
    asked = cut(nodes.join(clusters, "node").select("key", "node", "group"))

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in _hashed(batch.column(1), secret)], pa.binary())], ["key", "own"])

    texts = repeats.picked(base.select("d", "key", "text"), repeats.key_bits(asked), True).select("key", "text").mapInArrow(sets, "key long, own binary")
    owned = cut(texts.join(asked, "key").dropDuplicates(["node"]).select("group", "node", "own"))
    parts = components(owned, Fraction(num, den), bound)
    return rows.join(parts, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("component", "node").alias("class"))


def join(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, bound: int = TREE_MEMBERS) -> DataFrame:
    """doc_id, n_shingles and component_id of each row: components of texts whose n-gram sets have a Jaccard similarity of num / den or more.

    A set is of distinct shingles of `words` words, A-Z lower-cased; a text of fewer words is one shingle. A text without
    words, or null, is linked with nothing: its component is its own doc_id. Texts of equal sets are linked; repeated rows stay
    rows of one component; a null doc_id is kept and counts as none for the least one, unless its component has no other; an empty table
    gives no rows; other columns are not read. Members are 64-bit hashes under a key drawn for the run.
    """
    found = cut(join_classes(docs, words, num, den, bound))
    least = found.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    some = found.where("class is not null").join(least.withColumn("class", F.expr("class + 0")), "class").select("doc_id", "n_shingles", "component_id")
    return some.unionByName(found.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
