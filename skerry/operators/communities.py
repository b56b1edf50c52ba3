"""Communities by votes of neighbours, and centrality by shortest paths."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small

#: Links that a block has about, each way counted; whole numbers of nodes of which so many in a row stay together; rounds that are one plan.
BLOCK, STRIPE, TOGETHER = 1_000_000, 4096, 5


def undirected(links: DataFrame) -> DataFrame:
    """(a, b) both ways, once each, without loops, of links given by their first two columns."""
    x, y = links.columns[:2]
    one = links.select(F.col(x).alias("a"), F.col(y).alias("b"))
    return one.unionByName(links.select(F.col(y).alias("a"), F.col(x).alias("b"))).where("a <> b").distinct()


def blocks(links: DataFrame) -> DataFrame:
    """(block, a, b): links given by their first two columns, both ways, without loops, dealt to blocks; repeated links are still there, in one block.

    A block has the links of some stripes of nodes: of STRIPE whole numbers in a row, as neighbours of near numbers are often the same, or of equal
    hashes. A stripe of more than BLOCK links goes to blocks of its own, below 0, by the other end. As Spark uses an exchange again, links are
    shuffled once for all that a plan does with them.
    """
    if links.columns == ["block", "a", "b"]:
        return links
    x, y = (F.col(c) for c in links.columns[:2])
    ways = F.explode(F.array(F.struct(x.alias("a"), y.alias("b")), F.struct(y.alias("a"), x.alias("b"))))
    both = links.where(x != y).select(ways.alias("_w")).select("_w.a", "_w.b")
    whole = both.schema["a"].dataType.typeName() in ("byte", "short", "integer", "long")
    both = both.withColumn("_s", F.floor(F.col("a") / STRIPE) if whole else F.pmod(F.xxhash64("a"), F.lit(1 << 16)))
    sizes = cut(both.groupBy("_s").agg(F.count("*").alias("n")))
    some = max(1, -(-(sizes.agg(F.sum("n").alias("n")).first().n or 0) // BLOCK))
    heavy = small(sizes.where(F.col("n") > BLOCK).select("_s", F.ceil(F.col("n") / F.lit(BLOCK)).alias("_k")))
    apart = -1 - F.pmod(F.xxhash64("_s", F.pmod(F.xxhash64("b"), F.col("_k"))), F.lit(1 << 40))
    block = F.when(F.col("_k").isNull(), F.pmod(F.xxhash64("_s"), F.lit(some))).otherwise(apart)
    return both.join(heavy, "_s", "left").select(block.alias("block"), "a", "b").repartition("block")


def _needed(dealt: DataFrame, *ends: str) -> DataFrame:
    """(block, node): the nodes at these ends of a block's links, once each."""

    def distinct(table: pa.Table) -> pa.Table:
        nodes = pa.chunked_array([c for e in ends for c in table[e].chunks], table["a"].type).unique()
        return pa.table({"block": pa.repeat(table["block"][0], len(nodes)), "node": nodes})

    return dealt.groupBy("block").applyInArrow(distinct, f"block long, node {dealt.schema['a'].dataType.simpleString()}")


def _codes(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], pa.Array]:
    """Each column as numbers of values, and the values."""
    found = pa.chunked_array([c for x in columns for c in x.chunks], columns[0].type).combine_chunks().dictionary_encode()
    return np.split(found.indices.to_numpy().astype(np.int64), np.cumsum([len(x) for x in columns])[:-1]), found.dictionary


def _counted(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers in order, and how often each is there."""
    numbers = np.sort(numbers)
    first = np.flatnonzero(np.diff(numbers, prepend=numbers[:1] - 1))
    return numbers[first], np.diff(np.append(first, len(numbers)))


def _labelled(links: pa.Table, sent: pa.Table):
    """A block's links once each as numbers of nodes, the nodes, the number of each node's label (-1 without) and the labels, in their order."""
    (a, b, node), nodes = _codes(links["a"], links["b"], sent["node"])
    (label,), labels = _codes(sent["label"])
    order = pc.sort_indices(labels).to_numpy().astype(np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    of = np.full(len(nodes), -1)
    of[node] = place[label]
    pair, _ = _counted(a * len(nodes) + b)
    return pair // len(nodes), pair % len(nodes), nodes, of, labels.take(pa.array(order))


def label_propagation(links: DataFrame, rounds: int = 5, name: Callable[[Column], Column] = lambda node: node) -> DataFrame:
    """(node, label) after so many rounds, of links or of their blocks().

    All nodes start with their own name and vote at once: each takes the label that most neighbours have, of equals the
    least. A round sends a node's label once to each block that has a neighbour, not along each link; a node's votes are counted in
    its block, those of a stripe in several blocks once more, so a hub's neighbours are never gathered. With nodes as numbers, `name` makes the labels.
    """
    dealt = blocks(links)
    needed = _needed(dealt, "b")
    start = needed.withColumn("label", name(F.col("node")))
    kinds = [d.dataType.simpleString() for d in (start.schema["node"], start.schema["label"])]

    def votes(links: pa.Table, sent: pa.Table) -> pa.Table:
        a, b, nodes, of, labels = _labelled(links, sent)
        there, some = of[b] >= 0, max(1, len(labels))
        k, n = _counted(a[there] * some + of[b[there]])
        a, label = k // some, k % some
        if len(a) and links["block"][0].as_py() >= 0:  # all votes are here
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            most = np.flatnonzero(n == np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(a)))))
            won = most[np.concatenate([[True], a[most][1:] != a[most][:-1]])]
            a, label, n = a[won], label[won], n[won]
        return pa.table({"node": nodes.take(pa.array(a)), "label": labels.take(pa.array(label)), "n": pa.array(n, pa.int64())})

    labels = None
    for step in range(1, rounds + 1):
        sent = start if labels is None else needed.join(labels, "node").select("block", "node", "label")
        counted = dealt.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(votes, f"node {kinds[0]}, label {kinds[1]}, n long")
        counted = counted.repartition("node").groupBy("node", "label").agg(F.sum("n").alias("n"))
        won = counted.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("less"), "label")).alias("m"))
        labels = won.select("node", F.col("m.label").alias("label"))
        if step % TOGETHER == 0 and step < rounds:
            labels = cut(labels)
    return labels if labels is not None else start.select("node", "label").distinct()


def modularity(links: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the share of links inside communities less what degrees alone would give, of links or of their blocks(), labels being sent to these."""
    dealt = blocks(links)
    sent = _needed(dealt, "a", "b").join(labels.select("node", "label"), "node").select("block", "node", "label")

    def counts(links: pa.Table, sent: pa.Table) -> pa.Table:
        a, b, _, of, labels = _labelled(links, sent)
        x, y = of[a], of[b]
        x, y = x[(x >= 0) & (y >= 0)], y[(x >= 0) & (y >= 0)]
        degree, inside = np.bincount(x, minlength=len(labels)), np.bincount(x[x == y], minlength=len(labels))
        seen = np.flatnonzero(degree)
        return pa.table({"x": labels.take(pa.array(seen)), "degree": degree[seen], "inside": inside[seen]})

    both = dealt.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(counts, f"x {labels.schema['label'].dataType.simpleString()}, degree long, inside long")
    by = both.groupBy("x").agg(F.sum("degree").alias("degree"), F.sum("inside").alias("inside"))
    total = by.agg(F.sum("degree").alias("m"))
    return by.crossJoin(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("degree") / F.col("m"), F.lit(2))).alias("modularity"))  # one row


def betweenness(links: DataFrame, sources: DataFrame, most: int = 20) -> DataFrame:
    """(node, betweenness) from the shortest paths that begin at the sources (column node), of at most `most` links.

    Forward, each level of each source counts the shortest paths to its nodes; backward, each node hands its share to the
    nodes it was reached by. With all nodes as sources each pair counts twice, as pairs are of either order.
    """
    both = cut(undirected(links))
    start = cut(sources.select(F.col("node").alias("source"), "node").distinct().withColumns({"paths": F.lit(1.0), "level": F.lit(0)}))
    seen, levels = start, [start]
    for level in range(1, most + 1):
        step = levels[-1].join(both, levels[-1]["node"] == both["a"]).groupBy("source", F.col("b").alias("node")).agg(F.sum("paths").alias("paths"))
        new = cut(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("level", F.lit(level)))
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionByName(new)
    found, below = None, None
    for reached in reversed(levels[1:]):
        if below is None:
            here = reached.withColumn("share", F.lit(0.0))
        else:
            given = below.select("source", F.col("node").alias("b"), ((1 + F.col("share")) / F.col("paths")).alias("_c")).join(both, "b").groupBy("source", F.col("a").alias("node")).agg(F.sum("_c").alias("_c"))
            here = reached.join(given, ["source", "node"], "left").withColumn("share", F.coalesce(F.col("paths") * F.col("_c"), F.lit(0.0))).drop("_c")
        below = cut(here)
        found = below if found is None else found.unionByName(below)
    every = both.select(F.col("a").alias("node")).distinct()
    if found is None:
        return every.withColumn("betweenness", F.lit(0.0))
    total = found.groupBy("node").agg(F.sum("share").alias("betweenness"))
    return every.join(total, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def harmonic(hops: DataFrame) -> DataFrame:
    """(entity_id, harmonic): sum of 1 / hops over the seeds that reach a node, of (seed_id, entity_id, hops)."""
    return hops.where("hops > 0").groupBy("entity_id").agg(F.sum(1 / F.col("hops")).alias("harmonic"))
