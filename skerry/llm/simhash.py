"""SimHash fingerprints and near-duplicate components by pigeonhole blocks; similar() adds min-hashes.

Fingerprints of 64 bits are cut into `blocks` pieces. Two that differ in at most `distance` bits agree on
blocks - distance of them, so each choice of that many blocks is a key, and rows are joined on the keys.
Equal fingerprints are one row before that. Within a key's bucket the candidates are verified by Hamming
distance and leave as a spanning forest, never as pairs. Buckets of more than `crowd` fingerprints (groups of
near copies) are not compared: their fingerprints go to an exact way for crowds. Two fingerprints differ in
at most 2r bits only if both are within r bits of some third string of 64 bits, so each is sent to all
strings within r bits, and those that meet at one are linked to the least of them. That is linear in the
crowd, and a link is lost nowhere.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut
from . import prefix_tree, repeats, vec

BITS = 64


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of one text; see fingerprints()."""
    return int(_prints([text], words)[0])


def _prints(texts: list[str | None], words: int) -> np.ndarray:
    digest, back = xxhash.xxh64_intdigest, words - 1
    hashes: list[int] = []
    counts = []
    for text in texts:
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII space
        if not parts:
            counts.append(0)
            continue
        whole = b" ".join(parts)
        ends, at = [], -1
        for p in parts:
            at += len(p) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends[:-1]]]
        n = max(1, len(parts) - back)
        hashes += [digest(whole[s:e], 42) for s, e in zip(starts, ends[back:] or ends[-1:])]
        counts.append(n)
    out = np.zeros(len(texts), np.uint64)
    if hashes:
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        n = np.array(counts)
        some = np.flatnonzero(n)
        at = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        on = (2 * ones > n[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint of each whole text, as a signed long.

    Words are what ASCII white space leaves, A-Z lower-cased; a shingle is `words` of them, joined by one
    space, with repeats; a text of fewer is one shingle, one without words (or null) has fingerprint zero. A
    bit is set if it is in over half of the shingles' XXH64 (seed 42).
    """

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, 1, 64, 1 << 20):
                fp = _prints(part.column(1).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


#: Min-hashes of similar(): a pair of Jaccard similarity J agrees on a band of ROWS with chance J^ROWS.
BANDS, ROWS = 20, 6


def _sets(column, key: list[int]):
    """The sorted set of shingle hashes of each text of a column; shingles are those of fingerprints(), hashed under a key of the run."""
    for _, buf, offsets in vec.text_chunks(column):
        hashes, at = vec.shingles(buf, offsets, key)
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            yield np.unique(hashes[s:e])


_SEEDS = vec.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(vec.BASES[1])) | np.uint64(1)


def _bands(own: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of ROWS minima, each by its own odd multiplier."""
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2048):
        x = own[at : at + 2048] * _SEEDS[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9FB21C651E98DF25)
        np.minimum(least, x.min(axis=1), out=least)
    with np.errstate(over="ignore"):
        rows = vec.mix(least + np.tile(np.arange(ROWS, dtype=np.uint64), BANDS)).reshape(BANDS, ROWS)
        return vec.mix(np.bitwise_xor.reduce(rows, axis=1) + np.arange(BANDS, dtype=np.uint64))


_EDGE = ["a", "b"]


def _near_prints(rows: DataFrame) -> DataFrame:
    """(a, b): edges of nodes whose fingerprints are linked as near_duplicates() links them, as few as connect the same ones. A node has those of all its texts."""
    own = cut(rows.distinct())
    lead = own.groupBy("fp").agg(F.min("node").alias("a"))
    equal = own.join(lead, "fp").where("node <> a").select("a", F.col("node").alias("b"))
    near = links(own).select(F.col("a").alias("fp"), F.col("b").alias("_f"))
    near = near.join(lead, "fp").join(lead.select(F.col("fp").alias("_f"), F.col("a").alias("b")), "_f").where("a <> b")
    return equal.unionByName(near.select("a", "b"))


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, members: int = prefix_tree.TREE_MEMBERS) -> DataFrame:
    """key (of doc_id and text, as repeats.keyed has it), doc_id and class of each row: see similar()."""
    base, secret = repeats.keyed(docs), vec.shingle_key(words)

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, 2, 64, 1 << 20):
                node, keys = [], []
                for own in _sets(part.column(2), secret):
                    node.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                    keys.append(_bands(own).tobytes() if len(own) else None)
                fp = _prints(part.column(2).to_pylist(), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(keys, pa.binary()), pa.array(fp)], ["key", "doc_id", "node", "bands", "fp"])

    rows = cut(base.select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, node long, bands binary, fp long"))
    nodes = rows.where("bands is not null").groupBy("node").agg(F.min(F.struct("key", "bands")).alias("m")).select("node", "m.*")

    def keyed(batches):
        for batch in batches:
            band = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["band", "node"])

    def bucket(batches):
        key = lead = None
        for batch in batches:
            band, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(band):
                continue
            new = np.concatenate([[True], band[1:] != band[:-1]])
            first = node[np.maximum.accumulate(np.where(new, np.arange(len(band)), 0))]
            if key == band[0]:
                first[: np.argmax(~(band == band[0])) if (band != band[0]).any() else len(band)] = lead
            key, lead = band[-1], first[-1]
            pair = node != first
            yield pa.RecordBatch.from_arrays([pa.array(first[pair]), pa.array(node[pair])], _EDGE)

    met = nodes.select("node", "bands").mapInArrow(keyed, "band long, node long")
    candidates = met.repartition("band").sortWithinPartitions("band", "node").mapInArrow(bucket, "a long, b long").unionByName(_near_prints(rows.where("bands is not null").select("node", "fp"))).distinct()
    clusters = cut(connected_components(candidates).select("node", F.col("component").alias("cluster")))
    asked = cut(nodes.select("node", "key").join(clusters, "node"))

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in _sets(batch.column(1), secret)], pa.binary())], ["key", "own"])

    texts = repeats.picked(base.select("d", "key", "text"), repeats.key_bits(asked), True).select("key", "text")
    owned = cut(texts.mapInArrow(sets, "key long, own binary").groupBy("key").agg(F.first("own").alias("own")).join(asked, "key").select(F.col("cluster").alias("group"), "node", "own"))
    parts = prefix_tree.components(owned, Fraction(similarity).limit_denominator(1000), members)
    return rows.join(parts, "node", "left").select("key", "doc_id", F.coalesce("component", "node").alias("class"))


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, members: int = prefix_tree.TREE_MEMBERS) -> DataFrame:
    """doc_id and component_id of documents whose sets of word shingles are alike by `similarity` (Jaccard) or more.

    Candidates are texts whose fingerprints are linked, as in near_duplicates() but of `words` words. The similarity may be
    too far for these 4 bits, so candidates are also texts that share one of 20 bands of 6 min-hashes: a chance of 0.9977 at a similarity of 0.8, 0.9999 at 0.85, all but 1 at 0.9. Texts of one set
    are one node. Nodes that share a band are linked to the bucket's least, and what hangs together so is a
    cluster; in it all pairs, sharing a band or not, count by their exact similarity, found by prefix
    trees. Clusters of more than `members` members are not brought together, but dealt to trees of that size
    (prefix_tree.components); that finds the same links. Edge cases are those of near_duplicates().
    """
    found = similar_classes(docs, words, similarity, members)
    least = found.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "class").select("doc_id", "component_id")


def first_of_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """text and rest (the other columns) of one row of each class of similar(): that of the least doc_id, those without one coming last.

    Rows are told apart by doc_id and text, and those that agree in both are one. Texts that are like no
    other are not shuffled.
    """
    found = cut(similar_classes(docs, words, similarity))
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")
    first = cut(found.groupBy("class").agg(F.count("*").alias("n"), F.min(order).alias("m")).select("class", "n", "m.key"))
    base, bits = repeats.keyed(docs), repeats.key_bits(found.join(first.where("n > 1").select("class"), "class", "left_semi"))
    some = repeats.picked(base, bits, True).join(first.select("key"), "key", "left_semi").dropDuplicates(["key"])
    return some.select("text", "rest").unionByName(repeats.picked(base, bits, False).select("text", "rest"))


def _masks(blocks: int, distance: int) -> list[int]:
    edges = np.linspace(0, BITS, blocks + 1).astype(int)
    piece = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(piece[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def _forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that join what is within `distance` of each other, as few as connect the same fingerprints."""
    out = []
    left = np.arange(len(fp))
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            x = fp[left]
            reached = np.full(len(left), -1)
            for i in front:
                near = (np.bitwise_count(x ^ fp[i]) <= distance) & (reached < 0)
                reached[near] = i
            new = reached >= 0
            out += list(zip(reached[new].tolist(), left[new].tolist()))
            front, left = left[new], left[~new]
    return out


def links(prints: DataFrame, distance: int = 4, blocks: int = 7, crowd: int = 256) -> DataFrame:
    """(a, b): links among distinct fingerprints that connect the same ones as all links together do."""
    masks = _masks(blocks, distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    distinct = prints.select("fp").where("fp is not null").distinct()
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])).alias("k")).select("k.*", "fp")
    dealt = keyed.repartition("i", "key").sortWithinPartitions("i", "key", "fp")

    def bucket(batches):
        """Streams sorted buckets, holding one of at most `crowd` fingerprints; a kind-1 row is one of a crowd."""
        held = np.empty(0, np.int64)
        key, crowded = None, False
        for batch in batches:
            i, k, f = (batch.column(c).to_numpy() for c in range(3))
            new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (k[1:] != k[:-1])]))
            kinds, a, b = [], [], []

            def close():
                if not crowded and len(held) > 1:
                    for x, y in _forest(held.view(np.uint64), distance):
                        kinds.append(0)
                        a.append(int(held[x]))
                        b.append(int(held[y]))

            size = np.diff(np.append(new, len(f)))
            for s, n in zip(new.tolist(), size.tolist()):
                this = (int(i[s]), int(k[s]))
                if this != key:
                    close()
                    key, held, crowded = this, f[s : s + n], False
                else:
                    held = np.concatenate([held, f[s : s + n]])
                if len(held) > crowd or crowded:
                    crowded = True
                    kinds += [1] * len(held)
                    a += held.tolist()
                    b += held.tolist()
                    held = held[:0]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])
        if not crowded and len(held) > 1:
            found = [(int(held[x]), int(held[y])) for x, y in _forest(held.view(np.uint64), distance)]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(found), pa.int32()), pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["kind", "a", "b"])

    found = cut(dealt.mapInArrow(bucket, "kind int, a long, b long").distinct())
    crowds = found.where("kind = 1").select(F.col("a").alias("fp"))
    near = found.where("kind = 0").select("a", "b")
    if crowds.isEmpty():
        return near
    return near.unionByName(crowd_links(crowds, distance))


def crowd_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links of a crowd by meeting points: all strings within (distance + 1) // 2 bits of each fingerprint."""
    radius = (distance + 1) // 2
    flips = [0]
    for r in range(1, radius + 1):
        flips += [sum(1 << b for b in c) for c in combinations(range(BITS), r)]
    flips = np.array(flips, np.uint64)

    def ball(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 16):
                part = fp[at : at + 16]
                meet = (part.view(np.uint64)[:, None] ^ flips[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(meet), pa.array(np.repeat(part, len(flips)))], ["meet", "fp"])

    met = prints.mapInArrow(ball, "meet long, fp long")
    if distance % 2:  # two that meet may then differ in one bit too many: check each against the least
        raise ValueError("an odd distance has no exact meeting points")
    least = met.groupBy("meet").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count("*").alias("n")).where("n > 1")
    pairs = least.where("n = 2").select("a", F.col("z").alias("b"))
    more = met.join(least.where("n > 2").select("meet", "a"), "meet").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(more).distinct()


def near_duplicates(docs: DataFrame, distance: int = 4, words: int = 4, blocks: int = 7, crowd: int = 256) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable) of each document.

    Null texts have fingerprint zero and link like any other; repeated rows stay rows of one component; a
    null doc_id is kept and counts as no doc_id for the least; an empty table gives no rows; other columns
    are not read. Memory of a task is bounded by `crowd`, whatever the sizes of groups.
    """
    prints = cut(fingerprints(docs, words))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    edges = links(prints, distance, blocks, crowd)
    parts = connected_components(edges)
    named = parts.join(nodes, parts.node == nodes.fp).select("component", "fp", nodes.node.alias("first"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    classes = nodes.join(named.join(least, "component").select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "node").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
