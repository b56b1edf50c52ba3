"""Property graph: typed edges with provenance, and the closed library of graph patterns.

Nodes are (entity_id, name, type, aliases, normalized, mentions); edges (source_id, relation, target_id,
chunk_ids, confidence). Patterns match edges in both directions, and one match never uses an edge twice.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small, stored
from .store import top_n_per


#: In neighbour_jaccard(), sources of a target that are in one list, pairs that are made out at once, and of a stripe in one place; numbers in a stripe.
PIECE, PAIRS, PLACE, STRIPE = 512, 4_000_000, 8_000_000, 512


def merge_edges(assertions: DataFrame) -> DataFrame:
    """Edges of assertions (source_id, relation, target_id, chunk_id, confidence, ordinal): chunk ids in order of first sight, the highest confidence, null as 0.

    Assertions are shuffled once, by their ends; chunks are told apart and listed where they then lie. Ids are of any type.
    """
    dealt = assertions.repartition("source_id", "target_id")  # a relation may be one literal, which Spark drops from keys
    first = dealt.groupBy("source_id", "relation", "target_id", "chunk_id").agg(F.min("ordinal").alias("o"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("c"))
    merged = first.groupBy("source_id", "relation", "target_id").agg(F.sort_array(F.collect_list(F.struct("o", "chunk_id"))).alias("_c"), F.max("c").alias("confidence"))
    return merged.select("source_id", "relation", "target_id", F.filter(F.col("_c")["chunk_id"], lambda x: x.isNotNull()).alias("chunk_ids"), "confidence")


#: A table of edges, or what gives the edges that have one of some nodes (entity_id) at an end, and maybe more.
Edges = DataFrame | Callable[[DataFrame], DataFrame]


def edges_at(edges: Edges, ids: DataFrame) -> DataFrame:
    """Edges among which are all those at the nodes. What a function gives for them is stored, as it may be read more than once."""
    return cut(edges(ids.distinct())) if callable(edges) else edges


def both_ways(edges: DataFrame) -> DataFrame:
    """(edge, a, relation, b, forward, chunk_ids, confidence) of each edge seen from each end."""
    e = edges.withColumn("edge", F.xxhash64("source_id", "relation", "target_id"))
    out = e.select("edge", F.col("source_id").alias("a"), "relation", F.col("target_id").alias("b"), F.lit(True).alias("forward"), "chunk_ids", "confidence")
    back = e.where("source_id <> target_id").select("edge", F.col("target_id").alias("a"), "relation", F.col("source_id").alias("b"), F.lit(False).alias("forward"), "chunk_ids", "confidence")
    return out.unionByName(back)


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges at the seeds' (entity_id) nodes, source being the true tail."""
    s = seeds.select("entity_id").distinct()
    out = edges.join(s, edges.source_id == s.entity_id).select(F.col("entity_id").alias("seed_id"), "source_id", "relation", "target_id", "chunk_ids", "confidence")
    into = edges.join(s, edges.target_id == s.entity_id).select(F.col("entity_id").alias("seed_id"), "source_id", "relation", "target_id", "chunk_ids", "confidence")
    return out.unionByName(into).distinct().withColumn("hops", F.lit(1))


def paths(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Simple paths of `hops` edges from the seeds: node_0.., relation_1.., forward_1.., chunk_ids. Seeds are joined first, chunk ids last."""
    bi = both_ways(edges).drop("chunk_ids", "confidence")
    now = seeds.select(F.col("entity_id").alias("node_0")).distinct()
    for h in range(1, hops + 1):
        step = bi.select(F.col("edge").alias(f"edge_{h}"), F.col("a").alias(f"node_{h - 1}"), F.col("relation").alias(f"relation_{h}"), F.col("b").alias(f"node_{h}"), F.col("forward").alias(f"forward_{h}"))
        now = now.join(step, f"node_{h - 1}")
        for k in range(h):
            now = now.where(F.col(f"node_{h}") != F.col(f"node_{k}"))
            if k:
                now = now.where(F.col(f"edge_{h}") != F.col(f"edge_{k}"))
    return _with_chunks(now, edges, hops)


def _with_chunks(now: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """The columns of paths() for paths without chunk ids."""
    keep = [f"node_{k}" for k in range(hops + 1)] + [f"{w}_{k}" for k in range(1, hops + 1) for w in ("relation", "forward")]
    chunks = edges.select("source_id", "relation", "target_id", "chunk_ids")
    for h in range(1, hops + 1):
        ends = [F.when(F.col(f"forward_{h}"), F.col(f"node_{i}")).otherwise(F.col(f"node_{j}")) for i, j in ((h - 1, h), (h, h - 1))]
        own = chunks.select(F.col("source_id").alias("_s"), F.col("relation").alias(f"relation_{h}"), F.col("target_id").alias("_t"), F.col("chunk_ids").alias(f"chunks_{h}"))
        now = now.withColumns({"_s": ends[0], "_t": ends[1]}).join(own, ["_s", f"relation_{h}", "_t"]).drop("_s", "_t")
    return now.select(*keep, F.concat(*[F.col(f"chunks_{k}") for k in range(1, hops + 1)]).alias("chunk_ids"))


def first_two_hop(edges: Edges, seeds: DataFrame, limit: int) -> DataFrame:
    """The first `limit` paths of two edges from each seed, by relation_1, node_1, relation_2, node_2; columns of paths().

    All paths by a seed's earlier first edges come before those by later ones. So its first edges are tried in order, 4 * limit
    of them; a seed that then lacks paths and has more edges goes on with 16 times as many, up to all. Chunk ids are joined last.
    Edges may be a function, see edges_at(): it is asked for those at the seeds, and for those at the ends of edges that are tried.
    """
    one, two = ([F.col("edge").alias(f"edge_{h}"), F.col("a").alias(f"node_{h - 1}"), F.col("relation").alias(f"relation_{h}"), F.col("b").alias(f"node_{h}"), F.col("forward").alias(f"forward_{h}")] for h in (1, 2))
    left = small(seeds.select(F.col("entity_id").alias("node_0")).distinct())
    begin = _bare(edges_at(edges, left.select(F.col("node_0").alias("entity_id"))))
    tried, found = 4 * limit, None
    while True:
        first = begin.select(one).join(left, "node_0").where("node_1 <> node_0")
        first = small(top_n_per(first, ["node_0"], ["relation_1", "node_1", "forward_1"], tried + 1))
        place = F.row_number().over(Window.partitionBy("node_0").orderBy("relation_1", "node_1", "forward_1"))
        placed = first.withColumn("_p", place)
        more = placed.where(F.col("_p") > tried).select("node_0")
        step = small(placed.where(F.col("_p") <= tried).drop("_p"))
        further = edges_at(edges, step.select(F.col("node_1").alias("entity_id")))
        met = _bare(further).select(two).join(step, "node_1").where("node_2 <> node_0 and node_2 <> node_1 and edge_2 <> edge_1")
        best = cut(top_n_per(met, ["node_0"], ["relation_1", "node_1", "relation_2", "node_2", "forward_1", "forward_2"], limit))
        full = best.groupBy("node_0").agg(F.count("*").alias("_k")).where(F.col("_k") >= limit).select("node_0")
        left = small(more.join(full, "node_0", "left_anti"))
        done = _with_chunks(small(best.join(left, "node_0", "left_anti")), further, 2)  # both edges of a path are at node_1
        found = done if found is None else found.unionByName(done)
        if left.isEmpty():
            return found
        tried *= 16


def _bare(edges: DataFrame) -> DataFrame:
    return both_ways(edges).drop("chunk_ids", "confidence")


def two_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return paths(edges, seeds, 2)


def three_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return paths(edges, seeds, 3)


def shared_neighbour(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """start, relation_1, middle, relation_2, end for each pair (start, end)."""
    bi = both_ways(edges)
    p = small(pairs.select("start", "end").distinct())
    ends = small(p.select("end").distinct())
    left = p.join(bi.select(F.col("a").alias("start"), F.col("edge").alias("e1"), F.col("relation").alias("relation_1"), F.col("b").alias("middle"), F.col("chunk_ids").alias("c1")), "start")
    right = bi.select(F.col("a").alias("end"), F.col("edge").alias("e2"), F.col("relation").alias("relation_2"), F.col("b").alias("middle"), F.col("chunk_ids").alias("c2")).join(ends, "end", "left_semi")
    met = left.join(right, ["end", "middle"]).where("e1 <> e2 and middle <> start and middle <> end")
    return met.select("start", "relation_1", "middle", "relation_2", "end", F.concat("c1", "c2").alias("chunk_ids"))


def relation_of_type(edges: DataFrame, relation: str, known: tuple[str, ...], endpoint: str | None = None) -> DataFrame:
    """Edges of one known relation, at one end or at any."""
    if relation not in known:
        raise ValueError(f"unknown relation {relation}")
    found = edges.where(F.col("relation") == relation)
    return found if endpoint is None else found.where((F.col("source_id") == endpoint) | (F.col("target_id") == endpoint))


def count_by_relation(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, examples: int = 12) -> DataFrame:
    """seed, relation, degree (distinct neighbours) and the first names of these."""
    bi = both_ways(edges).join(seeds.select(F.col("entity_id").alias("a")).distinct(), "a").select("a", "relation", "b").distinct()
    named = bi.join(nodes.select(F.col("entity_id").alias("b"), "name"), "b")
    return named.groupBy(F.col("a").alias("seed_id"), "relation").agg(F.count_distinct("b").alias("degree"), F.slice(F.sort_array(F.collect_set("name")), 1, examples).alias("examples"))


def neighbourhood(edges: Edges, nodes: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the seeds, what they touch, and the edges at seeds. Edges may be a function, see edges_at()."""
    at = neighbours(edges_at(edges, seeds.select("entity_id")), seeds).drop("seed_id", "hops").distinct()
    ids = at.select(F.col("source_id").alias("entity_id")).union(at.select("target_id")).union(seeds.select("entity_id")).distinct()
    return nodes.join(ids, "entity_id", "left_semi"), at


def within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids."""
    return edges.join(ids.select(F.col("entity_id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("entity_id").alias("target_id")), "target_id", "left_semi")


def lookup(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes of that name, normalised name or alias, case ignored."""
    p = name.lower()
    return nodes.where((F.lower("name") == p) | (F.col("normalized") == p) | F.exists("aliases", lambda a: F.lower(a) == p))


def search(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes whose normalised name holds the text or is held by it."""
    p = F.lit(name.lower())
    return nodes.where(F.col("normalized").contains(p) | p.contains(F.col("normalized")))


def chunks_of(mentions: DataFrame, chunks: DataFrame, limit: int, order: str = "chunk_id") -> DataFrame:
    """Each entity's chunks with their columns: its surest mentions (entity_id, chunk_id, confidence) first, `limit` of them."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    best = mentions.groupBy("entity_id", "chunk_id").agg(F.max("confidence").alias("confidence")).join(chunks, "chunk_id")
    place = Window.partitionBy("entity_id").orderBy(F.desc_nulls_last("confidence"), order)
    return best.withColumn("position", F.row_number().over(place)).where(F.col("position") <= limit)


def reachable(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(seed_id, entity_id, hops): the fewest hops from each seed, up to `most`, by the ends of edges, which may repeat.

    A frontier join a step, cut each time; a small frontier is broadcast, so that edges are not shuffled.
    """
    bi = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    bi = bi.unionByName(bi.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = cut(seeds.select(F.col("entity_id").alias("seed_id"), "entity_id").distinct().withColumn("hops", F.lit(0)))
    frontier = small(seen)
    for h in range(1, most + 1):
        new = frontier.join(bi, frontier.entity_id == bi.a).select("seed_id", F.col("b").alias("entity_id")).distinct()
        frontier = small(new.join(seen, ["seed_id", "entity_id"], "left_anti").withColumn("hops", F.lit(h)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def pagerank(edges: DataFrame, steps: int = 10, damping: float = 0.85, together: int = 5) -> DataFrame:
    """(entity_id, rank) over directed edges, a fixed number of steps, dangling mass lost.

    `together` steps are one plan: its links are dealt by source once, as Spark uses their exchange again, ranks come dealt by
    node from the sums before, and what nodes give is the only thing that a step shuffles, summed partly before.
    """
    links = edges.select("source_id", "target_id").distinct()
    out = links.groupBy("source_id").agg(F.count("*").alias("degree"))
    flow = cut(links.join(out, "source_id"))
    ids = cut(flow.select(F.col("source_id").alias("entity_id")).union(flow.select("target_id")).distinct())
    nothing, ranks = ids.withColumn("r", F.lit(0.0)), ids.withColumn("rank", F.lit(1.0))
    for step in range(1, steps + 1):
        given = flow.join(ranks, flow.source_id == ranks.entity_id).select(F.col("target_id").alias("entity_id"), (F.col("rank") / F.col("degree")).alias("r"))
        ranks = given.unionByName(nothing).groupBy("entity_id").agg((F.lit(1 - damping) + damping * F.sum("r")).alias("rank"))
        if step % together == 0 and step < steps:
            ranks = cut(ranks)
    return ranks


def degrees(edges: DataFrame) -> DataFrame:
    """(entity_id, degree): how many of the edges, each given once, have the node at an end; a loop counts once."""
    ends = edges.select(F.col("source_id").alias("entity_id")).union(edges.where("source_id <> target_id").select("target_id"))
    return ends.groupBy("entity_id").agg(F.count("*").alias("degree"))


def neighbour_jaccard(edges: DataFrame, relation: str) -> DataFrame:
    """(left_id, right_id, similarity) of sources that share targets of a relation, by edges that may repeat.

    A source is a number, its own id if that is whole and not too large, with the number of its targets in the last bits. Sources are in stripes of near
    numbers; a target's list goes once to each stripe that it has sources of, from the first of these on. There a source's whole
    row of pairs is counted, so that no pair is shuffled. A stripe of more than about PLACE pairs is several places' work, by the larger number of a pair. A
    target's sources are in lists of about PIECE, of which each meets itself and those after it. A target that is null counts, but is not shared.
    """
    e = edges.where(F.col("relation") == relation).where("source_id is not null").select(F.col("source_id").alias("s"), F.col("target_id").alias("t"))
    known = e.groupBy("s").agg(F.count("*").alias("n")).agg(F.min("s").alias("least"), F.max("s").alias("most"), F.max("n").alias("n"), F.count("*").alias("sources")).first()
    bits, names = (known.n or 1).bit_length(), None
    whole = e.schema["s"].dataType.typeName() in ("byte", "short", "integer", "long")
    if not whole or known.sources and (known.least < 0 or int(known.most).bit_length() + bits > 62):
        names = cut(e.select("s").distinct().withColumn("_i", F.monotonically_increasing_id()))
        at, row = F.shiftright("_i", 33), F.col("_i").bitwiseAND((1 << 33) - 1)
        size = names.agg(F.max(at).alias("p"), F.max(row).alias("r")).first()
        if size.r is not None and ((size.p + 1) * (size.r + 1)).bit_length() + bits > 62:
            raise ValueError("too many sources and targets to be numbered")
        names = names.select("s", (row * (size.p or 0) + row + at).alias("i"))
        e = e.join(names, "s").select(F.col("i").alias("s"), "t")
    counted = e.repartition("s").distinct().withColumn("n", F.count("*").over(Window.partitionBy("s")))
    coded = counted.where("t is not null").select("t", F.shiftleft(F.col("s").cast("long"), bits).bitwiseOR(F.col("n")).alias("c")).repartition("t")
    piece = F.pmod(F.xxhash64("c"), F.ceil(F.col("k") / F.lit(PIECE))).cast("int")
    lists = coded.withColumn("k", F.count("*").over(Window.partitionBy("t"))).where("k > 1").withColumn("p", piece)
    lists = stored(lists.groupBy("t", "p", "k").agg(F.sort_array(F.collect_list("c")).alias("x")))
    pairs = lists.agg(F.sum(F.col("k").cast("double") * F.size("x")).alias("w")).first().w or 0.0
    shift = bits + max(0, min(STRIPE, int(PLACE * known.sources / max(pairs, 1.0))).bit_length() - 1)  # a stripe has PLACE pairs at most, if all are alike
    load = lists.select(F.explode("x").alias("c"), "k").groupBy(F.shiftright("c", shift).alias("g")).agg(F.sum(F.col("k") / 2).alias("w"))
    places = {r.g: int(-(-r.w // PLACE)) for r in load.where(F.col("w") > PLACE).collect()}  # the crowded ones alone
    crowded = lists.where(F.col("k") > PIECE).select("t", "p", "x")
    hub = crowded.join(crowded.select("t", F.col("p").alias("q"), F.col("x").alias("y")), "t").where("p < q").select("x", "y")
    met = lists.select("x", F.lit(None).cast("array<long>").alias("y")).unionByName(hub)
    found = met.mapInArrow(_to_stripes(shift, places), "g long, j int, own int, c array<long>").groupBy("g", "j").applyInArrow(_pairs_of_place(bits), "a long, b long, similarity double")
    if names is None:
        kind = edges.schema["source_id"].dataType
        return found.select(F.col("a").cast(kind).alias("left_id"), F.col("b").cast(kind).alias("right_id"), "similarity")
    named = found.join(names.select(F.col("i").alias("a"), F.col("s").alias("_a")), "a").join(names.select(F.col("i").alias("b"), F.col("s").alias("_b")), "b")
    return named.select(F.least("_a", "_b").alias("left_id"), F.greatest("_a", "_b").alias("right_id"), "similarity")


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, `size` of them, for each."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


def _portions(size: np.ndarray, most: int):
    """Slices whose sizes are about `most` together, or one alone."""
    cut = np.searchsorted(np.cumsum(size), np.arange(most, size.sum() + most, most), "right").tolist()
    edges = sorted({0, *cut, len(size)})
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _to_stripes(shift: int, places: dict[int, int]):
    """Of lists of sources (x, y, of which y may be null), rows for stripes: the stripe, its place, how many codes are its own, and the codes.

    Own ones come first, the others follow. Of y null, own ones meet each other and all others; their number is negative if
    they meet larger others alone.
    """
    many = np.array(sorted(places), np.int64)

    def across(own, other):
        stripe = own >> shift
        for at in np.split(np.arange(len(own)), np.flatnonzero(np.diff(stripe)) + 1):
            mine, g = own[at], int(stripe[at[0]])
            over, k = other[np.searchsorted(other, mine[0], "right") :], places.get(g, 1)
            place = (over * 0x9E3779B1 >> 13) % k if k > 1 else np.zeros(len(over), np.int64)
            for j in range(k):
                if (place == j).any():
                    yield g, j, -len(mine), np.concatenate([mine, over[place == j]])

    def rows(found):
        found = list(found)
        if found:
            g, j, own, codes = zip(*found)
            ends = np.cumsum([0, *map(len, codes)])
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(j, pa.int32()), pa.array(own, pa.int32()), _listed(ends, np.concatenate(codes))], ["g", "j", "own", "c"])

    def run(batches):
        for batch in batches:
            x, y = batch.column(0), batch.column(1)
            size = x.value_lengths().to_numpy().astype(np.int64)
            for part in _portions(size * size, PAIRS):
                codes, end = x.slice(part.start, part.stop - part.start).flatten().to_numpy(), np.cumsum(size[part])
                alone = np.repeat(y.slice(part.start, part.stop - part.start).is_null().to_numpy(zero_copy_only=False), size[part])
                of, stripe = np.repeat(np.arange(len(end)), size[part]), codes >> shift
                new = np.ones(len(codes), bool)
                new[1:] = (of[1:] != of[:-1]) | (stripe[1:] != stripe[:-1])
                first = np.flatnonzero(new)
                own, last = np.diff(np.append(first, len(codes))), end[of[first]]
                plain = alone[first] & (last - first > 1)
                crowd = plain & np.isin(stripe[first], many)
                for f, m, e in zip(first[crowd].tolist(), own[crowd].tolist(), last[crowd].tolist()):
                    yield from rows(across(codes[f : f + m], codes[f:e]))
                plain &= ~crowd
                f, m, n = first[plain], own[plain], (last - first)[plain]
                if len(f):
                    ends = np.append(0, np.cumsum(n))
                    yield pa.RecordBatch.from_arrays([pa.array(stripe[f]), pa.array(np.zeros(len(f), np.int32)), pa.array(m.astype(np.int32)), _listed(ends, codes[_ranges(f, n)])], ["g", "j", "own", "c"])
            for i in np.flatnonzero(y.is_valid().to_numpy(zero_copy_only=False)).tolist():
                one, two = x[i].values.to_numpy(), y[i].values.to_numpy()
                yield from rows(across(one, two))
                yield from rows(across(two, one))

    return run


def _listed(ends: np.ndarray, codes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(codes))


def _pairs_of_place(bits: int):
    """The pairs that meet in one place of a stripe, with their similarity."""

    def merged(keys, counts):
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts

    def counted(keys):
        keys = np.sort(keys)
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
        return keys[first], np.diff(np.append(first, len(keys)))

    def run(table: pa.Table) -> pa.Table:
        own = table["own"].to_numpy().astype(np.int64)
        lists = table["c"].combine_chunks()
        size = lists.value_lengths().to_numpy().astype(np.int64)
        codes = lists.flatten().to_numpy()
        known, _ = counted(codes)
        at, end, mine = np.searchsorted(known, codes), np.cumsum(size), np.abs(own)
        # each own source with what it meets: those after it in its list, or all others there
        left = _ranges(end - size, mine)
        of = np.repeat(np.arange(len(own)), mine)
        right = np.where(own[of] > 0, left + 1, (end - size + mine)[of])
        meets, held, n = end[of] - right, [], 0
        for part in _portions(meets, PAIRS):
            a, b = np.repeat(at[left[part]], meets[part]), at[_ranges(right[part], meets[part])]
            held.append(counted((a * len(known) + b)[a < b]))
            n += len(held[-1][0])
            if n > 2 * PAIRS:
                held = [merged(*map(np.concatenate, zip(*held)))]
                n = 0
        keys, common = merged(*map(np.concatenate, zip(*held))) if held else (np.empty(0, np.int64),) * 2
        a, b = known[keys // max(1, len(known))], known[keys % max(1, len(known))]
        x, y = (v & ((1 << bits) - 1) for v in (a, b))
        return pa.table({"a": a >> bits, "b": b >> bits, "similarity": common / (x + y - common)})

    return run


#: The closed library: names that a caller may ask for.
TEMPLATES = {"NEIGHBOURS": neighbours, "TWO_HOP": two_hop, "THREE_HOP": three_hop, "SHARED_NEIGHBOUR": shared_neighbour, "RELATION_OF_TYPE": relation_of_type, "COUNT_BY_RELATION": count_by_relation, "NEIGHBOURHOOD_GRAPH": neighbourhood, "ENTITY_LOOKUP": lookup, "ENTITY_SEARCH": search}


def joined(c: Column) -> Column:
    """A list of strings as one string, for results."""
    return F.array_join(c, "|")
