"""Steps that must not gather, store or shuffle more than a query needs, each beside a plain version."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.plans.registry import QUERIES  # before plans.graph, which it imports

from skerry.operators import ann, communities, evaluate, overlap
from skerry.operators import graph as G
from skerry.operators import hybrid as H
from skerry.plans import graph as P
from skerry.plans import retrieval

SF = "/root/testdata/sf0.001"
EDGE = "source_id string, relation string, target_id string, chunk_ids array<string>, confidence double"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["relation_of_type", "degree", "communities", "neighbour_similarity"])
def test_patterns_without_chunks_store_no_edges(spark, monkeypatch, name):
    monkeypatch.setattr(P, "_STORED", {})

    def none(*_):
        raise AssertionError("edges were stored")

    monkeypatch.setattr(P, "scratch", none)
    assert QUERIES[name](spark, SF).count() > 0


def test_edges_are_merged_in_one_shuffle(spark):
    rows = [("a", "r", "b", "c2", 0.5, 2), ("a", "r", "b", "c1", None, 1), ("a", "r", "b", "c2", 0.7, 0), ("a", "r", "b", None, 0.1, 5), ("b", "r", "a", "c1", None, 1)]
    merged = G.merge_edges(spark.createDataFrame(rows, "source_id string, relation string, target_id string, chunk_id string, confidence double, ordinal int"))
    assert _plan(merged).count("Exchange hashpartitioning") == 1
    got = {(r.source_id, r.target_id): (r.chunk_ids, r.confidence) for r in merged.collect()}
    assert got == {("a", "b"): (["c2", "c1"], 0.7), ("b", "a"): (["c1"], 0.0)}


def test_shared_neighbour_takes_edges_at_both_ends_alone(spark):
    edges = spark.createDataFrame([("x", "r", "m", ["1"], 1.0), ("y", "r", "m", ["2"], 1.0), ("z", "r", "m", ["3"], 1.0), ("m", "s", "y", ["4"], 1.0)], EDGE)
    found = G.shared_neighbour(edges, spark.createDataFrame([("x", "y")], "start string, end string"))
    assert "LeftSemi" in _plan(found)
    assert sorted((r.start, r.relation_1, r.middle, r.relation_2, r.end, tuple(r.chunk_ids)) for r in found.collect()) == [("x", "r", "m", "r", "y", ("1", "2")), ("x", "r", "m", "s", "y", ("1", "4"))]


def test_neighbour_jaccard_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(G, "PIECE", 4)
    monkeypatch.setattr(G, "PAIRS", 7)
    of = {f"s{i}": {"hub"} | {f"t{i % 3}", f"u{i % 5}"} for i in range(19)} | {"lone": {"other"}}
    edges = spark.createDataFrame([(s, "R", t) for s, ts in of.items() for t in ts] * 2, "source_id string, relation string, target_id string")
    want = {(a, b): len(of[a] & of[b]) / len(of[a] | of[b]) for a, b in combinations(sorted(of), 2) if of[a] & of[b]}
    got = G.neighbour_jaccard(edges, "R").collect()
    assert len(got) == len(want) and {(r.left_id, r.right_id): r.similarity for r in got} == want


def test_shortest_path_stores_bare_ends(spark, monkeypatch):
    monkeypatch.setattr(P, "_STORED", {})
    made, scratch = [], P.scratch
    monkeypatch.setattr(P, "scratch", lambda s, name: made.append(name) or scratch(s, name))
    assert QUERIES["shortest_path"](spark, SF).count() > 0
    assert made == ["ends"]


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_first_paths_are_the_first_of_all(spark, limit):
    rows = [("s", "r", f"m{i:03d}", [f"c{i}"], 1.0) for i in range(60)]  # most lead nowhere
    rows += [(f"m{i:03d}", "q", f"n{j}", [f"d{i}.{j}"], 1.0) for i in (37, 52, 59) for j in range(2)] + [("t", "q", "s", ["e"], 1.0), ("u", "q", "v", ["f"], 1.0)]
    edges = spark.createDataFrame(rows, EDGE)
    seeds = spark.createDataFrame([("s",), ("t",), ("u",)], "entity_id string")
    order = ["node_0", "relation_1", "node_1", "relation_2", "node_2"]
    every, want = sorted(tuple(r[c] for c in [*order, "chunk_ids"]) for r in G.two_hop(edges, seeds).collect()), []
    for s in "stu":
        want += [p for p in every if p[0] == s][:limit]
    assert sorted(tuple(r[c] for c in [*order, "chunk_ids"]) for r in G.first_two_hop(edges, seeds, limit).collect()) == want


def test_facts_do_not_list_all_paths(spark, monkeypatch):
    def none(*_):
        raise AssertionError("all paths of two edges were listed")

    monkeypatch.setattr(G, "paths", none)
    edges = spark.createDataFrame([("s", "R", "m", ["1"], 1.0), ("m", "R", "n", ["2"], 1.0)], EDGE)
    nodes = spark.createDataFrame([(x, x.upper()) for x in "smn"], "entity_id string, name string")
    facts = H.graph_facts(spark.createDataFrame([(1, 0, "s")], "question_id long, position int, entity_id string"), edges, nodes, 5)
    assert sorted((r.hops, tuple(r.chunk_ids)) for r in facts.collect()) == [(1, ("1",)), (2, ("1", "2"))]


def test_grams_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "a b a", "a a c"), (1, "c", "d"), (2, None, "")], "k int, x string, y string")
    found = overlap.clipped(df, ["k"], "x", "y", 2)
    assert "Generate" not in _plan(found)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 3, 4, 4), (1, 2, 0, 2, 2)]


def test_gold_of_categories(spark):
    q = spark.createDataFrame([(1, "a"), (2, "a"), (9, "a"), (5, "b"), (7, "c")], "question_id long, category string")
    gold = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 3), ("b", 5)], "category string, item long")
    pairs = q.join(gold, "category").where("item <> question_id").select("question_id", "item")
    ranked = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (2, 5, 1), (5, 5, 1), (9, 2, 1), (9, 3, 2)], "question_id long, item long, rank int")
    got, want = ([tuple(r) for r in evaluate.run_benchmark(q, g, {"m": ranked}).orderBy("question_id").collect()] for g in (gold, pairs))
    assert got == want and [r[4] for r in got] == [2, 2, 0, 0, 3]


def test_label_lists_are_cut_before_questions_join(spark):
    plan = retrieval.ranked_lists(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(label" in plan


def _vectors(spark, n, dim=12, labels=3):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[n // 2] = x[0]
    x[1] = 0
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, rng.integers(0, labels, n)))]
    odd = [(n, None, 0), (n + 1, [None] * dim, 0), (n + 2, [1.0, 2.0], 0), (n + 3, [2.0, 4.0], 0), (n + 4, x[2].tolist(), None)]
    return x, [r[2] for r in rows], spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("piece", [8192, 9])
def test_similarity_join_meets_in_pieces(spark, monkeypatch, piece):
    """Pairs are scored where pieces meet, and none is a row of a Spark join."""
    monkeypatch.setattr(ann, "PIECE", piece)
    monkeypatch.setattr(ann, "PAIRS", 50)
    x, label, df = _vectors(spark, 90)
    found = ann.similarity_join(df, "label", 0.3)
    assert "a_id#" not in "".join(line for line in _plan(found).splitlines() if "Join" in line) and "MapInArrow" in _plan(found)
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    want = {(a, b): round(float(unit[a] @ unit[b]), 6) for a, b in combinations(range(90), 2) if label[a] == label[b] and unit[a] @ unit[b] >= 0.3}
    got = found.collect()
    assert len(got) == len(want) + 1 and {(r.a_id, r.b_id): r.score for r in got} == pytest.approx(want | {(92, 93): 1.0})


def test_lsh_shuffles_no_candidates(spark, monkeypatch):
    """A bucket's parts let out a query's best alone; what is found doesn't depend on them."""
    _, _, df = _vectors(spark, 300)
    df = df.where("vec_id < 300 or vec_id > 303")
    asked = df.where("vec_id % 7 = 0")
    once = ann.lsh_knn(asked, df, 3, bits=2)
    assert "SortMergeJoin" not in _plan(once) and "MapInArrow" in _plan(once)
    monkeypatch.setattr(ann, "PART", 11)
    rows = sorted(map(tuple, once.collect()))
    assert len(rows) == 3 * 43 and sorted(map(tuple, ann.lsh_knn(asked, df, 3, bits=2).collect())) == rows


def test_neighbourhood_merges_edges_at_seeds_alone(spark, monkeypatch):
    monkeypatch.setattr(P, "_STORED", {})
    every = P.edges(spark, SF).where("source_id in ('N1', 'N2') or target_id in ('N1', 'N2')")
    want = {("edge", r.source_id, r.relation, r.target_id) for r in every.collect()}
    ids = {x for r in want for x in (r[1], r[3])} | {"N1", "N2"}
    want |= {("node", r.entity_id, r.name, r.type) for r in P.nodes(spark, SF).collect() if r.entity_id in ids}
    monkeypatch.setattr(P, "_STORED", {})

    def none(*_):
        raise AssertionError("all edges were merged")

    monkeypatch.setattr(P, "_merged", none)
    got = [tuple(r) for r in QUERIES["neighbourhood_graph"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


def test_hybrid_queries_merge_edges_at_nations_and_tried_nodes_alone(spark, monkeypatch):
    monkeypatch.setattr(P, "_STORED", {})

    def none(*_):
        raise AssertionError("all edges were merged")

    monkeypatch.setattr(P, "_merged", none)
    assert QUERIES["graph_retrieve"](spark, SF).count() > 0


def test_edges_at_nodes_are_those_of_all_edges(spark):
    every = P.edges(spark, SF).where("source_id in ('C3', 'S2', 'R1', 'P5', 'N4') or target_id in ('C3', 'S2', 'R1', 'P5', 'N4')")
    ids = spark.createDataFrame([(x,) for x in ("C3", "S2", "R1", "P5", "N4")], "entity_id string")
    plain = lambda df: sorted((r.source_id, r.relation, r.target_id, tuple(r.chunk_ids), r.confidence) for r in df.collect())
    assert plain(P.edges_at(spark, SF)(ids)) == plain(every) and every.count() > 50
    assert P.edges_at(spark, SF)(ids.where("false")).collect() == []


@pytest.mark.parametrize("block, stripe", [(2_000_000, 8192), (40, 4), (7, 1)])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_labels_go_to_blocks_and_links_are_not_stored(spark, monkeypatch, block, stripe, kind):
    """Of a hub whose links are in several blocks, repeated links, loops and nulls, labels are as by hand; what is written are stripes' sizes alone."""
    written, cut = [], communities.cut

    def watched(df):
        out = cut(df)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(communities, "BLOCK", block)
    monkeypatch.setattr(communities, "STRIPE", stripe)
    monkeypatch.setattr(communities, "cut", watched)
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 30, (70, 2))] + [(40, i) for i in range(30)] + [(7, 7), (50, 51), (51, 50)]
    make = int if kind == "long" else "n{}".format
    pairs = [(make(a), make(b)) for a, b in pairs]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    label = {n: str(n) for n in near}
    for _ in range(3):
        votes = {n: Counter(label[m] for m in near[n]) for n in near}
        label = {n: min(votes[n], key=lambda x: (-votes[n][x], x)) for n in near}
    links = communities.blocks(spark.createDataFrame([*pairs, *pairs[:20], (None, make(3))], f"x {kind}, y {kind}"))
    found = communities.label_propagation(links, 3, lambda node: node.cast("string"))
    assert {r.node: r.label for r in found.collect()} == label and found.count() == len(label)
    m, inside, degree = sum(map(len, near.values())), Counter(), Counter()
    for n, others in near.items():
        degree[label[n]] += len(others)
        inside[label[n]] += sum(label[k] == label[n] for k in others)
    one = communities.modularity(links, found)
    assert one.collect()[0].modularity == pytest.approx(sum(inside[c] / m - (degree[c] / m) ** 2 for c in degree))
    assert [c for c, _ in written] == [["_s", "n"]]
    sent = [x for x in _plan(one).split("Initial Plan")[0].splitlines() if "Exchange hashpartitioning(block" in x and "REPARTITION_BY_COL" in x]
    assert len([x for x in sent if "ReusedExchange" not in x]) == 1 < len(sent)  # the links are shuffled once


def test_ids_of_numbered_links(spark):
    want = {tuple(r) for r in P.ends(spark, SF, "SUPPLIES", "LOCATED_IN", "IN_REGION").distinct().collect()}
    got = P._numbered_links(spark, SF).select(P._id(F.col("source_id")), P._id(F.col("target_id"))).distinct().collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("piece, pairs, place, stripe", [(512, 4_000_000, 8_000_000, 512), (4, 7, 20, 4), (3, 50, 5, 1), (512, 9, 30, 8)])
@pytest.mark.parametrize("make", [lambda i: 3 * i, lambda i: i + (1 << 61), lambda i: i - 5, "s{}".format], ids=["whole", "large", "negative", "string"])
def test_neighbour_jaccard_shuffles_no_pairs(spark, monkeypatch, piece, pairs, place, stripe, make):
    """Of hubs, crowded stripes, repeated edges and ids of all kinds; a null target counts for its source."""
    for name, value in (("PIECE", piece), ("PAIRS", pairs), ("PLACE", place), ("STRIPE", stripe)):
        monkeypatch.setattr(G, name, value)
    of = {i: {"hub"} | {f"t{i % 3}", f"u{i % 5}"} for i in range(19)} | {19: {"other", None}, 20: {"u1", None, "t2"}, 21: {None}}
    ids = {i: make(i) for i in of}
    rows = [(ids[s], "R", t) for s, ts in of.items() for t in ts] * 2 + [(None, "R", "hub"), (ids[19], "Q", "hub")]
    edges = spark.createDataFrame(rows, f"source_id {'string' if make(0) == 's0' else 'long'}, relation string, target_id string")
    want = {}
    for a, b in combinations(of, 2):
        if both := (of[a] & of[b]) - {None}:
            want[tuple(sorted((ids[a], ids[b])))] = len(both) / (len(of[a]) + len(of[b]) - len(both))
    found = G.neighbour_jaccard(edges, "R")
    got = found.collect()
    assert len(got) == len(want) and {(r.left_id, r.right_id): r.similarity for r in got} == want
    if make(0) == 0:  # others get their ids back by joins
        assert "hashpartitioning(a#" not in _plan(found) and "Join" not in _plan(found).split("Union")[0]


def test_neighbour_jaccard_without_edges(spark):
    for kind in ("long", "string"):
        assert G.neighbour_jaccard(spark.createDataFrame([], f"source_id {kind}, relation string, target_id string"), "R").collect() == []
