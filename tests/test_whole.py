"""Queries read their whole tables; the expected rows are worked out in plain Python."""

from collections import defaultdict

import __spark_entry__

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def run(spark, name):
    return __spark_entry__.queries()[name](spark, SF).collect()


def test_graph_has_the_assertions_of_all_lines(spark):
    lines, buyer = rows(spark, "lineitem"), {o.o_orderkey: o.o_custkey for o in rows(spark, "orders")}
    best, chunks = {}, defaultdict(set)
    for r in lines:
        for e in ((f"S{r.l_suppkey}", "SUPPLIES", f"P{r.l_partkey}"), (f"C{buyer[r.l_orderkey]}", "BOUGHT", f"P{r.l_partkey}")):
            best[e] = max(best.get(e, 0), 1 - r.l_discount)
            chunks[e].add(r.l_orderkey)
    got = {(r.source_id, r.relation, r.target_id): (r.confidence, r.n_chunks) for r in run(spark, "merge_edges") if r.relation in ("SUPPLIES", "BOUGHT")}
    assert got == {e: (round(c, 6), len(chunks[e])) for e, c in best.items()}


def test_components_of_all_events(spark):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for e in rows(spark, "events"):
        a, b = sorted((find(e.user_id), find(e.event_id % 97 + 100000)))
        up[b] = a
    assert {r.node: r.component for r in run(spark, "components")} == {x: find(x) for x in up}


def test_answering_reads_all_orders(spark):
    lines, orders = rows(spark, "lineitem"), rows(spark, "orders")
    kinds = {(r.l_orderkey, r.l_partkey % 3) for r in lines}
    got = run(spark, "context_numbering")
    assert len(got) == len(kinds) + len(orders)
    assert {r.question_id for r in run(spark, "citation_verdict")} == {o.o_orderkey for o in orders}


def test_json_object_reads_all_events(spark):
    want = {e.event_id: '{"a": {"b": "}"}, "n": %d}' % (e.event_id % 9) for e in rows(spark, "events")}
    assert {r.event_id: r.payload for r in run(spark, "json_object")} == want


def test_moving_estimate_folds_all_calls(spark):
    now = {}
    for e in sorted(rows(spark, "events"), key=lambda e: e.event_id):
        now[e.user_id] = max(200.0, 0.7 * now.get(e.user_id, 1000.0) + 0.3 * e.value)
    got = {r.user_id: r.estimate for r in run(spark, "moving_estimate")}
    assert got.keys() == now.keys() and all(abs(got[u] - now[u]) < 1e-5 for u in now)


def test_graph_list_and_gold_have_all_items(spark):
    from skerry.plans import retrieval

    label = {r.vec_id: r.label for r in rows(spark, "embeddings")}
    got = {(r.question_id, r.item) for r in retrieval.ranked_lists(spark, SF).where("list = 'graph'").collect()}
    assert got == {(q, i) for q in label if q % 20 == 0 for i in sorted(j for j in label if j != q and label[j] == label[q])[:10]}
    found = defaultdict(set)
    for r in retrieval.vector.knn(spark, SF).collect():
        found[r.query_id].add(r.vec_id)
    for r in run(spark, "document_recall"):
        gold = {j for j in label if j != r.query_id and label[j] == label[r.query_id]}
        assert abs(r.recall - len(gold & found[r.query_id]) / len(gold)) < 1e-5


def test_between_facts_have_their_own_base(spark):
    from skerry.operators import retrieve

    facts = spark.createDataFrame([(1, "one", 1, 0.9, 2, False), (1, "between", 2, 0.4, 2, True), (1, "two", 2, 0.4, 2, None)], "question_id int, statement string, hops int, confidence double, covered int, between boolean")
    assert {r.statement: round(r.score, 6) for r in retrieve.rank_facts(facts).collect()} == {"one": 20.8, "between": 20.75, "two": 20.5}
    assert {r.statement: round(r.score, 6) for r in retrieve.rank_facts(facts.drop("between")).collect()} == {"one": 20.8, "between": 20.5, "two": 20.5}


def test_streams_give_open_windows_too(spark):
    """Each event is in a tumbling window, in two sliding ones and in a session, the last ones as well."""
    n = len(rows(spark, "events"))
    assert [sum(r[c] for r in run(spark, q)) for q, c in (("stream_tumbling", "requests"), ("stream_sliding", "requests"), ("stream_session", "n"))] == [n, 2 * n, n]


def test_three_hop_gives_each_path(spark):
    found = [(r.node_1, r.relation_1, r.node_2, r.relation_2, r.node_3, r.relation_3) for r in run(spark, "three_hop")]
    assert len(found) == len(set(found)) > 0


def test_threshold_sweep_counts_all_pairs(spark, monkeypatch):
    import numpy as np
    from skerry.operators import ann

    own = rows(spark, "embeddings")
    x, label = np.array([r.embedding for r in own], float), np.array([r.label for r in own])
    norm = np.linalg.norm(x, axis=1)
    score, same, pair = x @ x.T / np.outer(norm, norm), label[:, None] == label[None, :], ~np.eye(len(own), dtype=bool)
    want = {}
    for t in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7):
        want[t] = tuple(int(np.sum(v & pair)) for v in ((score >= t) & same, (score >= t) & ~same, (score < t) & same))
    assert sum(want[0.1]) > len(own) ** 2 / 20
    for block in (ann.BLOCK, 9):
        monkeypatch.setattr(ann, "BLOCK", block)
        assert {r.threshold: (r.correct, r.wrong, r.missed) for r in run(spark, "threshold_sweep")} == want


def test_threshold_counts_of_odd_vectors(spark):
    """Zero, null, missing and infinite components as the SQL has them; pairs at a threshold count as over it."""
    from skerry.operators import ann

    odd = [(0, [3.0, 4.0], 0), (1, [5.0, 0.0], 0), (2, [0.0, 0.0], 0), (3, None, 0), (4, [None, 1.0], 1), (5, [2.0], 0), (6, [1.0, 0.0], None), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>, label int")
    got = {r.threshold: (r.correct, r.wrong, r.missed) for r in ann.threshold_counts(df, "label", [0.6, 0.7]).collect()}
    # of a label: 0-1 and 0-5 are 0.6, 1-5 is 1, those with 2 are not a number; 4 is 0.8 from 0, 0 from 1, not a number from 2, nothing from 5
    assert got == {0.6: (12, 4, 0), 0.7: (8, 4, 4)}
    assert ann.threshold_counts(df.where("vec_id = 0"), "label", [0.6]).collect() == []
