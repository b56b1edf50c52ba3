import random

import pytest
from pyspark.sql import functions as F

from skerry.operators import answer, ann, evaluate, extract, gateway, graph, retrieve, store
from skerry.operators.components import connected_components
from skerry.sources import texts
from skerry.streaming import gateway as streams


def test_components_against_union_find(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(500, i) for i in range(501, 560)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_validator(spark):
    payload = """{"entities": [{"name": "Sam Altman", "type": "person", "confidence": "high"}, {"name": "OpenAI", "type": "COMPANY", "confidence": 0.9},
      {"name": "GPT", "type": "model"}, {"name": "  ", "type": "Person"}, {"name": "Mars", "type": "planet"}],
      "relations": [{"source": "sam altman", "type": "ceo of", "target": "OpenAI", "confidence": "low"}, {"source": "OpenAI", "type": "CEO_OF", "target": "Sam Altman"},
      {"source": "OpenAI", "type": "released", "target": "OpenAI"}, {"source": "OpenAI", "type": "RELEASED", "target": "Nobody"}, {"source": "OpenAI", "type": "LIKES", "target": "GPT"}]}"""
    df = spark.createDataFrame([("k", payload), ("bad", "not json"), ("none", None)], "chunk_id string, payload string")
    e = extract.entities(df).collect()
    assert sorted((r.name, r.reason) for r in e if r.reason) == [("", "empty_name"), ("Mars", "unknown_type")] and len(e) == 5
    r = {(x.source, x.relation, x.target): (x.reason, x.confidence) for x in extract.relations(df).collect()}
    assert r == {("sam altman", "CEO_OF", "OpenAI"): (None, 0.3), ("OpenAI", "CEO_OF", "Sam Altman"): ("signature", 1.0), ("OpenAI", "RELEASED", "OpenAI"): ("self_loop", 1.0), ("OpenAI", "RELEASED", "Nobody"): ("unknown_endpoint", 1.0), ("OpenAI", "LIKES", "GPT"): ("unknown_relation", 1.0)}


def test_resolution(spark):
    rows = [("Company", n) for n in ("Acme", "Acme Inc", "Acme Inc", "ACME, Corp.", "Inc")] + [("Product", "Acme"), ("Company", "Akme"), ("Company", None)]
    got = {(r.entity_type, r.raw_name): (r.name, r.mentions, r.aliases) for r in extract.resolve(spark.createDataFrame(rows, "entity_type string, raw_name string"), spark.createDataFrame([("Company", "Akme", "Acme")], "entity_type string, left_name string, right_name string")).collect()}
    assert got["Company", "ACME, Corp."] == got["Company", "Akme"] == ("Acme Inc", 5, ["ACME, Corp.", "Acme", "Akme"])
    assert got["Product", "Acme"] == ("Acme", 1, []) and got["Company", "Inc"] == ("Inc", 1, [])


def test_merge_edges_is_idempotent(spark):
    rows = [("a", "R", "b", "c2", 0.5, 2), ("a", "R", "b", "c1", None, 1), ("a", "R", "b", "c2", 0.9, 3), ("b", "R", "a", "c1", None, 1)]
    df = spark.createDataFrame(rows, "source_id string, relation string, target_id string, chunk_id string, confidence double, ordinal int")
    once, twice = (sorted(map(tuple, graph.merge_edges(x).collect())) for x in (df, df.unionByName(df)))
    assert once == twice == [("a", "R", "b", ["c1", "c2"], 0.9), ("b", "R", "a", ["c1"], 0.0)]


def test_paths_do_not_reuse_edges(spark):
    e = spark.createDataFrame([("a", "R", "b", ["1"], 1.0), ("b", "S", "a", ["2"], 1.0), ("b", "R", "c", ["3"], 1.0), ("c", "R", "c", ["4"], 1.0)], "source_id string, relation string, target_id string, chunk_ids array<string>, confidence double")
    seeds = spark.createDataFrame([("a",)], "entity_id string")
    got = sorted((r.relation_1, r.forward_1, r.node_2, tuple(r.chunk_ids)) for r in graph.two_hop(e, seeds).collect())
    assert got == [("R", True, "c", ("1", "3")), ("S", False, "c", ("2", "3"))]
    with pytest.raises(ValueError):
        graph.relation_of_type(e, "X' OR 1=1", ("R", "S"))


def test_linker(spark):
    forms = spark.createDataFrame([("1", "New York"), ("2", "New York Times"), ("3", "York"), ("4", "Times"), ("5", "open ai"), ("2", "the times")], "entity_id string, form string")
    qs = spark.createDataFrame([(1, "Did the New-York Times meet Open AI in York?"), (2, None), (3, "nothing")], "question_id int, question string")
    got = [(r.question_id, r.position, r.entity_id) for r in retrieve.link_entities(qs, forms).orderBy("question_id", "position").collect()]
    assert got == [(1, 0, "2"), (1, 1, "5")]


def test_citation_cases(spark):
    facts = spark.createDataFrame([(1, 1, ["a"], "Fact  one"), (1, 2, ["b"], "fact one")], "question_id int, position int, chunk_ids array<string>, text string")
    passages = spark.createDataFrame([(1, 1, ["p"], "Passage")], "question_id int, position int, chunk_ids array<string>, text string")
    ctx = answer.number_context(facts, passages)
    assert [(r.marker, r.kind, r.text) for r in ctx.orderBy("marker").collect()] == [(1, "fact", "Fact one"), (2, "passage", "Passage")]
    assert answer.render(ctx).first().block == "[1] (fact) Fact one\n[2] (passage) Passage"
    answers = spark.createDataFrame([(1, "It is so [2]."), (1, "No [9]."), (1, " "), (1, None), (2, "Cites [1].")], "question_id int, answer string")
    got = sorted((r.verdict, tuple(r.cited), tuple(r.invalid), tuple(r.chunk_ids)) for r in answer.validate(answers, ctx).collect())
    assert got == [("invalid_marker", (), (1,), ()), ("invalid_marker", (), (9,), ()), ("ok", (2,), (), ("p",)), ("refused", (), (), ()), ("refused", (), (), ())]


def test_agreement_statistics(spark):
    pairs = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (1, 3), (None, 2)], "a int, b int")
    assert evaluate.weighted_kappa(pairs, "a", "b").first().kappa == pytest.approx(1 - (4 * 4) / (1 * (0 + 1 + 4 * 2) * 2 + 1 * (1 + 0 + 1 * 2) + 1 * (4 + 1)))
    ties = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 3.0), (3.0, 3.0)], "x double, y double")
    assert evaluate.spearman(ties, "x", "y").first().rho == pytest.approx(4 / 4.5)  # ranks (1.5, 1.5, 3, 4) and (1, 2, 3.5, 3.5)


def test_breaker_batch_and_stream_agree(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.random() > 0.5, i * 150) for k in range(20) for i in range(rnd.randint(1, 25))]
    df = spark.createDataFrame(rows, "k int, i int, ok boolean, at long")
    got = {r.k: (r.state, r.failures) for r in gateway.breaker(df, ["k"], "i", F.col("ok"), F.col("at")).collect()}
    want = {}
    for k, _, ok, at in rows:
        want[k] = streams.next_state(*want.get(k, ("closed", 0, 0)), ok, at)
    assert got == {k: v[:2] for k, v in want.items()}


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, h string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k int, h string")
    assert {r.k: r.action for r in store.upsert_delta(old, new, "k", "h").collect()} == {1: "skip", 2: "replace", 3: "absent", 4: "insert"}
    assert [r.k for r in store.insert_if_absent(old, new.unionByName(new), ["k"]).collect()] == [4]


def test_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b_file.txt").write_bytes(b"  hi \xff there\n")
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "sub" / "c.txt").write_text("no")
    (tmp_path / "q.json").write_text('{"questions": [{"id": "1", "gold": ["a"]}]}')
    got = texts.read_documents(spark, f"file://{tmp_path}").collect()
    assert [(r.filename, r.title, r.content) for r in got] == [("a.txt", "A", "x"), ("b_file.txt", "B File", "hi � there")]
    assert texts.read_questions(spark, f"file://{tmp_path}/q.json").first().id == "1"


def test_knn_ties(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)] + [(99, None), (98, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = [r.vec_id for r in ann.knn(v.where("vec_id = 20"), v, 5).orderBy("rank").collect()]
    assert got == [0, 1, 2, 3, 4]
