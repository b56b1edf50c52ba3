"""Quantiles, intervals, indexes, communities, centrality, overlap and versions against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.operators import ann, communities, evaluate, extract, graph, intervals, ivf, models, overlap, quantiles, versions


def rank(values, share):
    values = sorted(values)
    return values[min(len(values) - 1, math.floor(share * len(values)))]


@pytest.mark.parametrize("most", [1 << 18, 50])
def test_exact_quantiles(spark, most):
    rnd = random.Random(2)
    rows = [(g, rnd.choice([0.0, 1.0, rnd.gauss(0, 9)]) if g == "a" else rnd.random() ** 9) for g in "aab" for _ in range(3000)] + [("c", 5.0)] * 400 + [("d", None), ("e", 1.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.share): (r.n, r.value) for r in quantiles.exact(df, ["g"], "v", [0.0, 0.5, 0.95, 0.99, 1.0], most=most).collect()}
    by = defaultdict(list)
    for g, v in rows:
        if v is not None:
            by[g].append(v)
    assert got == {(g, s): (len(v), rank(v, s)) for g, v in by.items() for s in (0.0, 0.5, 0.95, 0.99, 1.0)}
    assert quantiles.exact(df.where("false"), ["g"], "v", [0.5]).collect() == []


def test_merged_sketches_keep_their_rank_error(spark):
    rnd = random.Random(3)
    rows = [(f"p{i % 2}", 60 * rnd.randrange(600), rnd.expovariate(0.03)) for i in range(8000)]
    df = spark.createDataFrame(rows, "provider string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = quantiles.windowed_sketches(df, "ts", ["provider"], "v", "30 minutes", 2, {"slow": F.col("v") > 50})
    seen = got.select("provider", F.unix_seconds("window_start").alias("w"), "n", "slow", *[quantiles.at_rank("sketch", p).alias(str(p)) for p in (0.5, 0.95)]).collect()
    assert len(seen) == 2 * 21
    for r in seen:
        own = [v for p, s, v in rows if p == r.provider and r.w <= s < r.w + 3600]
        assert r.n == len(own) and r.slow == sum(v > 50 for v in own)
        for share in (0.5, 0.95):
            assert abs(sum(v <= r[str(share)] for v in own) / len(own) - share) <= 2 * quantiles.RANK_ERROR + 1 / len(own)


@pytest.mark.parametrize("bucket", [None, 7])
def test_depth_of_intervals(spark, bucket):
    rnd = random.Random(5)
    rows = [(rnd.choice("xy"), s := rnd.randrange(-50, 300), rnd.choice([None, s, s + rnd.randrange(90)])) for _ in range(400)] + [("x", None, 4), ("x", 9, 3)]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    got = {(r.k, r["at"]): r.depth for r in intervals.depth(df, "s", "e", ["k"], bucket).collect()}
    want = {}
    for k in "xy":
        own = [(s, e) for x, s, e in rows if x == k and s is not None and (e is None or e >= s)]
        for t in {s for s, _ in own} | {e for _, e in own if e is not None}:
            want[k, t] = sum(s <= t and (e is None or e > t) for s, e in own)
    assert got == want
    assert intervals.depth(df.where("false"), "s", "e").collect() == []


def test_index_recall_on_100000_vectors(spark, tmp_path):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(400, 32))
    x = (middle[rng.integers(0, 400, 100_000)] + rng.normal(size=(100_000, 32)) * 0.35).astype(np.float32)
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    ivf.write_index(df, str(tmp_path / "index"), 256)
    ids = np.arange(0, 100_000, 1000)
    got = defaultdict(set)
    for r in ivf.search(spark, str(tmp_path / "index"), df.where("vec_id % 1000 = 0"), 5, probes=8).collect():
        got[r.query_id].add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in ids:
        s = unit @ unit[q]
        s[q] = -2
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hit >= 0.9 * 5 * len(ids)
    index = spark.read.parquet(str(tmp_path / "index/lists"))
    sizes = {r.cell: r["count"] for r in index.groupBy("cell").count().collect()}
    c = np.array([r.centroid for r in spark.read.parquet(str(tmp_path / "index/centroids")).orderBy("cell").collect()])
    probed = np.argsort(-(unit[ids] @ c.T), axis=1)[:, :8]
    assert sum(sizes.values()) == 100_000 and np.mean([sum(sizes.get(int(k), 0) for k in p) for p in probed]) < 10_000


def test_earlier_within_threshold(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    rows = [(i, (base[rng.integers(40)] + rng.normal(size=8) * rng.choice([0, 0.05, 0.3])).tolist()) for i in range(300)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {}
    for i, v in rows[:300]:
        best = max(((round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6), j) for j, w in rows[:i]), default=(-1, 0))
        if best[0] >= 0.95:
            want[i] = best
    for part in (4096, 7):
        assert {r.vec_id: (r.score, r.answer_id) for r in ivf.earlier_within(df, 0.95, cells=9, part=part).collect()} == want
    assert ivf.earlier_within(df.where("false"), 0.9).collect() == []


def links(spark):
    nation = spark.read.parquet("/root/testdata/sf0.001/nation.parquet").collect()
    return [(f"N{r.n_nationkey}", f"R{r.n_regionkey}") for r in nation] + [("N1", "N2"), ("N2", "N3"), ("N3", "N1"), ("R0", "R1"), ("N7", "N7"), ("N2", "N1")]


def both_ways(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def test_betweenness_on_the_nation_graph(spark):
    pairs = links(spark)
    near = both_ways(pairs)
    want = dict.fromkeys(near, 0.0)
    for s in near:  # Brandes' accumulation, by hand
        dist, paths, order, front = {s: 0}, Counter({s: 1}), [], [s]
        while front:
            order += front
            new = []
            for v in front:
                for w in near[v]:
                    if w not in dist:
                        dist[w] = dist[v] + 1
                        new.append(w)
                    if dist[w] == dist[v] + 1:
                        paths[w] += paths[v]
            front = new
        share = Counter()
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                want[w] += share[w]
    df = spark.createDataFrame(pairs, "x string, y string")
    got = communities.betweenness(df, spark.createDataFrame([(n,) for n in near], "node string"))
    assert {r.node: round(r.betweenness, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert {r.betweenness for r in communities.betweenness(df, spark.createDataFrame([("nobody",)], "node string")).collect()} == {0.0}


def test_label_propagation(spark):
    pairs = links(spark)
    near = both_ways(pairs)
    label = {n: n for n in near}
    for _ in range(3):
        votes = {n: Counter(label[m] for m in near[n]) for n in near}
        label = {n: min(votes[n], key=lambda x: (-votes[n][x], x)) for n in near}
    df = spark.createDataFrame(pairs, "x string, y string")
    found = communities.label_propagation(df, 3)
    assert {r.node: r.label for r in found.collect()} == label
    m = sum(map(len, near.values()))
    inside = Counter(label[n] for n in near for k in near[n] if label[n] == label[k])
    degree = Counter()
    for n in near:
        degree[label[n]] += len(near[n])
    assert communities.modularity(df, found).first().modularity == pytest.approx(sum(inside[c] / m - (degree[c] / m) ** 2 for c in degree))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_overlap_measures(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choices(["a", "b", "c", "Do", "é"], k=rnd.randint(0, 14))), ", ".join(rnd.choices(["a", "b", "c", "do", "É"], k=rnd.randint(0, 14)))) for i in range(60)] + [(98, None, "a"), (99, "a b", None)]
    df = spark.createDataFrame(rows, "k long, x string, y string")
    split = {k: ([w.lower() for w in (x or "").split()], [w.lower() for w in (y or "").replace(",", "").split()]) for k, x, y in rows}
    assert {r.k: r.common for r in overlap.rouge_l(df, ["k"], "x", "y").collect()} == {k: lcs(a, b) for k, (a, b) in split.items()}
    counts = {(r.k, r.n): (r.matched, r.candidate_grams, r.reference_grams) for r in overlap.clipped(df, ["k"], "x", "y").collect()}
    for k, (a, b) in split.items():
        score = 0.0
        for n in range(1, 5):
            c, r = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (a, b))
            want = (sum((c & r).values()), sum(c.values()), sum(r.values()))
            assert counts.get((k, n), (0, 0, 0)) == want
            score += math.log(want[0] / want[1]) if want[0] else -math.inf
        bleu = {r.k: r.bleu for r in overlap.bleu(overlap.clipped(df.where(F.col("k") == k), ["k"], "x", "y"), ["k"]).collect()} if k < 6 else None
        if bleu is not None and (a or b):
            assert bleu[k] == pytest.approx(0.0 if score == -math.inf else min(1.0, math.exp(1 - len(b) / len(a))) * math.exp(score / 4))


def test_versions_are_whole_and_refuse_a_lost_race(spark, tmp_path):
    t = versions.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.read() is None and t.version() == 0
    assert t.merge(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, o long"), ["k"], "o") == 1
    old = t.read()
    assert t.merge(spark.createDataFrame([(2, "late", 0), (3, "c", 1), (1, "new", 2)], "k long, v string, o long"), ["k"], "o") == 2
    assert sorted(map(tuple, t.read().collect())) == [(1, "new", 2), (2, "b", 1), (3, "c", 1)] and sorted(r.v for r in old.collect()) == ["a", "b"]
    with pytest.raises(RuntimeError):
        t.write(old, 1)  # version 2 is taken
    assert t.version() == 2 and len(list((tmp_path / "t").glob("data-*"))) == 2
    t.merge(spark.createDataFrame([(3, 0.5)], "k long, w double"), ["k"])
    assert sorted((r.k, r.v, r.w) for r in t.read().collect()) == [(1, "new", None), (2, "b", None), (3, None, 0.5)]


def test_payloads_add_up(spark, tmp_path):
    def payload(chunk, company, confidence):
        text = f'{{"entities": [{{"name": "{company}", "type": "company", "confidence": {confidence}}}, {{"name": "Oslo", "type": "location", "confidence": 1}}], "relations": [{{"source": "{company}", "type": "located_in", "target": "Oslo", "confidence": {confidence}}}]}}'
        return extract.graph_payload(spark.createDataFrame([(chunk, text)], "chunk_id string, payload string"))

    path, chunks = f"file://{tmp_path}/g", spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    extract.write_payload(payload("c1", "Acme", 0.9), path, chunks)
    again = extract.write_payload(payload("c1", "Acme", 0.4), path, chunks)
    assert again == {"entities": 2, "mentions": 2, "relations": 1, "links": 2, "skipped": 0}
    more = extract.write_payload(payload("c2", "Acme", 0.5), path, chunks)
    assert more == {"entities": 2, "mentions": 4, "relations": 2, "links": 4, "skipped": 0}
    lost = extract.write_payload(payload("c9", "Bolt", 0.5), path, chunks)  # a chunk that is not there
    assert lost["entities"] == 3 and lost["mentions"] == 4 and lost["relations"] == 3
    rel = {tuple(r.chunk_ids): r.confidence for r in versions.VersionedTable(spark, f"{path}/relations").read().collect()}
    assert rel == {("c1", "c2"): 0.9, ("c9",): 0.5}
    mine = {(r.chunk_id, r.confidence) for r in versions.VersionedTable(spark, f"{path}/mentions").read().collect()}
    assert mine == {("c1", 0.4), ("c1", 1.0), ("c2", 0.5), ("c2", 1.0)}  # the last one written


def test_benchmark_runner_keeps_to_its_bounds(spark):
    q = spark.createDataFrame([(i, i % 3) for i in range(9)], "question_id long, category long")
    gold = spark.createDataFrame([(i, j) for i in range(1, 9) for j in range(i)], "question_id long, item long")
    one = spark.createDataFrame([(i, j, j + 1) for i in range(9) for j in range(8)], "question_id long, item long, rank int")
    got = evaluate.run_benchmark(q, gold, {"x": one, "y": one.where("false")}, k=2, categories=[0, 2], first=4)
    rows = {(r.question_id, r["mode"]): (r.found, r.wanted, r.recall, r.hit) for r in got.collect()}
    assert sorted({i for i, _ in rows}) == [0, 2, 3, 5]
    assert rows[0, "y"] == (0, 0, 1.0, True) and rows[5, "x"] == (2, 5, 0.4, True) and rows[5, "y"] == (0, 5, 0.0, False)
    for bad in ({"k": 0}, {"first": 0}, {"categories": []}):
        with pytest.raises(ValueError):
            evaluate.run_benchmark(q, gold, {"x": one}, **bad)
    with pytest.raises(ValueError):
        graph.chunks_of(one, one, 0)


def test_hashed_search_has_its_recall(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(60, 24))
    x = middle[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 24)) * 0.25
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in ann.lsh_knn(df.where("vec_id % 50 = 0"), df, 5).collect():
        found[r.query_id].add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = -2
        hit += len(found[q] & set(np.argsort(-s)[:5].tolist()))
    assert hit >= 0.9 * 5 * 60


def test_blocks_of_queries_make_no_difference(spark, monkeypatch):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    once = sorted(map(tuple, ann.knn(v.where("vec_id % 20 = 0"), v, 3).select("query_id", "rank", "vec_id", "score").collect()))
    monkeypatch.setattr(ann, "BLOCK", 7)
    assert sorted(map(tuple, ann.knn(v.where("vec_id % 20 = 0"), v, 3).select("query_id", "rank", "vec_id", "score").collect())) == once
    assert ann.scores(v.where("vec_id % 20 = 0"), v).count() == 25 * 499


def test_near_names_leave_as_a_forest(spark):
    """A bucket of 300 names within the threshold of each other is 299 links or little more a bucket, not 44,850."""
    rng = np.random.default_rng(4)
    one = rng.normal(size=16)
    rows = [("Company", f"n{i:03}", (one + rng.normal(size=16) * 0.02).tolist()) for i in range(300)]
    got = extract.similar_names(spark.createDataFrame(rows, "entity_type string, raw_name string, embedding array<double>")).collect()
    up = {name: name for _, name, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in got:
        up[find(r.left_name)] = find(r.right_name)
    assert len({find(n) for n in up}) == 1 and len(got) < 300 * 20


def test_extraction_goes_on_where_it_stopped(spark, tmp_path):
    items = spark.createDataFrame([(f"k{i}", "Acme meets Beta" + " bad" * (i % 4 == 1)) for i in range(10)], "chunk_id string, text string")
    done, failed = f"file://{tmp_path}/done", f"file://{tmp_path}/failed"
    model = models.RuleExtractor(("bad",))
    assert models.backfill(spark, items, model, "chunk_id", "text", done, failed, 4, 1, models.completed) == 1
    assert spark.read.parquet(done).count() + spark.read.parquet(failed).count() == 4
    assert models.backfill(spark, items, model, "chunk_id", "text", done, failed, 4, None, models.completed) == 2
    assert models.backfill(spark, items, model, "chunk_id", "text", done, failed, 4, None, models.completed) == 0
    got, lost = spark.read.parquet(done), spark.read.parquet(failed)
    assert sorted(r.chunk_id for r in lost.collect()) == ["k1", "k5", "k9"] and {r.error for r in lost.collect()} == {"gave up"}
    assert got.count() == got.select("chunk_id").distinct().count() == 7
    assert {(r.source, r.relation, r.target, r.reason) for r in extract.relations(got.select("chunk_id", F.col("answer").alias("payload"))).collect()} == {("Acme", "PARTNERED_WITH", "Beta", None)}


def test_spearman_with_ties(spark):
    rnd = random.Random(7)
    rows = [(a := rnd.choice([rnd.gauss(0, 1), 0.0, 1.5]), a + rnd.choice([0, rnd.gauss(0, 2)])) for _ in range(2000)] + [(None, 1.0)]

    def ranks(v):
        order = sorted(v)
        first = {}
        for i, x in enumerate(order):
            first.setdefault(x, []).append(i + 1)
        return [sum(first[x]) / len(first[x]) for x in v]

    x, y = zip(*rows[:-1])
    want = np.corrcoef(ranks(x), ranks(y))[0, 1]
    assert evaluate.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first().rho == pytest.approx(want, abs=1e-9)


def test_the_closed_library_of_patterns(spark):
    e = spark.createDataFrame([("A", "USES", "B", ["c1"], 0.5), ("B", "USES", "C", ["c2"], 0.9), ("C", "OWNS", "D", ["c3"], 1.0)], "source_id string, relation string, target_id string, chunk_ids array<string>, confidence double")
    n = spark.createDataFrame([(x, f"Name {x}", "Thing", [x.lower() * 2], f"name {x.lower()}") for x in "ABCD"], "entity_id string, name string, type string, aliases array<string>, normalized string")
    seed = n.where("entity_id = 'A'").select("entity_id")
    t = graph.TEMPLATES
    assert [r.target_id for r in t["NEIGHBOURS"](e, seed).collect()] == ["B"]
    assert [(r.node_2, r.chunk_ids) for r in t["TWO_HOP"](e, seed).collect()] == [("C", ["c1", "c2"])]
    assert [(r.node_3, r.forward_3, r.chunk_ids) for r in t["THREE_HOP"](e, seed).collect()] == [("D", True, ["c1", "c2", "c3"])]
    assert [r.middle for r in t["SHARED_NEIGHBOUR"](e, spark.createDataFrame([("A", "C")], "start string, end string")).collect()] == ["B"]
    assert t["RELATION_OF_TYPE"](e, "USES", ("USES", "OWNS")).count() == 2 and t["RELATION_OF_TYPE"](e, "USES", ("USES",), "C").count() == 1
    with pytest.raises(ValueError):
        t["RELATION_OF_TYPE"](e, "HATES", ("USES", "OWNS"))
    assert [(r.relation, r.degree) for r in t["COUNT_BY_RELATION"](e, n, seed).collect()] == [("USES", 1)]
    near, at = t["NEIGHBOURHOOD_GRAPH"](e, n, seed)
    assert sorted(r.entity_id for r in near.collect()) == ["A", "B"] and at.count() == 1
    assert t["ENTITY_LOOKUP"](n, "BB").first().entity_id == "B" and t["ENTITY_SEARCH"](n, "name").count() == 4
