"""Components against all pairs of exact sets, the tree against set arithmetic, keys against the pigeonhole promise."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import prefix_tree
from skerry.llm.prefix_tree import PrefixTree, Threshold
from skerry.session import cut

SCHEMA = "doc_id long, text string, key string, own string, group string"
T = Threshold(90, 100)


def shingle_set(text, words=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 90 * len(a | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(repr((d, len(sets[i]), least.get(find(i)))) for i, (d, *_) in enumerate(rows))


def corpus(seed):
    rnd = random.Random(seed)
    rows = []
    for g in range(40):
        base = rnd.choices([f"w{i}" for i in range(rnd.choice([4, 300]))], k=rnd.choice([2, 3, 5, 12, 13, 30, 60, 120, 250]))
        for _ in range(rnd.randint(1, 6)):
            words = base.copy()
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 4])):
                at = rnd.randrange(len(words) + 1)
                words[at : at + rnd.choice([0, 1])] = rnd.choice([[], ["new"], [f"n{rnd.random()}"]])
            rows.append((len(rows) + 10, rnd.choice([" ", "\n"]).join(words if rnd.random() < 0.7 else [w.upper() for w in words]), "a", "b", "c"))
    chain = [f"c{i}" for i in range(200)]
    for i in range(12):  # each like the next only
        chain[15 * i + 3] = f"d{i}"
        chain[15 * i + 9] = f"e{i}"
        rows.append((1000 + i, " ".join(chain), "a", "b", "c"))
    for i in range(60):  # near copies of a template
        words = [f"t{k}" for k in range(150)]
        words[i * 2 + 5] = f"z{i}"
        rows.append((2000 + i, " ".join(words), "a", "b", "c"))
    rows += [(3000, None, None, None, None), (3001, "", "", "", ""), (3002, " \n", "", "", ""), (3, "a b", "", "", ""), (3003, "A  b", "", "", ""), rows[5], rows[5], (None, rows[5][1], "", "", ""), (3004, "L " * 30_000 + "m", "", "", "")]
    return rows


@pytest.mark.parametrize("bound", [1 << 19, 400])
def test_components_against_brute_force(spark, monkeypatch, bound):
    if bound < 1000:
        monkeypatch.setattr(prefix_tree, "LEADERS", 2)
        monkeypatch.setattr(prefix_tree, "HELD_KEYS", 500)
    rows = corpus(bound % 7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(repr(tuple(r)) for r in prefix_tree.join(df, bound=bound).select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)
    assert prefix_tree.join(df.where("doc_id < 0")).collect() == []


def test_sets_of_different_leaders_are_linked(spark):
    """A chain in one large group, each set like the next only: whatever leaders are drawn, it stays one component."""
    base, rows = [f"c{i}" for i in range(120)], []
    for i in range(40):
        base[3 * i % 120] = f"d{i}"
        rows.append((i, " ".join(base), "", "", ""))
    df = spark.createDataFrame(rows, SCHEMA)
    for bound in (1 << 19, 300):
        assert sorted(repr(tuple(r)) for r in prefix_tree.join(df, bound=bound).select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)


def test_groups_beside_a_large_one_stay_whole(spark):
    """A join takes the large groups out of the others; of these, each still reaches one task."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(8):
        own = rng.integers(1, 1 << 62, 200).astype(np.uint64)
        for i in range(100 if g == 0 else 40):
            if g:
                own = own.copy()
                own[5 * i % 200] = rng.integers(1, 1 << 62)  # each like the few before only
            rows.append((g, 1000 * g + i, np.sort(own if g else np.append(own, np.uint64(i))).tobytes()))
    owned = cut(spark.createDataFrame(rows, "group long, node long, own binary").repartition(6))
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    kept = spark.conf.get(conf)
    spark.conf.set(conf, "false")  # tasks stay apart, as on large tables
    try:  # the join is planned as a shuffle, and broadcast after all
        large = owned.groupBy("group").agg(F.count("*").alias("n")).where("n > 50")
        got = prefix_tree.rooted(owned.join(large, "group", "left_anti"), T).collect()
    finally:
        spark.conf.set(conf, kept)
    assert sorted((r.node, r.component) for r in got) == [(node, 1000 * g) for g, node, _ in rows if g]


def test_only_rows_without_doc_id(spark):
    df = spark.createDataFrame([(None, "a b c", "", "", ""), (None, None, "", "", "")], SCHEMA)
    assert [tuple(r) for r in prefix_tree.join(df).orderBy("n_shingles").collect()] == [(None, 0, None), (None, 1, None)]


def test_threshold_in_whole_numbers():
    assert T.slack(9, 10, 9) == 0 and T.slack(9, 10, 10) < 0 and T.largest(9) == 10 and T.largest(8) == 8
    for size in range(1, 400):
        assert T.apart(size) >= max(x + y - 2 * o for x in (size, size - 1) for y in (size, size - 1) for o in range(max(0, min(x, y) - 40), min(x, y) + 1) if T.slack(o, x, y) >= 0)


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(2)
    for _ in range(1500):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        most = T.apart(T.largest(len(a)))
        gone, new = (int(rng.integers(0, most + 1)) for _ in "ab")
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64)]))
        if len(b) and T.slack(len(np.intersect1d(a, b)), len(a), len(b)) >= 0:
            assert np.intersect1d(prefix_tree.piece_keys(a, T), prefix_tree.piece_keys(b, T)).size


def _rare(own, sets):
    """Whether a set has members that no other has; itself, it is then not looked for."""
    return any(sum(v in s for s in sets) < 2 for v in own)


def test_tree_finds_what_set_arithmetic_finds():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
    sets = []
    for i in range(150):
        keep = base[rng.random(len(base)) > rng.choice([0, 0.02, 0.1, 0.5])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 60, rng.integers(0, 4)).astype(np.uint64)])))
    sets = list({s.tobytes(): s for s in sets if len(s)}.values())
    tree = PrefixTree(sets, T)

    def similar(a, b):
        both = len(np.intersect1d(a, b))
        return 100 * both >= 90 * (len(a) + len(b) - both)

    for own in [*sets, np.unique(rng.integers(0, 1 << 40, 30).astype(np.uint64)), base[:0]]:
        own = np.sort(own)
        assert sorted(tree.near(own)) == [i for i, s in enumerate(sets) if similar(own, s)]
    def joined(pairs):
        up = list(range(len(sets)))
        for _ in sets:
            for i, j in pairs:
                up[i] = up[j] = min(up[i], up[j])
        return up

    assert PrefixTree([base[:3], base[3:9]], T, alone=True).forest([base[:3], base[3:9]]) == []
    alone = PrefixTree(sets, T, alone=True)
    assert all(sorted(alone.near(s)) == [j for j, o in enumerate(sets) if similar(s, o)] for s in sets if len(s) > 0 and not _rare(s, sets))
    assert joined(alone.forest(sets)) == joined([(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])])
    tree.take_out(3)
    assert 3 not in tree.near(sets[3])
