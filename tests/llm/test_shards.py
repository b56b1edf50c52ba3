"""Versions, writers and names of the shard store."""

import pytest

from skerry.llm import shards


def test_old_versions_stay_readable_until_vacuum(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store", target=10_000, base=100, fanout=2)
    for i in range(4):
        store.append(spark.range(100 * i, 100 * i + 100), str(i))
    old = store.read()
    store.compact()
    assert len(store.manifest()) < 4 and store.version() > 4
    assert old.count() == 400 and store.read(version=2).count() == 200 and store.read().count() == 400
    gone = store.vacuum(keep=1)
    assert gone == 4 or gone > 0
    assert store.read().count() == 400
    with pytest.raises(Exception):
        store.read(version=2).count()


def test_of_two_writers_one_loses_and_cleans_up(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    one, two = (shards.ShardStore(spark, path, target=10_000, base=100, fanout=2) for _ in range(2))
    one.append(spark.range(10), "a")
    one.append(spark.range(10, 20), "b")
    two.version = lambda: 2  # has read the version before the other's commit
    one.append(spark.range(20, 30), "c")
    for change in (two.compact, lambda: two.append(spark.range(99), "d")):
        before = sorted(p.name for p in (tmp_path / "store/runs").iterdir())
        with pytest.raises(RuntimeError):
            change()
        assert sorted(p.name for p in (tmp_path / "store/runs").iterdir()) == before
    assert one.version() == 3 and sorted(r.id for r in one.read().collect()) == list(range(30))


def test_clashing_columns_are_kept(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", "r", "s", "v", "a"), (2, None, "r", "s", "v", "a")], "doc_id long, text string, run string, shard string, version string, _arrival string")
    got = shards.shard(rows, f"file://{tmp_path}/store", arrivals=2).collect()
    assert sorted((r.doc_id, r.n_bytes) for r in got) == [(1, 1), (2, 0)] and {type(r.version) for r in got} == {int}
    stored = shards.ShardStore(spark, f"file://{tmp_path}/store").read()
    assert set(rows.columns) < set(stored.columns) and stored.select("run", "_arrival").distinct().collect() == [("r", "a")]
    assert stored.select("store_run").distinct().first()[0] != "r"


def test_tiers_against_a_plain_plan(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store", base=10, fanout=3)
    runs = [{"name": str(i), "folder": str(i), "bytes": b, "shards": 1, "arrivals": []} for i, b in enumerate((5, 9, 31, 10, 8, 95, 40, 33, 7))]
    tier = {i: next(t for t in range(9) if r["bytes"] <= 10 * 3**t or t == 8) for i, r in enumerate(runs)}
    for i, r in enumerate(runs):
        assert store.tier(r) in (tier[i], tier[i] + (r["bytes"] == 10 * 3 ** tier[i] and tier[i] > 0))
    assert [[r["name"] for r in g] for g in store.plan(runs)] == [["0", "1", "3"], ["2", "6", "7"]]


def test_columns_that_come_go_and_widen(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store", target=10_000, base=100_000, fanout=2)
    store.append(spark.createDataFrame([(1, "a")], "doc_id int, text string"), "1")
    store.append(spark.createDataFrame([(2, "b", "en")], "doc_id long, text string, lang string"), "2")
    store.append(spark.createDataFrame([("de", 3)], "lang string, doc_id int"), "3")
    store.append(spark.createDataFrame([(1 << 40, 0.5, 7)], "doc_id long, score float, `store run` int"), "4")
    want = [(1, "a", None, None, None), (2, "b", "en", None, None), (3, None, "de", None, None), (1 << 40, None, None, 0.5, 7)]

    def rows():
        return sorted((tuple(r) for r in store.read(["doc_id", "text", "lang", "score", "store run"]).drop("version", "run", "shard").collect()), key=lambda r: r[0])

    assert rows() == want
    store.compact()
    assert len(store.manifest()) == 1 and rows() == want
    before = store.version(), sorted(p.name for p in (tmp_path / "store/runs").iterdir())
    with pytest.raises(TypeError):
        store.append(spark.createDataFrame([("x",)], "doc_id string"), "5")
    assert before == (store.version(), sorted(p.name for p in (tmp_path / "store/runs").iterdir()))
