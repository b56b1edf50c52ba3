import hashlib

import pytest

import corpus_pipeline
from skerry.llm import importance, language, quantise, shards, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def odd_rows(spark):
    return spark.createDataFrame([(None, None, None, "x", None), (1, "", "en", None, 0), (2, "!!! 123", "en", "x", 7), (3, "a b", None, "x", 3), (3, "a b", None, "x", 3)], DOCS)


def test_simhash_against_brute_force(spark, docs):
    rows = docs.unionByName(odd_rows(spark))
    for crowd in (256, 1):
        got = simhash.near_duplicates(rows, crowd=crowd).collect()
        fps = [int(r.fingerprint, 16) for r in got]
        parent = list(range(len(got)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    parent[find(i)] = find(j)
        least = {}
        for i, r in enumerate(got):
            if r.doc_id is not None:
                least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
        assert all(r.component_id == least.get(find(i)) for i, r in enumerate(got))
    assert simhash.near_duplicates(rows.where("doc_id < 0")).collect() == []


def test_crowd_links_are_exact(spark):
    prints = [0b11, 0b1100, 0b110000, 1 << 40 | 0b11, (1 << 64) - 1, (1 << 64) - 32]
    rows = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = {frozenset((r.a, r.b)) for r in simhash.crowd_links(spark.createDataFrame(rows, "fp long"), 4).collect()}
    signed = [r[0] for r in rows]
    want = {frozenset((signed[i], signed[j])) for i in range(6) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4}
    assert got <= want

    def classes(edges):
        part = {s: s for s in signed}
        for _ in signed:
            for a, b in map(tuple, edges):
                part[a] = part[b] = min(part[a], part[b])
        return part

    assert classes(got) == classes(want)


def test_similar_finds_near_copies_only(spark):
    base = [f"w{i}" for i in range(400)]
    near = base.copy()
    near[200] = "changed"
    other = [f"v{i}" for i in range(400)]
    df = spark.createDataFrame([(5, " ".join(base)), (3, " ".join(near)), (9, " ".join(other)), (4, " ".join(base)), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    assert got[5] == got[3] == got[4] == 3 and got[9] == 9 and None in got


def _brute(texts, similarity=0.8):
    """Least index of each text's group, by all pairs of exact five-word sets."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if (not a and not sets[j]) or (a and len(a & sets[j]) >= similarity * len(a | sets[j])):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return [find(i) for i in range(len(sets))]


def _pair(rng, similarity, n=404):
    """Two texts of n words whose five-word similarity is just over or just under the given one."""
    base = [f"w{rng.randrange(10**9)}" for _ in range(n)]
    near, m = base.copy(), n - 4
    k = round((1 - similarity) / (1 + similarity) * m)
    cut = 5 * (k // 5)
    for i in range(cut // 5):
        near[8 + 9 * i] = f"x{rng.randrange(10**9)}"
    return " ".join(base), " ".join(near)


def test_similar_recall_and_precision(spark):
    import random

    rng = random.Random(5)
    rows, want = [], {}
    for s in (0.7, 0.78, 0.81, 0.85, 0.9):
        for _ in range(100):
            a, b = _pair(rng, s)
            n = len(rows)
            rows += [(n, a), (n + 1, b)]
            want[n] = (s, _brute([a, b])[1] == 0)
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [n for n, (_, w) in want.items() if w]
    assert len(near) == 300 and not any(got[n + 1] == n for n in want if n not in near)
    for s in (0.81, 0.85, 0.9):
        of = [n for n in near if want[n][0] == s]
        assert sum(got[n + 1] == n for n in of) >= 0.97 * len(of)


def test_similar_links_chains_and_crowds(spark):
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(24):  # each like the next only
        base[10 * i + 5] = f"x{i}"
        base[10 * i + 11] = f"y{i}"
        texts.append(" ".join(base))
    for i in range(40):  # near copies of a template
        words = [f"t{k}" for k in range(200)]
        words[i * 4] = f"z{i}"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{k}" for k in range(100)), "", "a b", "A  b"]
    want = _brute(texts)
    assert len(set(want)) == 5 and want[23] == 0
    order = [(i * 29 % len(texts), i) for i in range(len(texts))]  # ids in no order of the chain
    df = spark.createDataFrame([(d, texts[i]) for d, i in order], "doc_id long, text string")
    for members in (1 << 19, 900):
        got = {r.doc_id: r.component_id for r in simhash.similar(df, members=members).collect()}
        least = {}
        for d, i in order:
            least[want[i]] = min(d, least.get(want[i], d))
        assert got == {d: least[want[i]] for d, i in order}


def test_near_duplicates_keeps_texts_of_null_and_repeated_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(None, one), (None, two), (None, two), (7, three), (7, "quite another text of few words"), (8, three), (None, three), (None, None), (9, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS)
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(None, one), (None, two), (7, three), (7, "quite another text of few words"), (9, "")], key=str)


def test_passages_stage_removes_all_of_over_fifty_words(spark):
    texts = []
    passages = [" ".join(f"{c}{i:03}" for i in range(51)) for c in ("pas", "k")] + [" ".join("abcdefghij"[i * i % 7 + i % 3] for i in range(51))]
    short = " ".join(f"short{i}" for i in range(40))  # over 200 bytes, but not over 50 words
    for n, p in enumerate([*passages, short] * 2):
        texts.append(f"{' '.join(f'u{n}a{i}' for i in range(30))} {p} {' '.join(f'u{n}b{i}' for i in range(30))}")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["passages"](spark, docs, SF).collect()}
    for n, t in enumerate(texts):
        assert f"u{n}a28 " in got[n] and f" u{n}b1 " in got[n]
        if n % 4 == 3:
            assert got[n] == t
        else:
            assert passages[n % 4] not in got[n] and len(got[n]) <= len(t) - len(passages[n % 4])


def test_importance_parts_labelled_rows(spark, docs, labels):
    got = importance.resample(docs, labels).join(labels, "doc_id").select("selected", "quality").collect()
    right = sum(r.selected == (r.quality == 1) for r in got)
    assert right >= 0.9 * len(got)
    assert importance.resample(docs, labels, k=17).where("selected").count() == 17
    assert importance.resample(odd_rows(spark), labels.where("false")).where("selected").count() == 5
    assert importance.resample(odd_rows(spark).where("doc_id < 0"), labels).collect() == []


def test_language_held_out(spark, docs):
    rows = docs.unionByName(odd_rows(spark))
    got = language.predict(rows).collect()
    assert len(got) == docs.count() + 5
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id > 3]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id is None)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language.predict(odd_rows(spark).where("lang is null")).collect()} == {"und"}


def test_toxicity_decodes_and_learns(spark):
    words = [f"w{chr(97 + i)}{chr(97 + j)}x" for i in range(12) for j in range(12)]
    rows, marks = [], []
    for i in range(400):
        text = [words[(i * 7 + k * (i % 11 + 1)) % 144] for k in range(20)]
        if i % 4 == 0:
            text.insert(i % 19, "grumble")
        rows.append((i, " ".join(text), "en", "s", 1))
        marks.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, DOCS).unionByName(spark.createDataFrame([(1000, "wabx gr0mb1e wabx", "", "", 0), (1001, "wabx g r u m b l e wacx", "", "", 0), (1002, "grummmmble wabx", "", "", 0), (1003, None, "", "", 0), (1004, "", "", "", 0), (1005, "5 * 3 waax", "", "", 0)], DOCS))
    got = {r.doc_id: r for r in toxicity.predict(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400))
    assert [got[i].predicted for i in (1001, 1002, 1003, 1004, 1005)] == [1, 1, 0, 0, 0]
    assert toxicity.predict(docs.where("doc_id < 0"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect() == []


def test_additive_quantisation(spark):
    import numpy as np

    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    odd = spark.createDataFrame([(9000, [0.0] * 64, 1), (9050, None, 1), (9100, [float("nan")] * 64, 1), (9150, [None] * 64, 1), (9200, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    first = table.where("vec_id = 3")
    copies = spark.range(40).crossJoin(first.select("embedding", "label")).selectExpr("9301 + id as vec_id", "embedding", "label")
    every = table.unionByName(odd).unionByName(copies)
    got = quantise.search(every).collect()
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.unionByName(copies).collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -np.round(s, 12)))[:5]]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        hit += len(set(best.tolist()) & {r.vec_id for r in mine})
        total += 5
    assert hit >= 0.95 * total
    assert not {r.query_id for r in got} & {9000, 9050, 9100, 9150}
    assert quantise.search(table.where("vec_id < 0")).collect() == []


def test_sharding(spark, docs, tmp_path):
    path = f"file://{tmp_path}/store"
    store = shards.ShardStore(spark, path, target=200_000, base=20_000, fanout=3)
    for i in range(7):
        store.append(docs.where(f"doc_id % 7 = {i}"), str(i))
    assert store.version() == 7 and len(store.manifest()) == 7 and len(store.manifest(3)) == 3
    store.compact()
    runs = store.manifest()
    assert not store.plan(runs) and sorted(a for r in runs for a in r["arrivals"]) == [str(i) for i in range(7)]
    assert sorted(r.doc_id for r in store.read(["doc_id"]).collect()) == sorted(r.doc_id for r in docs.collect())
    with pytest.raises(RuntimeError):
        store.commit(runs, store.version() - 1)
    assert store.manifest() == runs
    rows = docs.unionByName(odd_rows(spark))
    got = shards.shard(rows, arrivals=5, base=1000, fanout=2).collect()
    assert sorted((r.doc_id or -1, r.n_bytes) for r in got) == sorted((r.doc_id or -1, len((r.text or "").encode())) for r in rows.collect())
    assert shards.shard(docs.where("doc_id < 0")).collect() == []


def test_pipeline(spark, docs, labels):
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns
    few = good.limit(60)
    twice = few.unionByName(few.orderBy("doc_id").limit(10).selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars"))
    one = stages["near_duplicates"](spark, twice, SF)
    assert one.columns == docs.columns and one.where("doc_id >= 100000").count() == 0
    kept = stages["passages"](spark, one, SF)
    assert kept.columns == docs.columns and kept.count() == one.count()
    clean = stages["contamination"](spark, kept, SF)
    assert clean.columns == docs.columns
    out = stages["encoding"](spark, clean, SF).collect()
    assert all(len(r.ids) == r.n_tokens and hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 for r in out)


def test_similar_takes_candidates_from_fingerprints(spark, monkeypatch):
    """Near copies that share no band of min-hashes are found by their fingerprints alone."""
    drawn = iter(range(1, 1 << 40))
    monkeypatch.setattr(simhash, "_bands", lambda own: simhash.np.array([next(drawn) * 977 + hash(own.tobytes()) % (1 << 50) for _ in range(simhash.BANDS)], simhash.np.uint64))
    text = [f"w{i}" for i in range(900)]
    rows = [(1, " ".join(text)), (2, " ".join([*text, "more"])), (3, " ".join(text[::-1]))]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
