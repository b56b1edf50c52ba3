"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

import hashlib
import random

import pytest

import corpus_pipeline
from skerry.llm import automaton, decontaminate, importance, language, middle, pieces, prefix_tree, quantise, shards, simhash, spelling, suffix_array, toxicity
from skerry.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
#: Names that operators use inside.
CLASH = ["d", "key", "start", "c", "n", "anchor", "context", "starts", "marks", "rest", "fp", "node", "component", "label", "score", "draw", "hits", "item_ids", "version", "run", "shard", "_arrival", "_key", "noise", "group", "own", "class", "code", "form", "word", "output"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rnd = random.Random(9)
    long = " ".join(rnd.choices([f"word{i}" for i in range(500)], k=150_000))
    some = [" ".join(rnd.choices([f"word{i}" for i in range(500)], k=60)) for _ in range(6)]
    return [(1, some[0]), (2, some[0]), (2, some[0]), (3, some[1]), (None, some[2]), (4, None), (5, ""), (6, "  \t\n"), (7, "!?"), (8, long), (9, "z" * 200_000), (10, "Ünï 日本 \U0001f600 " * 30), (None, None), (11, some[3] + "\u0000" + some[4])]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts()], DOCS)


@pytest.fixture(scope="module")
def clashing(plain):
    from pyspark.sql import functions as F

    return plain.select("*", *[F.lit(f"{c}!").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (None, 1, 1), (8, None, None), (8, 1, 0), (11, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(texts()[0][1].split()[5:25])), (2, None), (3, ""), (None, "zq zq")], "item_id long, text string")


def run(name, docs, labels, items):
    return {
        "importance": lambda: importance.resample(docs, labels).drop("text", "rest"),
        "simhash": lambda: simhash.near_duplicates(docs),
        "similar": lambda: simhash.similar(docs),
        "language": lambda: language.predict(docs),
        "toxicity": lambda: toxicity.predict(docs, labels),
        "pieces": lambda: pieces.encode_texts(docs, tokenizer_path()),
        "decontaminate": lambda: decontaminate.digest(decontaminate.find_windows(docs, items)),
        "suffix_array": lambda: suffix_array.remove_repeats(docs),
        "passages": lambda: suffix_array.remove_repeats(docs, over=50),
        "automaton": lambda: automaton.remove_repeats(docs),
        "shards": lambda: shards.shard(docs).drop("run", "shard"),
        "prefix_tree": lambda: prefix_tree.join(docs),
        "middle": lambda: middle.transform(docs),
    }[name]()


@pytest.mark.parametrize("name", ["importance", "simhash", "similar", "language", "toxicity", "pieces", "decontaminate", "suffix_array", "passages", "automaton", "shards", "prefix_tree", "middle"])
def test_operators_on_odd_rows(spark, plain, clashing, labels, items, name):
    got = run(name, plain, labels, items).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in texts())
    assert sorted(map(repr, run(name, clashing, labels, items).collect())) == sorted(map(repr, got))
    assert sorted(repr(r) for r in got if r["doc_id"] == 2)[0] == sorted(repr(r) for r in got if r["doc_id"] == 2)[1]
    assert run(name, clashing.where("doc_id < 0"), labels, items).collect() == []


def test_words_of_odd_rows(clashing):
    got = {r.word: (r.n, r.n_near) for r in spelling.group_variants(clashing).collect()}
    assert all(n >= 3 and len(w) >= 5 for w, (n, _) in got.items()) and got == {}  # words here end in digits: "word" has four letters
    assert spelling.group_variants(clashing, least_length=4, drop=0).where("word = 'word'").first().n > 150_000


def test_values_on_odd_rows(plain, labels, items):
    rows = texts()
    by = {name: {r["doc_id"]: r for r in run(name, plain, labels, items).collect()} for name in ("simhash", "pieces", "decontaminate", "suffix_array", "automaton")}
    for d, t in rows:
        if d is not None:
            n_words = len((t or "").encode().split())
            assert by["automaton"][d].n_words == n_words and by["suffix_array"][d].n_bytes == len((t or "").encode())
            assert (by["pieces"][d].n_tokens > 0) == bool((t or "").strip(" "))
            if not n_words:
                assert by["simhash"][d].fingerprint == "0" * 16 and by["simhash"][d].component_id == 4
    assert by["automaton"][1].n_removed == 0 and by["automaton"][2].n_removed == 60 and by["suffix_array"][9].n_removed == 200_000
    assert by["automaton"][8].n_removed == 0 and by["suffix_array"][8].n_removed == 0 and by["automaton"][10].n_removed == 90 - 3
    assert by["decontaminate"][1].n_hit == 20 and by["decontaminate"][1].items_sha256 == hashlib.sha256(b"1").hexdigest() and not by["decontaminate"][8].contaminated


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, clashing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, clashing, SF)
    if name != "encoding":
        assert got.columns == clashing.columns
        assert all(r[c] == f"{c}!" for r in got.select(*CLASH).distinct().collect() for c in CLASH)
    n = got.count()
    assert n == len(texts()) if name in ("passages", "encoding", "contamination") else 0 <= n <= len(texts())
    if name == "near_duplicates":
        assert n == 9  # of 1, 2 and 2, and of the null, empty and blank texts, one each
    assert stage(spark, clashing.where("doc_id < 0"), SF).count() == 0


def test_long_text_of_one_stretch():
    channel = toxicity.Scorer(["you grumble"] * 9, ["fine day"] * 9, __import__("numpy").ones(toxicity.ALPHABET**3, int)).channel
    assert len(channel.restore("z" * 20_000)) <= 20_000 and len(channel.restore("a1" * 5_000)) >= 5_000


def test_vectors_with_ties_and_clashing_columns(spark):
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 1.0]
    rows = [(0, one), (5, two), (3, [2.0, 0.0, 0.0]), (9, [1.0, 1e-3, 0.0]), (8, [1.0, -1e-3, 0.0]), (7, [1.0, 0.0, 1e-3]), (11, None), (None, one), (0, one), (12, [])]
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], "vec_id long, embedding array<float>, v string, entry string, codes string")
    got = [(r["rank"], r.vec_id) for r in quantise.search(df).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(1, 3), (2, 7), (3, 8), (4, 9), (5, 5)]  # 7, 8 and 9 are equally near
    assert quantise.search(df.where("vec_id > 99")).collect() == []
