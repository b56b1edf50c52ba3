"""Cuts and outputs against a regular expression, SQL and an exact round trip."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from skerry.llm import middle

SCHEMA = "doc_id long, text string, key string, code string, rest string"
TOKEN = re.compile("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+")


def rows():
    rnd = random.Random(8)
    pool = ["a", "bé", "日本語", "\U0001f600", "x<", "P>", "<", "S>y", "word", " ", " z"]
    texts = ["".join(rnd.choice(pool) + rnd.choice([" ", "\n", "  \t", "\r\n", ""]) for _ in range(rnd.randint(1, 60))) for _ in range(120)]
    texts += ["", " ", "\n\t ", " a", "a ", "a <P> b", "b<S>", "<M>", "a b " * 40_000, "z" * 90_000, "\u0000 x"]
    out = [(i, t, "k", "c", "r") for i, t in enumerate(texts)]
    out += [(1000 + i, texts[i % 7], "k", "c", "r") for i in range(60)] + [(2000 + i, texts[3], "k", "c", "r") for i in range(50)]
    return out + [(None, None, None, None, None), (None, "some text here", None, None, None), out[4], out[4], (3000, None, "k", "c", "r")]


def brute(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, len(tokens), "plain", None, None, text)
    form = "spm" if h4 % 100 < 80 else "psm"
    return (doc_id, len(tokens), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def test_against_brute_force_and_round_trip(spark):
    given = rows()
    got = middle.transform(spark.createDataFrame(given, SCHEMA).repartition(5), keep_text=True).collect()
    want = sorted(map(repr, (brute(d, t) for d, t, *_ in given)))
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == want
    by = {}
    for d, t, *_ in given:
        by.setdefault(d, set()).add(t or "")
    for r in got:
        text = middle.restore(r.output, r.form)
        assert text in by[r.doc_id] and r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert r.rest.key == (None if r.doc_id is None else "k")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert middle.transform(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql_agrees(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    assert sorted(db.execute(middle.SQL).fetchall()) == sorted(tuple(r) for r in middle.transform(spark.read.parquet(path)).collect())


@pytest.mark.parametrize("most, n", [(1, 1), (0, 3), (10, 10), (5000, 7), (123456, 40_000), (100, 1000)])
def test_elias_fano(most, n):
    values = np.sort(np.random.default_rng(n).integers(0, most + 1, n))
    code = middle.elias_fano(values)
    assert middle.count(code) == n and all(middle.select(code, i) == values[i] for i in range(0, n, max(1, n // 500)))
    assert len(code) <= 9 + (n * (2 + max(0, np.log2(max(1, most / n)))) + 16) / 8 + 2
    with pytest.raises(IndexError):
        middle.select(code, n)


def test_one_code_for_each_distinct_text_that_stands_twice(spark, monkeypatch):
    given = spark.createDataFrame([(i, "same text " * 5, "", "", "") for i in range(40)] + [(99, "other", "", "", "")], SCHEMA)
    joined = middle.with_boundaries(given)
    assert joined.where("code is not null").select("code").distinct().count() == 1 and joined.where("code is null").count() == 1
