import random

import pytest
from pyspark.sql import functions as F

from skerry.functions import text as T


def col(spark, values, f):
    return [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def pack(text, size=800, overlap=100):
    import re

    parts = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    out, cur = [], []
    for p in parts:
        if len(p) > size:
            if cur:
                out.append("\n\n".join(cur))
            at = 0
            while True:
                w = p[at : at + size].strip()
                if w:
                    out.append(w)
                if at + size >= len(p):
                    break
                at += size - overlap
            cur = []
            continue
        if cur and sum(map(len, cur)) + len(p) > size:
            out.append("\n\n".join(cur))
            kept, n = [], 0
            for q in reversed(cur):
                if n + len(q) > overlap:
                    break
                kept.insert(0, q)
                n += len(q)
            cur = kept
        cur = [*cur, p]
    if cur:
        out.append("\n\n".join(cur))
    return out


def test_pack_paragraphs(spark):
    rnd = random.Random(1)
    texts = ["\n\n".join("".join(rnd.choices("abc d", k=rnd.choice([5, 40, 90, 300, 500, 900, 1700]))) for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    assert col(spark, texts, T.pack_paragraphs) == [pack(t) for t in texts]


def test_names(spark):
    assert col(spark, ["  Acme, Inc. ", "ÉTÉ-Co  Ltd", "Inc Ltd", None, "a_b"], lambda x: T.strip_legal_suffix(T.normalize_name(x))) == ["acme", "été", "inc ltd", None, "a_b"]


def test_confidence(spark):
    assert col(spark, ["HIGH", "medium", " low", "0.4", "7", "-1", "soon", None], T.confidence) == [0.9, 0.6, 0.3, 0.4, 1.0, 0.0, 1.0, 1.0]


def test_duration(spark):
    assert col(spark, ["1h45m7.2s", "577ms", "2m", "x", None], T.duration_seconds) == pytest.approx([6307.2, 0.577, 120.0, 0.0, 0.0])


def test_citations(spark):
    text = "Short one. This is a long sentence without any marker. A cited one stands here [1]. The marker trails the stop here. [12]"
    assert col(spark, [text, None], T.markers) == [[1, 12], None]
    assert col(spark, [text], T.uncited) == [["This is a long sentence without any marker."]]


def test_json_object(spark):
    assert col(spark, ['x ```json\n{"a": "}{", "b": {"c": 1}} {"d": 2}', "none", '{"open": 1', r'{"q": "\"}"}'], T.json_object) == ['{"a": "}{", "b": {"c": 1}}', None, None, r'{"q": "\"}"}']
