import hashlib
import random
import re

import pytest

from skerry.llm import decontaminate


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k : k + n]))
                if got:
                    found |= got
                    hit |= set(range(k, k + n))
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [10, 100000])
def test_against_brute_force(spark, block):
    rnd = random.Random(1)
    vocabulary = ["Ab", "été", "x9", "THE", "a-b", "日本", "q"]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 30)))) for i in range(12)] + [(12, None), (None, "lone words here"), (13, "été"), (14, "")]
    docs = [(None, None), (0, "")]
    for d in range(40):
        parts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 15)))]
        for _ in range(rnd.randint(0, 2)):
            w = (rnd.choice(items)[1] or "").split()
            k = rnd.randint(0, max(0, len(w) - 3))
            parts += ["\n".join(w[k : k + rnd.randint(1, 25)]).upper(), " ".join(rnd.choices(vocabulary, k=4))]
        docs.append((d % 37, ", ".join(parts)))
    left = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, hits int")
    right = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = decontaminate.digest(decontaminate.find_windows(left, right, 10, 3, block)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items, 10)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.digest(decontaminate.find_windows(docs, none)).collect()] == [(1, 3, 0, 0)]
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.find_windows(docs.where("doc_id > 1"), items).collect() == []
