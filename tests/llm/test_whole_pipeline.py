"""All stages of run() on a small corpus, each held against a plain version on its own input."""

import hashlib
import random
import re

import pytest

import corpus_pipeline
from skerry.llm.queries import tokenizer_path

from test_decontaminate import brute as brute_items
from test_pipeline import _brute as brute_groups

sentencepiece = pytest.importorskip("sentencepiece")


def _without_passages(texts, over=50):
    """Texts without the words, and the blanks between them, of each run of over `over` words that also stands elsewhere."""
    words = [list(re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())) for t in texts]
    seen = {}
    for t, ws in zip(texts, words):
        raw = t.encode()
        for i in range(len(ws) - over):
            w = raw[ws[i].start() : ws[i + over].end()]
            seen[w] = seen.get(w, 0) + 1
    return [[(ws[i].start(), ws[i + over].end()) for i in range(len(ws) - over) if seen[t.encode()[ws[i].start() : ws[i + over].end()]] > 1] for t, ws in zip(texts, words)]


def test_pipeline_against_brute_force(spark, tmp_path):
    rnd = random.Random(12)
    word = lambda p="w": f"{p}{rnd.randrange(4000)}"
    passage, item = " ".join(word("pp") for _ in range(60)), " ".join(word("it") for _ in range(25))
    rows = []
    for i in range(90):
        text = [word() for _ in range(rnd.randint(30, 120))]
        if i % 6 == 0:
            text[10:10] = passage.split()
        if i % 7 == 0:
            text[5:5] = item.split()[3:16]
        rows.append([i, " ".join(text), "en", "s", 0])
    rows += [[100 + i, rows[i][1], "en", "s", 0] for i in range(0, 20, 2)]
    rows += [[200 + i, rows[i][1].replace(" ", "  ", 1) + " more", "en", "s", 0] for i in range(1, 20, 3)]
    rows += [[300 + i, "spam " * 80, "en", "s", 0] for i in range(12)]
    for r in rows:
        r[4] = len(r[1])
    marks = [(i, 1, 0) for i in range(0, 90, 2)] + [(300 + i, 0, 0) for i in range(0, 12, 2)]
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", marks, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    sf = str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    good = stages["quality"](spark, docs, sf)
    kept = sorted((r.doc_id, r.text) for r in good.collect())
    assert not {d for d, _ in kept if 300 <= d < 400} and {d for d, _ in kept} >= set(range(0, 90, 2))

    one = stages["near_duplicates"](spark, good, sf)
    group = brute_groups([t for _, t in kept])
    first = sorted(kept[i] for i in sorted(set(group)))
    assert sorted((r.doc_id, r.text) for r in one.collect()) == first

    cut = {r.doc_id: r.text for r in stages["passages"](spark, one, sf).collect()}
    for (d, t), spans in zip(first, _without_passages([t for _, t in first])):
        gone = set().union(*(range(s, e) for s, e in spans)) if spans else set()
        left = bytes(c for i, c in enumerate(t.encode()) if i not in gone).decode()
        # the bytes next to a passage may repeat, too: what is left is at most the blanks and beginnings of words there
        assert left.split() == cut[d].split() or (spans and len(left) - 12 <= len(cut[d]) <= len(left))

    rest = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in cut.items()], docs.schema)
    clean = sorted(r.doc_id for r in stages["contamination"](spark, rest, sf).collect())
    assert clean == sorted(x[0] for x in brute_items(list(cut.items()), [(1, item)], 10) if not x[5]) and 0 < len(clean) < len(cut)

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(got) == clean
    for d in clean:
        ids = lib.encode(cut[d])
        assert got[d] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
