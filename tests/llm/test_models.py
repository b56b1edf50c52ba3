"""Importance weights and draws against plain sums; toxicity that only decoding finds."""

import math
import random
from collections import Counter

import numpy as np

from skerry.llm import importance, toxicity


def _grams(text):
    """Tokens and pairs as hashed buckets, one text at a time."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return importance.ngrams(raw, np.array([0, len(raw)]))[0].tolist()


def test_weights_and_top_k_against_plain_sums(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices([f"{'g' if i % 3 else 'b'}{k}" for k in range(30)], k=rnd.randint(0, 40)))) for i in range(80)] + [(90, None), (91, ""), (5, None)]
    marks = [(i, int(i % 3 > 0)) for i in range(0, 60, 2)] + [(91, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = importance.weigh(df, labels).collect()
    raw, target = Counter(), Counter()
    for d, t in rows:
        raw.update(_grams(t))
        if dict(marks).get(d) == 1:
            target.update(_grams(t))
    part = sum(target.values()) / sum(raw.values())
    ratio = {g: math.log((target[g] + importance.SMOOTH) / (raw[g] * part + importance.SMOOTH)) for g in raw}
    want = sorted((d, len(_grams(t)), round(sum(ratio[g] for g in _grams(t)), 6)) for d, t in rows)
    assert sorted((r.doc_id, r.n_grams, round(r.log_weight, 6)) for r in got) == want
    for k in (0, 1, 7, 60, 500):
        chosen = [r.draw for r in importance.resample(df, labels, k=k).where("selected").collect()]
        assert sorted(chosen) == sorted((r.draw for r in got), reverse=True)[:k][::-1]


def test_gumbel_draws_follow_the_weights(spark):
    """Equal texts under many ids: the noise alone decides, and has the Gumbel distribution."""
    df = spark.range(4000).selectExpr("id as doc_id", "'a b' as text")
    got = np.sort([r.draw - r.log_weight for r in importance.weigh(df, spark.createDataFrame([], "doc_id long, quality int")).collect()])
    at = np.exp(-np.exp(-got))
    assert np.abs(at - (np.arange(4000) + 0.5) / 4000).max() < 0.03


def _corpus():
    rnd = random.Random(8)
    plain = ["".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randint(3, 8))) for _ in range(300)]
    bad = ["grumbler", "scoundrel", "nitwit", "blockhead"]
    rows = []
    for i in range(600):
        words = rnd.choices(plain, k=25)
        toxic = i % 4 == 0
        if toxic:
            for w in rnd.sample(bad, 2):
                words.insert(rnd.randrange(25), w)
        rows.append((" ".join(words), int(toxic)))
    return rnd, plain, bad, rows


def test_only_decoding_finds_hidden_toxicity():
    rnd, plain, bad, rows = _corpus()
    counts = np.zeros(toxicity.ALPHABET**3, np.int64)
    for text, _ in rows:
        s = toxicity._symbols(f" {text}  ")
        np.add.at(counts, (s[:-2] * toxicity.ALPHABET + s[1:-1]) * toxicity.ALPHABET + s[2:], 1)
    scorer = toxicity._scorer(rows, counts)
    swap = {"o": "0", "e": "3", "i": "1", "l": "1", "t": "7", "s": "5", "b": "8"}

    def hidden(word, way):
        if way == 0:
            at = [i for i, c in enumerate(word) if c in swap]
            return "".join(swap[c] if i in at[:2] else c for i, c in enumerate(word))
        if way == 1:
            return " ".join(word)
        return word[:3] + word[2] * 3 + word[3:]

    texts, clean = [], []
    for i in range(150):
        words = rnd.choices(plain, k=25)
        clean.append(" ".join(words) + f" room {rnd.randint(1, 999)} 3rd 10x b2b")
        words.insert(rnd.randrange(25), hidden(bad[i % 4], i % 3))
        texts.append(" ".join(words))
    found, left = scorer.score(texts) >= toxicity.THRESHOLD, scorer.score(clean) < toxicity.THRESHOLD
    assert found.mean() >= 0.9 and left.mean() >= 0.98
    scorer.channel.restore = lambda stretch: stretch
    assert (scorer.score(texts) >= toxicity.THRESHOLD).mean() < 0.1


def test_scores_are_graded_and_calibrated():
    rnd, plain, bad, rows = _corpus()
    noisy = [(t, y if rnd.random() < 0.9 else 1 - y) for t, y in rows]
    scorer = toxicity._scorer(noisy, np.ones(toxicity.ALPHABET**3, np.int64))
    score = scorer.score([t for t, _ in rows])
    y = np.array([y for _, y in rows])
    assert 0.75 <= score[y == 1].mean() <= 0.99 and 0.01 <= score[y == 0].mean() <= 0.25 and len(np.unique(score)) > 2
    assert len(set(scorer.score([None, "", " "]).tolist())) == 1
