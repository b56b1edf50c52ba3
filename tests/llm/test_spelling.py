"""Words, neighbours, forms and roots against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from skerry.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string"


def corpus():
    rnd = random.Random(3)
    stems = ["".join(rnd.choices("abcdeé", k=rnd.randint(4, 9))) for _ in range(25)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rnd.randint(0, 25)):
            w = rnd.choice(stems)
            if rnd.random() < 0.4:
                at = rnd.randrange(len(w) + 1)
                w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + rnd.choice("abcÀß") + w[at:], w[:at] + rnd.choice("abcde") + w[at + 1 :]])
            words.append(rnd.choice([w, w.upper(), w.capitalize()]))
        rows.append((i, rnd.choice([" ", "-", "1"]).join(words), "x", "y"))
    return rows + [(None, "aabbcc aabbcc", "x", "y"), (5000, None, "x", "y"), (5001, "", "x", "y"), (5002, "!! 12", "x", "y"), (5003, "zzzzzz " * 4000 + "q" * 60_000, "x", "y"), rows[7], rows[7]]


def brute(rows, drop=97):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if drop and h % drop == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def apart(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        near = sorted(((-m, v) for v, m in words.items() if apart(w, v)))
        has = near and -near[0][0] >= 2 * n
        form[w] = near[0][1] if has else None
        out[w] = (form[w], n, len(near), -near[0][0] if has else None)
    root = {}
    for w in words:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return {(w, f, root[w], n, k, m) for w, (f, n, k, m) in out.items()}


@pytest.mark.parametrize("drop, size", [(97, 1 << 18), (3, 9)])
def test_variants_against_brute_force(spark, monkeypatch, drop, size):
    monkeypatch.setattr(spelling, "SHARD_WORDS", size)
    rows = corpus()
    got = spelling.group_variants(spark.createDataFrame(rows, SCHEMA), drop=drop)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = [tuple(r) for r in got.collect()]
    want = brute(rows, drop)
    assert len(found) == len(want) and set(found) == want and sum(f is not None for _, f, *_ in want) > 20


def test_empty_table(spark):
    assert spelling.group_variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_chain_of_forms_to_its_root(spark):
    text = " ".join(["abcdefgh"] * 48 + ["abcdefg"] * 24 + ["abcdef"] * 12 + ["abcde"] * 6)
    got = {r.word: (r.form, r.root) for r in spelling.group_variants(spark.createDataFrame([(1, text, "", "")], SCHEMA), drop=0).collect()}
    assert got == {"abcdefgh": (None, "abcdefgh"), "abcdefg": ("abcdefgh", "abcdefgh"), "abcdef": ("abcdefg", "abcdefgh"), "abcde": ("abcdef", "abcdefgh")}


def test_trie_holds_its_words_and_no_others():
    words = sorted({"".join(random.Random(i).choices("abc", k=random.Random(i).randint(1, 5))) for i in range(120)})
    trie = spelling.Trie(words, list(range(1, len(words) + 1)))
    for w in ["", "a", "abcab", "zz", *words]:
        near = list(trie.near(w))
        assert len(near) == len({x for x, _ in near}) and w not in dict(near)
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for c in "abc" for i in range(len(w) + 1)} | {w[:i] + c + w[i + 1 :] for c in "abc" for i in range(len(w))}
        assert set(near) == {(x, words.index(x) + 1) for x in edits - {w} if x in words}
