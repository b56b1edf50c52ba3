import hashlib
import random

import numpy as np
import pytest

from skerry.llm import automaton, suffix_array, vec

SCHEMA = "doc_id long, text string, extra string"


def corpus(seed, by_word):
    rnd = random.Random(seed)
    vocabulary = ["a", "bé", "ccc", "the", "of", "日本"]
    passages = [" ".join(rnd.choices(vocabulary + [f"w{i}" for i in range(50)], k=rnd.randint(20, 60))) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            parts.append(rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choices([f"x{k}" for k in range(40)], k=rnd.randint(1, 30))))
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(parts), "e"))
    rows += [(50, None, None), (51, "", "e"), (52, "ab " * 300, "e"), (53, "z" * 900, "e"), (54, rows[3][1], "e"), (55, rows[3][1], None), (None, "short", "e"), (57, "ab " * 40, "e")]
    return rows


def brute_bytes(rows, length):
    raws = [(r[1] or "").encode() for r in rows]
    seen = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = []
    for (doc_id, *_), raw in zip(rows, raws):
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(raw)]).sum()) if raw else 0
        out.append((doc_id, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, window):
    first = {}
    docs = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for d, w in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (d, i):
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("crowd", [256, 1])
def test_bytes_against_brute_force(spark, crowd):
    rows = corpus(1, False)
    got = suffix_array.remove_repeats(spark.createDataFrame(rows, SCHEMA), 40, 8, crowd).collect()
    assert order(got) == order(brute_bytes(rows, 40))


@pytest.mark.parametrize("crowd", [256, 1])
def test_words_against_brute_force(spark, crowd):
    rows = corpus(2, True)
    got = automaton.remove_repeats(spark.createDataFrame(rows, SCHEMA), 8, 3, crowd).collect()
    assert order(got) == order(brute_words(rows, 8))


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "q" * 500, "e"), (1, "q" * 500, "e"), (2, "r s t " * 3, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert order(suffix_array.remove_repeats(df).collect()) == order(brute_bytes(rows, 400))
    assert [r.n_removed for r in automaton.remove_repeats(df.where("doc_id = 1")).collect()] == [0, 0]
    none = df.where("doc_id > 9")
    assert suffix_array.remove_repeats(none).collect() == [] and automaton.remove_repeats(none).collect() == []


def test_bucket_pointer_refinement():
    rnd = random.Random(3)
    for length in (8, 12, 40):
        texts = [bytes(rnd.choices(b"ab", k=rnd.randint(0, 120))) for _ in range(6)]
        texts.append(texts[0])
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
        got = suffix_array.refine(data, ends, length)
        whole = [bytes(data[i : i + length]) if i + length <= ends[i] else None for i in range(len(data))]
        for i, w in enumerate(whole):
            assert (got[i] >= 0) == (w is not None and whole.count(w) > 1)
            if got[i] >= 0:
                assert [j for j in range(len(whole)) if got[j] == got[i]] == [j for j in range(len(whole)) if whole[j] == w]


def test_matching_statistics():
    rnd = random.Random(4)
    for _ in range(30):
        known = [rnd.choices("abc", k=rnd.randint(0, 15)) for _ in range(4)]
        sam = automaton.SuffixAutomaton()
        for k in known:
            sam.add(k)
        text = rnd.choices("abcd", k=25)
        inside = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
        want = [max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in inside), default=0) for i in range(len(text))]
        assert sam.statistics(text) == want


def test_reference(spark):
    docs = spark.createDataFrame([(1, "x " + " ".join(map(str, range(30))) + " y"), (2, None), (3, "a b")], "doc_id long, text string")
    got = automaton.remove_reference(docs, spark.createDataFrame([(" ".join(map(str, range(5, 30))),), (None,)], "text string"), keep_text=True).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed) for r in got] == [(32, 25), (0, 0), (2, 0)]
    assert got[0].kept == "x 0 1 2 3 4 y"


def test_equal_windows_share_anchors():
    rnd = random.Random(5)
    text = bytes(rnd.choices(b"abcdef", k=3000))
    a, b = b"zz" + text, text[500:2500]
    data = np.frombuffer(a + b, np.uint8)
    t, anchor, start, count, _ = vec.anchors(vec.BYTE[data], np.array([0, len(a), len(a) + len(b)]), 100, 16)
    assert count[t == 0].sum() == len(a) - 99 and count[t == 1].sum() == len(b) - 99
    at = [dict(x for h, s, n in zip(anchor[t == k], start[t == k], count[t == k]) for x in ((int(s) + i, int(h)) for i in range(n))) for k in (0, 1)]
    assert all(at[1][i] == at[0][i + 502] for i in at[1])


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024])
def test_texts_built_to_collide(spark, n):
    """A Thue-Morse word and its complement, which polynomial hashes modulo 2^64 can't tell apart."""
    one = thue_morse(n)
    two = one.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{one} {tail}", "e"), (2, f"{two} {tail}", "e")]
    got = automaton.remove_repeats(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [0, 0]
    words = [(i, " ".join(t), "e") for i, t in enumerate((one, two))]
    assert order(automaton.remove_repeats(spark.createDataFrame(words, SCHEMA)).collect()) == order(brute_words(words, 20))
    rows = [(i, t, "e") for i, t in enumerate((one, two))]
    assert order(suffix_array.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()) == order(brute_bytes(rows, 400))


def test_production_parameters_against_brute_force(spark):
    rnd = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(150))
    rows = []
    for i in range(300):  # one passage in most texts, another in some, copies and near copies
        own = [f"x{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 60))]
        at = rnd.randint(0, len(own))
        part = passage.split()[rnd.randint(0, 30) : 150 - rnd.randint(0, 30)] if i % 3 else passage.split()
        rows.append((i, " ".join(own[:at] + part * (1 + (i % 17 == 0)) + own[at:]), "e"))
    rows += [(1000 + i, rows[i][1], None) for i in range(0, 300, 11)]
    df = spark.createDataFrame(rows, SCHEMA)
    for bound in (1 << 20, 3000):
        assert order(suffix_array.remove_repeats(df, bound=bound).collect()) == order(brute_bytes(rows, 400))
        assert order(automaton.remove_repeats(df, bound=bound).collect()) == order(brute_words(rows, 20))


def test_all_that_goes_is_found_by_the_method(spark, monkeypatch):
    """With the refinement, or the automata, finding nothing, nothing is removed."""
    rows = corpus(6, False)
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(suffix_array, "shared_windows", lambda length: lambda rows: [([], []) for _ in rows])
    monkeypatch.setattr(automaton, "earlier_windows", lambda window: lambda rows: [([], []) for _ in rows])
    assert {r.n_removed for r in suffix_array.remove_repeats(df, 40, 8).collect()} == {0}
    assert {r.n_removed for r in automaton.remove_repeats(df, 8, 3).collect()} == {0}


def test_members_are_not_checkpointed(spark, monkeypatch):
    """What a checkpoint would hold uncompressed, the members and contexts, is stored as Parquet."""
    from skerry.llm import automaton, repeats

    plain = repeats.cut

    def watched(df):
        assert "held" not in df.columns and "context" not in df.columns
        return plain(df)

    monkeypatch.setattr(repeats, "cut", watched)
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, "a " + text)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in automaton.remove_repeats(docs).collect()} == {1: 0, 2: 40}


def test_refinement_sorts_few_plain_numbers(monkeypatch):
    """A batch goes to 400 bytes in at most six sorts of plain keys and none of an order: what it costs is mostly these."""
    rnd = random.Random(8)
    passage = bytes(rnd.choices(b"abcdefgh ", k=1500))
    texts = [passage[rnd.randint(0, 400) : 1500 - rnd.randint(0, 400)] + bytes(rnd.choices(b"abcdefgh ", k=300)) for _ in range(50)]
    sizes = [len(t) for t in texts]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.repeat(np.cumsum(sizes), sizes)
    sorts = []
    monkeypatch.setattr(np, "argsort", lambda *a, **b: pytest.fail("an order is sorted"))
    shared = getattr(suffix_array, "_shared", None)
    monkeypatch.setattr(suffix_array, "_shared", lambda *a: sorts.append(len(a[2])) or shared(*a), raising=False)
    got = suffix_array.refine(data, ends, 400)
    monkeypatch.undo()
    assert 1 < len(sorts) <= 6 and sum(sorts) <= 6 * len(data)
    seen = {}
    for i in range(len(data) - 399):
        if i + 400 <= ends[i]:
            seen.setdefault(bytes(data[i : i + 400]), []).append(i)
    assert {tuple(x) for x in seen.values() if len(x) > 1} == {tuple(np.flatnonzero(got == b)) for b in set(got[got >= 0])}


@pytest.mark.parametrize("bits", [63, 40, 16])
@pytest.mark.parametrize("length", [8, 13, 100])
def test_refinement_with_any_room_in_a_key(monkeypatch, bits, length):
    """Keys of several bucket numbers, of two, and such as hold no place beside them; strings that end where a step lands; positions that stand for more."""
    monkeypatch.setattr(suffix_array, "KEY_BITS", bits)
    rnd = random.Random(bits + length)
    base = bytes(rnd.choices(b"ab\xff", k=300))
    texts = [base, base[:100], base[100:], b"", base[50:150], base[100:116], b"a" * 200, base[:13], base[13:26], bytes(range(256))]
    sizes = [len(t) for t in texts]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.repeat(np.cumsum(sizes), sizes)
    often = np.repeat([i in (4, 9) for i in range(len(texts))], sizes)
    got = suffix_array.refine(data, ends, length, often=often)
    seen = {}
    for i in range(len(data)):
        if i + length <= ends[i]:
            seen.setdefault(bytes(data[i : i + length]), []).append(i)
    want = {tuple(x) for x in seen.values() if len(x) > 1 or often[x[0]]}
    assert want == {tuple(np.flatnonzero(got == b)) for b in set(got[got >= 0])}


def test_hashes_of_all_pieces():
    units = vec.mix(np.arange(1, 500, dtype=np.uint64))
    for gram in (1, 6, 32, 499):
        at = np.arange(len(units) - gram + 1)
        assert (vec.pieces(units, gram) == vec.ranged(vec.prefix(units), at, at + gram)).all()
