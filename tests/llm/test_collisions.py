"""Words whose mixed blocks collide by construction are different words, for removal and for near-duplicates."""

import numpy as np

from skerry.llm import automaton, simhash, vec

ONE, TWO = "aaaaaaaabbbbbbbb", 'kvxsvjtkt!",6m,]'


def built(spark):
    words = [f"w{i}" for i in range(19)]
    rows = [(i, " ".join([*words[:9], w, *words[9:]])) for i, w in ((1, ONE), (2, TWO))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_words_that_collided(spark):
    assert [r.n_removed for r in automaton.remove_repeats(built(spark)).orderBy("doc_id").collect()] == [0, 0]
    assert {r.doc_id: r.component_id for r in simhash.similar(built(spark)).collect()} == {1: 1, 2: 2}


def test_word_hashes_are_distinct_and_place_free():
    words = [ONE, TWO, "a", "a\0", "\0", "\0\0", "ab", "abcdefg", "abcdefgh", "abcdefgh\0", "é", "z" * 5000, "z" * 5001]
    for text in (" ".join(words), "  x " + "\n".join(words)):
        buf = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = vec.word_places(buf, np.array([0, len(buf)]), vec.NOT_SPACE)
        got = vec.word_hashes(buf, starts, ends)[-len(words) :]
        assert len(set(got.tolist())) == len(words)
        first = got if text.startswith(ONE) else first
        assert (got == first).all()
        data, begin, end = vec.joined(buf, starts, ends)
        assert [data[b:e].decode() for b, e in zip(begin, end)][-len(words) :] == words


def test_shingles_agree_with_their_words():
    texts = ["A b  c d", "x A\tB c d", "b c", "", "b C"]
    key = vec.shingle_key(3)
    data = "".join(texts).encode()
    hashes, at = vec.shingles(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)]), key)
    named = [[" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if (w := t.lower().split()) else [] for t in texts]
    flat = [s for own in named for s in own]
    assert [len(x) for x in named] == np.diff(at).tolist()
    assert all((hashes[i] == hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
