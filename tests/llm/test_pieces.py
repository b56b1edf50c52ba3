import random

import pytest

from skerry.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")


def test_encoding_and_decoding_equal_the_library():
    m, lib = pieces.PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rnd = random.Random(7)
    parts = [*"aabbcthe  \n\t.,▁éßü日本🙂²\u0000​$#0123 ", "<0x0A>", "</s>", "　", "  ", "the", "ing", " of", "́"]
    cache = pieces.WordCache()
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        ids = lib.encode(text)
        assert m.encode(text) == ids
        assert m.decode(ids) == lib.decode(ids)
        assert m.digest(text, cache) == (len(ids), ",".join(map(str, ids)), lib.decode(ids))
    for _ in range(2000):
        ids = [rnd.choice([1, 2, 3 + rnd.randrange(256), rnd.randrange(32000)]) for _ in range(rnd.randint(0, 8))]
        assert m.decode(ids) == lib.decode(ids)


def test_query_columns(spark):
    rows = [(1, "The cat\nsat. ", 5), (2, None, 6), (None, "", 7), (1, "The cat\nsat. ", 5)]
    got = pieces.encode_texts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH, keep_ids=True, keep_text=True).collect()
    assert len(got) == 4 and [r.decoded for r in got if r.doc_id == 1] == ["The cat\nsat. "] * 2
    assert all(r.n_tokens == len(r.ids) for r in got) and sum(r.n_tokens for r in got if r.doc_id != 1) == 0
    assert pieces.encode_texts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
