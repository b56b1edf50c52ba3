"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean embedding of its subwords, which are the 2- to 4-byte pieces of its words with word ends
marked, hashed into a fixed number of buckets. Embeddings and softmax are trained together by stochastic
gradient descent in numpy. As mean and softmax layer are linear, the two tables are multiplied once after
training, and a text's logits are a mean of rows. A temperature fitted on rows set aside calibrates the
scores, and the score below which a prediction is rejected is the one that keeps all but a stated share of
the right ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .toxicity import fold

#: Bound of the training sample, for each language; bytes of a text that training looks at at once.
ROWS_PER_LANG, PIECE = 500, 400
BUCKETS, DIM, GRAMS = 1 << 15, 16, (2, 3, 4)
#: Share of right predictions that rejection may cost.
REJECT = 0.005

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(97, 123), *range(128, 256)]] = True


def subwords(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all subwords, text of each) of folded bytes; what is no letter is one word end."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    letter = _LETTERS[buf]
    b = np.where(letter, buf, 32).astype(np.uint32)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at, owner = [], []
    h = b.copy()
    for g in range(2, max(GRAMS) + 1):
        if n < g:
            break
        h = h[:-1] * np.uint32(0x01000193) ^ b[g - 1 :]
        m = n - g + 1
        same = text[:m] == text[g - 1 :]
        # all letters but perhaps the outer two, at least one letter in all
        ok = same & (letter[:m] | letter[g - 1 :]) if g == 2 else same & _inner(letter, m, g)
        if g in GRAMS:
            x = (h ^ np.uint32(g * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            pick = np.flatnonzero(ok)
            at.append((x[pick] >> np.uint32(17)).astype(np.int64))
            owner.append(text[pick])
    return (np.concatenate(at), np.concatenate(owner)) if at else (np.empty(0, np.int64), np.empty(0, np.int64))


def _inner(letter: np.ndarray, m: int, g: int) -> np.ndarray:
    inside = letter[1 : m + 1].copy()
    for k in range(2, g - 1):
        inside &= letter[k : k + m]
    return inside


def _bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return fold(np.frombuffer(b"".join(raws), np.uint8)), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)


class Model:
    """Trained tables: logits of each bucket, bias, temperature, rejection score."""

    def __init__(self, langs: list[str], texts: list[str], labels: np.ndarray, visits: int = 40_000, rate: float = 0.5, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.langs = langs
        k = max(1, len(langs))
        pieces, y, aside = [], [], []
        order = rng.permutation(len(texts))
        for j, i in enumerate(order.tolist()):
            t = texts[i]
            for s in range(0, len(t), PIECE):  # the whole text, a piece at a time
                pieces.append(t[s : s + PIECE])
                y.append(labels[i])
                aside.append(j % 5 == 0)
        y, aside = np.array(y, np.int64), np.array(aside, bool)
        emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        top = np.zeros((DIM, k), np.float32)
        bias = np.zeros(k, np.float32)
        weight = len(y) / (k * np.maximum(1, np.bincount(y, minlength=k))) if len(y) else np.ones(k)
        train = np.flatnonzero(~aside)
        epochs = min(40, max(2, -(-visits // max(1, len(train)))))  # small samples are seen more often
        for epoch in range(epochs):
            lr = rate * (1 - epoch / epochs)
            rng.shuffle(train)
            for s in range(0, len(train), 32):
                rows = train[s : s + 32]
                at, owner = subwords(*_bytes([pieces[r] for r in rows]))
                n = np.bincount(owner, minlength=len(rows)).astype(np.float32)
                inv = 1 / np.maximum(n, 1)
                mean = np.zeros((len(rows), DIM), np.float32)
                cells = emb[at]
                edge = np.flatnonzero(np.diff(owner) < 0) + 1  # one block of owners for each size of piece
                for a, b in zip([0, *edge], [*edge, len(owner)]):
                    if b > a:
                        first = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
                        mean[owner[a:b][first]] += np.add.reduceat(cells[a:b], first, axis=0)
                mean *= inv[:, None]
                z = mean @ top + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p *= np.minimum(weight[y[rows]], 10)[:, None]
                down = (p @ top.T) * inv[:, None]
                top -= lr / len(rows) * mean.T @ p
                bias -= lr / len(rows) * p.sum(0)
                np.add.at(emb, at, (-lr * down)[owner])
        self.table, self.bias = (emb @ top).astype(np.float32), bias
        self.temperature, self.reject = 1.0, 0.0
        held = np.flatnonzero(aside)[:4000]
        if len(held) and k > 1:
            z = self.logits([pieces[r] for r in held])
            grid = np.geomspace(0.02, 5, 60)
            loss = [-np.mean(np.log(1e-12 + self._softmax(z / t)[np.arange(len(held)), y[held]])) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
            p = self._softmax(z / self.temperature)
            right = p.argmax(1) == y[held]
            if right.any():
                self.reject = float(np.quantile(p.max(1)[right], REJECT))

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        return self._logits(*_bytes(texts))

    def _logits(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at, owner = subwords(buf, offsets)
        n = len(offsets) - 1
        count = np.maximum(1, np.bincount(owner, minlength=n))
        sums = np.stack([np.bincount(owner, weights=self.table[at, j], minlength=n) for j in range(self.table.shape[1])], 1)
        return sums / count[:, None] + self.bias

    def probabilities(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self._softmax(self._logits(buf, offsets) / self.temperature)


def fit(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> Model:
    """Train on at most `rows_per_lang` texts of each language outside the held-out fold, picked by hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("text is not null and lang is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    place = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang").distinct().withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= rows_per_lang).drop("_n")
    got = sorted({(r.lang, r.text) for r in rows.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text").collect()})  # rows_per_lang of each
    order = np.random.default_rng(0).permutation(len(got))
    langs = sorted({lang for lang, _ in got})
    texts = [got[i][1] for i in order]
    labels = [langs.index(got[i][0]) for i in order]
    return Model(langs, texts, np.array(labels, np.int64))


def predict(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each document.

    Learns from text and lang outside the fold crc32(doc_id as text) mod 5 = 0; a prediction depends on the
    text alone. lang_pred is `und` (score 0, rejected) for null texts and texts without letters, or if no
    language could be learned; `rejected` marks scores too low to trust. Repeated rows get equal results; a
    null doc_id is kept and not held out; an empty table gives no rows; columns other than lang are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, rows_per_lang))

    def run(batches):
        model = sent.value
        for batch in batches:
            for row, buf, offsets in vec.text_chunks(batch.column(1)):
                n = len(offsets) - 1
                low = fold(buf)
                some = np.zeros(n, bool)
                if model.langs:
                    p = model.probabilities(low, offsets)
                    best, score = p.argmax(1), p.max(1)
                    seen = np.concatenate([[0], np.cumsum(_LETTERS[low])])
                    some = seen[offsets[1:]] > seen[offsets[:-1]]
                for i in np.flatnonzero(some).tolist():  # bytes beyond ASCII may be no letters
                    if not some[i] or (low[offsets[i] : offsets[i + 1]] < 128).all():
                        continue
                    text = buf[offsets[i] : offsets[i + 1]].tobytes()
                    if not any(97 <= c <= 122 for c in text.lower()[:4096]):
                        some[i] = any(c.isalpha() for c in text.decode("utf-8", "replace"))
                lang = [model.langs[best[i]] if some[i] else "und" for i in range(n)]
                value = np.where(some, score, 0.0) if model.langs else np.zeros(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(lang, pa.string()), pa.array(value.astype(float)), pa.array(~some | (value < model.reject))], ["doc_id", "lang_pred", "score", "rejected"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
