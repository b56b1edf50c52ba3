"""Toxicity by noisy-channel deobfuscation.

A text is read as what a writer meant, sent through a channel that swaps letters for look-alike signs, puts
gaps between letters and repeats them. Each obfuscated stretch is a lattice of characters; the Viterbi path
under a character language model restores it. Stretches of plain letters have a single path, which is
themselves, so only the others are decoded. What scores is the restored text: words and word beginnings whose
presence marks toxic texts among the labelled ones, how many of them there are, and what its other words say. A logistic model, fitted on labelled rows that the rest was not learned from, turns these into
a probability. The language model mixes trigrams counted over all documents with the letters of those marker
words.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

#: Signs that stand for letters.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Log-costs of the channel: a swapped sign, a gap inside a word, a repeated letter; a gap or sign kept as it is.
SWAP, GAP, REPEAT, KEEP = -1.0, -0.4, -0.3, -3.0
#: Rows that the lexicon is fitted on, at most: toxic and clean.
TOXIC_ROWS, CLEAN_ROWS = 2000, 4000
PREFIXES = (4, 5, 6)
#: Least different neighbours and texts of a marker; its least precision, and that of the lower bound.
SUPPORT, TEXTS, PRECISION, BOUND = 8, 5, 0.95, 0.5
THRESHOLD = 0.3
#: Part of the labelled rows that the probabilities are fitted on; buckets of word hashes.
APART, BUCKETS = 4, 1 << 16

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(97, 123), *range(128, 256)]] = True
ALPHABET = 64


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the letters of Latin-1, on UTF-8 bytes."""
    low = vec.lower_ascii(buf)
    if len(low) > 1:
        up = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][up] += 32
    return low


def code(c: str) -> int:
    """Symbol of a lower-case character: 0 for what is no letter."""
    o = ord(c)
    if 97 <= o <= 122:
        return o - 96
    if 0xDF <= o <= 0xFF and o != 0xF7:
        return 27 + o - 0xDF
    return 63 if c.isalpha() else 0


_CODES = np.array([code(chr(i).lower()[:1]) for i in range(0x250)], np.int64)


def _symbols(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(raw < 0x250, _CODES[np.minimum(raw, 0x24F)], np.where(raw < 0x2000, 63, 0))


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, hashes of words' beginnings by length, first word of each text) on folded bytes."""
    starts, ends, first = vec.word_places(buf, offsets, _LETTERS)
    pre = vec.prefix(vec.BYTE[buf])
    whole = vec.ranged(pre, starts, ends)
    begin = [np.where(ends - starts > k, vec.mix(vec.ranged(pre, starts, np.minimum(starts + k, ends)) + np.uint64(k)), whole) for k in PREFIXES]
    return whole, np.array(begin).reshape(len(PREFIXES), -1), first


def _bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return fold(np.frombuffer(b"".join(raws), np.uint8)), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)


class Lexicon:
    """Markers of toxic texts: feature hashes, their scores, and the words that have them."""

    def __init__(self, toxic: list[str], clean: list[str]):
        """A feature's support is the number of different words that it follows, so copies count once."""

        def pairs(texts):
            for at in range(0, len(texts), 200):
                buf, offsets = _bytes(texts[at : at + 200])
                whole, begin, first = features(buf, offsets)
                before = np.concatenate([np.zeros(1, np.uint64), whole[:-1]])[: len(whole)]
                yield whole, begin, before, buf, offsets, first

        def support(texts, wanted=None, by_text=False):
            found = []
            for kind in range(1 + len(PREFIXES)):  # one kind of feature at a time, for the driver's memory
                of, pair = [], []
                for k, (whole, begin, before, _, offsets, first) in enumerate(pairs(texts)):
                    if by_text:
                        before = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64) + np.uint64(k << 32), np.diff(first))
                    h = begin[kind - 1] if kind else whole
                    keep = np.isin(h, wanted) if wanted is not None else slice(None)
                    of.append(h[keep])
                    pair.append(vec.mix(h[keep] ^ vec.mix(before[keep])))
                if of:
                    of, pair = np.concatenate(of), np.concatenate(pair)
                    _, one = np.unique(pair, return_index=True)
                    found.append(np.unique(of[one], return_counts=True))
            if not found:
                return np.empty(0, np.uint64), np.empty(0, np.int64)
            f, n = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((-n, f))
            f, n = f[order], n[order]
            new = np.concatenate([[True], f[1:] != f[:-1]])[: len(f)]
            return f[new], n[new]

        f, t = support(toxic)
        f, t = f[t >= SUPPORT], t[t >= SUPPORT]
        g, c = support(toxic, f, by_text=True)
        f, t = f[c >= TEXTS], t[c >= TEXTS]
        g, c = support(clean, f)
        clean_n = np.zeros(len(f))
        clean_n[np.searchsorted(f, g)] = c
        # both classes as if sampled alike, then Wilson's lower bound
        odds = max(1, len(clean)) / max(1, len(toxic)) / 9.0
        n = t + clean_n / max(odds, 1e-9)
        p, z = t / np.maximum(n, 1), 3.0
        low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) if len(n) else n
        keep = (low >= BOUND) & (p >= PRECISION)
        self.keys, self.scores = f[keep], np.minimum(0.99, 0.5 + 0.5 * p[keep])
        words: dict[str, int] = {}
        for whole, begin, _, buf, offsets, _ in pairs(toxic):
            hit = self.value(whole, begin) > 0
            starts, ends, _ = vec.word_places(buf, offsets, _LETTERS)
            raw = buf.tobytes()
            for s, e in zip(starts[hit].tolist(), ends[hit].tolist()):
                w = raw[s:e].decode("utf-8", "replace")
                words[w] = words.get(w, 0) + 1
        self.words = sorted(words, key=lambda w: (-words[w], w))[:5000]

    def value(self, whole: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Score of each word, 0 where it is no marker."""
        out = np.zeros(len(whole))
        if len(self.keys):
            for h in (whole, *begin):
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                out = np.maximum(out, np.where(self.keys[at] == h, self.scores[at], 0))
        return out


class Channel:
    """Character language model and Viterbi decoder."""

    def __init__(self, counts: np.ndarray, words: list[str]):
        grams = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(float)
        pair = grams.sum(2, keepdims=True)
        single = grams.sum((0, 1)) + 1
        back = (grams.sum(0) + 5 * single / single.sum()) / (grams.sum((0, 2))[:, None] + 5)
        self.log = np.log((grams + 5 * back[None]) / (pair + 5)).astype(np.float32)
        self.known: dict[tuple[str, str], float] = {}
        following: dict[str, dict[str, int]] = {}
        for w in words:
            line = " " + w + " "
            for i in range(1, len(line)):
                c = line[max(0, i - 5) : i]
                at = following.setdefault(c, {})
                at[line[i]] = at.get(line[i], 0) + 1
        for c, at in following.items():
            n = sum(at.values())
            for x, k in at.items():
                self.known[c, x] = k / n
        self.cache: dict[str, str] = {}

    def step(self, path: str, c: str) -> float:
        """Log-probability of c after a path."""
        a, b = (code(x) for x in (path[-2:] if len(path) > 1 else " " + path[-1:]))
        p = self.log[a, b, code(c)]
        q = self.known.get((path[-5:], c))
        return float(p) if q is None else max(float(p), math.log(0.5 * math.exp(p) + 0.5 * q))

    def restore(self, stretch: str) -> str:
        """The best reading of an obfuscated stretch (lower case); the same letters again if there's none better."""
        known = self.cache.get(stretch)
        if known is not None:
            return known
        best = {"      ": 0.0}  # last six characters of a path -> score
        paths: dict[str, tuple | None] = {"      ": None}  # -> (what came before, character)
        for x in stretch:
            options = [(x, 0.0)] if x.isalpha() else [(y, SWAP) for y in LEET.get(x, "")] + [(" ", KEEP)] + ([("", GAP)] if x not in LEET or not LEET[x] else [])
            new: dict[str, float] = {}
            came: dict[str, tuple | None] = {}
            for state, score in best.items():
                for y, cost in options:
                    if not y:
                        after, s = state, score + cost
                    elif y == " " and state[-1] == " ":
                        after, s = state, score + cost
                    else:
                        after, s = (state + y)[-6:], score + cost + self.step(state, y)
                    if s > new.get(after, -1e18):
                        new[after], came[after] = s, paths[state] if after is state else (paths[state], after[-1])
                    if y and y != " " and state[-1] == y and score + REPEAT + cost > new.get(state, -1e18):
                        new[state], came[state] = score + REPEAT + cost, paths[state]
            top = sorted(new, key=lambda k: -new[k])[:24]
            best, paths = {k: new[k] for k in top}, {k: came[k] for k in top}
        end = max(best, key=lambda k: (best[k] + self.step(k, " "), k))
        node, letters = paths[end], []
        while node:
            node, c = node
            letters.append(c)
        out = "".join(reversed(letters))
        if len(stretch) <= 64:  # entries and their size are bounded
            if len(self.cache) > 100_000:
                self.cache.clear()
            self.cache[stretch] = out
        return out


_SIGN = re.escape("".join(LEET))
#: Letters next to signs; single characters with gaps between them; a letter three times or more.
STRETCH = re.compile(rf"(?<![^\W_])(?:[^\W_{_SIGN}]|[{_SIGN}])(?:[ .\-_*~/]{{1,2}}(?:[^\W_]|[{_SIGN}])(?![^\W_])){{2,}}|(?:[^\W\d_][{_SIGN}]|[{_SIGN}][^\W\d_])(?:[^\W_]|[{_SIGN}])*|[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*")
_WORDISH = re.compile(rf"(?:[^\W_]|[{_SIGN}])+\Z")


def stretches(text: str) -> list[str]:
    """Obfuscated stretches of a lower-case text, with the letters in front of them."""
    out = []
    for m in STRETCH.finditer(text):
        s = m.start()
        front = _WORDISH.search(text, max(0, s - 40), s)
        piece = text[front.start() if front else s : m.end()]
        piece = piece.rstrip("!|+($€£@") if len(piece) < 3 or piece[-1] == piece[-2:-1] else piece
        if sum(c.isalpha() or c in LEET for c in piece) >= 3 and any(c.isalpha() for c in piece):
            out.append(piece)
    return out


def _suspect(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that may hold a stretch: a cheap test on their bytes."""
    n = len(buf)
    out = np.zeros(len(offsets) - 1, bool)
    if n < 3:
        return out
    letter = _LETTERS[buf]
    sign = _SIGNS[buf]
    triple = letter[:-2] & (buf[:-2] == buf[1:-1]) & (buf[1:-1] == buf[2:])
    beside = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    alone = letter | sign
    lone = alone[1:-1] & ~alone[:-2] & ~alone[2:]
    for hit in (np.flatnonzero(triple), np.flatnonzero(beside)):
        out[np.searchsorted(offsets, hit, side="right") - 1] = True
    at = np.flatnonzero(lone) + 1
    near = at[:-1][np.diff(at) <= 3]
    out[np.searchsorted(offsets, near, side="right") - 1] = True
    return out


_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in LEET if ord(c) < 128]] = True


def _counts(docs: DataFrame) -> np.ndarray:
    """Trigrams of all texts."""

    def run(batches):
        total = np.zeros(ALPHABET**3, np.int64)
        for batch in batches:
            for part in vec.slices(batch, 0, 256, 1 << 20):
                s = _symbols(" " + " ".join((t or "").lower() for t in part.column(0).to_pylist()) + "  ")
                total += np.bincount((s[:-2] * ALPHABET + s[1:-1]) * ALPHABET + s[2:], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["i", "n"])

    out = np.zeros(ALPHABET**3, np.int64)
    for r in docs.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toLocalIterator():  # ALPHABET**3 rows at most
        out[r.i] = r.n
    return out


class Scorer:
    """What a text says of itself once it is restored, and the probability that follows."""

    def __init__(self, toxic: list[str], clean: list[str], counts: np.ndarray):
        self.lexicon = Lexicon(toxic, clean)
        self.channel = Channel(counts, self.lexicon.words)
        seen = []
        for texts in (toxic, clean):
            n = np.zeros(BUCKETS)
            for at in range(0, len(texts), 200):
                whole, begin, first = features(*_bytes(texts[at : at + 200]))
                of = np.repeat(np.arange(len(first) - 1), np.diff(first)) * BUCKETS
                for h in (whole, *begin[1:]):
                    n += np.bincount(np.unique(of + _bucket(h)) % BUCKETS, minlength=BUCKETS)
            seen.append(n)
        rates = [(n + 1) / (len(t) + 2) for n, t in zip(seen, (toxic, clean))]
        self.odds = np.where(seen[0] + seen[1] >= TEXTS, np.clip(np.log(rates[0] / rates[1]), 0, 4), 0)
        self.weights = np.array([-3.0, 5.0, 0.0, 0.0])

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """For each text: 1, its strongest marker, the logarithm of its markers' number, the mean of its words' three largest log-odds."""
        buf, offsets = _bytes(texts)
        whole, begin, first = features(buf, offsets)
        odds, owners, values = [self._odds(whole, begin)], [np.repeat(np.arange(len(texts)), np.diff(first))], [self.lexicon.value(whole, begin)]
        asked, owner = [], []
        for i in np.flatnonzero(_suspect(buf, offsets)).tolist():
            for s in dict.fromkeys(stretches((texts[i] or "").lower())):
                asked.append(self.channel.restore(s))
                owner.append(i)
        if asked:
            whole, begin, first = features(*_bytes(asked))
            odds.append(self._odds(whole, begin))
            owners.append(np.repeat(np.array(owner), np.diff(first)))
            values.append(0.98 * self.lexicon.value(whole, begin))
        odd, at, value = np.concatenate(odds), np.concatenate(owners), np.concatenate(values)
        out = np.zeros((len(texts), 4))
        out[:, 0] = 1
        np.maximum.at(out[:, 1], at, value)
        out[:, 2] = np.log1p(np.bincount(at[value > 0], minlength=len(texts)))
        order = np.lexsort((-odd, at))
        rank = np.arange(len(order)) - np.searchsorted(at[order], at[order])
        top = order[rank < 3]
        out[:, 3] = np.bincount(at[top], odd[top], len(texts)) / 3
        return out

    def _odds(self, whole: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return np.max([self.odds[_bucket(h)] for h in (whole, *begin[1:])], axis=0) if len(whole) else np.zeros(0)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton steps with a weak prior; no evidence of toxicity may count against it."""
        free = np.ones(4, bool)
        while True:
            w, prior = np.zeros(4), np.diag([1e-6, 0.05, 0.05, 0.05])
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                grad = x.T @ (p - y) + prior @ w
                hess = (x * (p * (1 - p))[:, None]).T @ x + prior + 1e-9 * np.eye(4)
                step = np.zeros(4)
                step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
                w -= np.clip(step, -2, 2)
                if np.abs(step).max() < 1e-6:
                    break
            against = (w < 0) & free & np.array([False, True, True, True])
            if not against.any():
                break
            free &= ~against
        self.weights = w

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(texts) @ self.weights, -30, 30)))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def _scorer(rows: list[tuple[str, int]], counts: np.ndarray) -> Scorer:
    """Probabilities are fitted on every fourth text, with markers of the others; then markers are learned from all."""
    sides = [list(dict.fromkeys(t for t, y in rows if y == want)) for want in (1, 0)]
    out = Scorer(*sides, counts)
    if all(len(side) >= 2 * APART for side in sides):
        part = Scorer(*[[t for i, t in enumerate(side) if i % APART] for side in sides], counts)
        tried = [side[::APART] for side in sides]
        every = tried[0] + tried[1]
        x = np.concatenate([part.evidence(every[i : i + 64]) for i in range(0, len(every), 64)])
        out.calibrate(x, np.repeat([1.0, 0.0], [len(t) for t in tried]))
    elif not sides[0]:
        out.weights = np.array([-4.0, 0.0, 0.0, 0.0])
    return out


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Scorer:
    """Markers and probabilities from a bounded sample of the labelled rows outside the held-out fold; the language model from all texts."""
    fold_ = F.crc32(F.col("doc_id").cast("string")) % 4
    marked = labels.where("toxic in (0, 1) and doc_id is not null").where(fold_ != 2).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("label"))
    picks = [marked.where(F.col("label") == y).orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(n) for y, n in ((1, toxic_rows), (0, clean_rows))]
    picked = F.broadcast(picks[0].unionByName(picks[1]))  # toxic_rows + clean_rows at most: no text is shuffled
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(picked, "doc_id").select("doc_id", "text", "label").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return _scorer([(r.text, r.label) for r in rows], _counts(docs))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= THRESHOLD) of each document.

    Labels teach only outside the fold crc32(doc_id as text) mod 4 = 2; a score is the probability that the
    text alone gives. Null and empty texts get that of a text without evidence; without toxic labels all do.
    A null doc_id is kept and not held out; repeated rows get equal scores; an empty table gives no rows;
    other columns are not read. Time is linear in a text's length, whatever its stretches.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        scorer = sent.value
        for batch in batches:
            for part in vec.slices(batch, 1, 64, 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.score(part.column(1).to_pylist()))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
