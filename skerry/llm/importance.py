"""Quality selection by importance resampling.

Two generative models of hashed n-grams, one of target texts (labelled as of good quality) and one of all raw
texts, give each text a log importance weight: the sum of the log-ratios of its n-grams. A Gumbel variable
added to it turns taking the k largest into sampling without replacement in proportion to the weights. The
noise comes from a hash of doc_id and text, so a lost task gives the same draw again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .rest import packed

BUCKETS = 1 << 14
#: Bound of the labelled rows that are looked at.
LABELLED_ROWS = 20_000
#: Occurrences in target texts that each bucket is given in advance, at the raw rate.
SMOOTH = 40.0
#: A target text lost weighs as much as so many poor ones kept, where k is chosen from the labels.
LOSS = 4.0

_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_SAME = np.uint64(0x5851F42D4C957F2D)


def ngrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, where each text's begin) of tokens and of pairs of tokens.

    Tokens are runs of letters and digits, case kept, and runs of other signs. A pair of equal tokens is one
    and the same n-gram whatever the token, as repetition says more of quality than what is repeated.
    """
    n = len(buf)
    n_text = len(offsets) - 1
    if not n:
        return np.empty(0, np.int64), np.zeros(n_text + 1, np.int64)
    kind = _KIND[buf]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    token = kind[cut[:-1]] > 0
    starts, ends = cut[:-1][token], cut[1:][token]
    h = vec.ranged(vec.prefix(vec.BYTE[buf]), starts, ends)
    first = np.searchsorted(starts, offsets)
    pair = np.where(h[1:] == h[:-1], _SAME, vec.mix(h[:-1] * np.uint64(3) + h[1:]))
    both = np.empty(2 * len(h), np.uint64)
    both[0::2] = h
    both[1::2][:-1] = pair
    last = first[1:][first[1:] > first[:-1]] - 1
    both[1::2][last] = h[last]  # a text's last token pairs with nothing and counts twice
    return (both >> np.uint64(64 - 14)).astype(np.int64), 2 * first


def _labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    marked = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("label"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.join(F.broadcast(sample), "doc_id", "left")  # of `rows` rows at most


def _counts(marked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of all texts, and of target texts."""

    def run(batches):
        total = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            target = np.array([x == 1 for x in batch.column(1).to_pylist()], bool)
            for row, buf, offsets in vec.text_chunks(batch.column(0)):
                at, first = ngrams(buf, offsets)
                total[:BUCKETS] += np.bincount(at, minlength=BUCKETS)
                mine = np.repeat(target[row : row + len(offsets) - 1], np.diff(first))
                total[BUCKETS:] += np.bincount(at[mine], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["i", "n"])

    out = np.zeros(2 * BUCKETS)
    for r in marked.select("text", "label").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # 2 * BUCKETS rows at most
        out[r.i] = r.n
    return out[:BUCKETS], out[BUCKETS:]


def weigh(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, seed: int = 0) -> DataFrame:
    """doc_id, text, rest (the other columns), label (null where unknown), n_grams, log_weight and the perturbed `draw` of each document."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", packed(docs))
    marked = _labelled(base, labels, labelled_rows)
    raw, target = _counts(marked)
    if target.sum():
        ratio = np.log((target + SMOOTH) / (raw * (target.sum() / raw.sum()) + SMOOTH))
    else:
        ratio = np.zeros(BUCKETS)
    # whole numbers, whose sums are the same wherever a text stands in its batch
    sent = docs.sparkSession.sparkContext.broadcast(np.rint(ratio * 2.0**32).astype(np.int64))

    def run(batches):
        ratio = sent.value
        for batch in batches:
            noise = batch.column(2).to_numpy()
            for row, buf, offsets in vec.text_chunks(batch.column(1)):
                n = len(offsets) - 1
                at, first = ngrams(buf, offsets)
                sums = np.concatenate([[0], np.cumsum(ratio[at])])
                weight = (sums[first[1:]] - sums[first[:-1]]) / 2.0**32
                u = (vec.mix(noise[row : row + n].view(np.uint64) + np.uint64(seed)) >> np.uint64(11)).astype(float)
                gumbel = -np.log(-np.log((u + 0.5) / 2.0**53))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, n) for c in (0, 1, 4, 3)), pa.array(np.diff(first)), pa.array(weight), pa.array(weight + gumbel)], ["doc_id", "text", "rest", "label", "n_grams", "log_weight", "draw"])

    noisy = marked.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("noise"), F.col("label").cast("int").alias("label"), "rest")
    schema = noisy.select("doc_id", "text", "rest", "label").schema.add("n_grams", "long").add("log_weight", "double").add("draw", "double")
    return noisy.mapInArrow(run, schema)


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column: bisection by counting, 256 cuts a pass, nothing gathered."""
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    if k >= n:
        return low
    while low < high:
        cuts = np.unique(np.concatenate([np.linspace(low, high, 257)[1:], [high]]))
        if len(cuts) < 2:
            break
        counts = values.agg(*[F.count_if(F.col(column) >= float(c)).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
        enough = [i for i in range(len(cuts)) if counts[i] >= k]
        new_low = float(cuts[enough[-1]]) if enough else low
        new_high = values.where((F.col(column) >= new_low) & ((F.col(column) < float(cuts[enough[-1] + 1])) if enough and enough[-1] + 1 < len(cuts) else (F.col(column) < float(cuts[0])) if not enough else F.lit(True))).agg(F.min(column), F.max(column)).first()
        low, high = new_high[0], new_high[1]
        if values.where((F.col(column) > low)).count() < k:
            break
    return low


def best_cut(rows: list[tuple[float, int]], loss: float) -> float | None:
    """The draw from which on texts are kept: least cost on the labelled ones, in the middle of its gap."""
    if not any(y == 1 for _, y in rows):
        return None
    rows = sorted(rows)
    draw = np.array([d for d, _ in rows])
    good = np.array([y == 1 for _, y in rows])
    cost = np.concatenate([[0], np.cumsum(good * loss)]) + np.concatenate([np.cumsum(~good[::-1])[::-1], [0]])
    edges = np.concatenate([[-np.inf], draw, [np.inf]])
    gap = np.diff(edges)
    free = np.concatenate([[True], draw[1:] > draw[:-1], [True]])
    best = np.flatnonzero(free & (cost == cost[free].min()))
    i = int(best[np.argmax(np.where(np.isfinite(gap[best]), gap[best], 0))])
    low, high = edges[i], edges[i + 1]
    return float(high - 1e3 if low == -np.inf else (low + high) / 2)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, labelled_rows: int = LABELLED_ROWS, loss: float = LOSS, seed: int = 0) -> DataFrame:
    """doc_id, text, rest (the other columns), n_grams, log_weight, draw and selected: the k documents of the largest draws.

    Without k it is the number of documents whose draw reaches the cut that best parts the labelled rows'
    draws (a lost target text weighing `loss`), so the sample is as large as the raw texts hold target-like
    ones. Ties at the k-th draw are
    all taken. Null and empty texts have no n-grams and weight 0; repeated rows draw alike; without target
    labels all weights are 0 (all are selected unless k is given); an empty table gives no rows; other columns are not read.
    """
    weighed = weigh(docs, labels, labelled_rows, seed)
    if k is None:
        rows = weighed.where("label in (0, 1)").select("draw", "label").toLocalIterator()  # about labelled_rows
        least = best_cut([(r.draw, r.label) for r in rows], loss)
    else:
        least = kth_largest(weighed, "draw", k) if k else float("inf")
    chosen = F.lit(True) if least is None else F.col("draw") >= F.lit(float(least))
    return weighed.select("doc_id", "text", "rest", "n_grams", "log_weight", "draw", chosen.alias("selected"))
