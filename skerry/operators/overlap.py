"""How much of a reference text a candidate has: clipped n-grams (BLEU, ROUGE-N) and common subsequences (ROUGE-L)."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Words of a text in small letters, none of a null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def clipped(pairs: DataFrame, keys: list[str], candidate: str, reference: str, most: int = 4) -> DataFrame:
    """keys, n, matched, candidate_grams, reference_grams for n = 1 to `most`; a gram matches as often as both texts have it.

    A pair's texts lie in one row, and their grams are counted there, one pair at a time: no gram is shuffled. Rows of equal keys count as one pair.
    """
    sides = F.struct(words(F.col(candidate)).alias("x"), words(F.col(reference)).alias("y"))
    rows = pairs.select(*keys, sides.alias("_s")).groupBy(*keys).agg(F.collect_list("_s").alias("_s"))
    names = ["n", "matched", "candidate_grams", "reference_grams"]

    def runs(texts: list[list[str]], n: int) -> Counter:
        return Counter(" ".join(t[i : i + n]) for t in texts for i in range(len(t) - n + 1))

    def count(batches):
        for batch in batches:
            at, out = [], []
            for row, sides in enumerate(batch.column(len(keys))):
                x, y = ([s[c] for s in sides.as_py()] for c in "xy")
                for n in range(1, most + 1):
                    a, b = runs(x, n), runs(y, n)
                    if a or b:
                        at.append(row)
                        out.append((n, (a & b).total(), a.total(), b.total()))
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array([o[i] for o in out], t) for i, t in enumerate(types)]], [*keys, *names])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(count, f"{kinds}, n int, matched long, candidate_grams long, reference_grams long")


def rouge_n(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to the rows of clipped(); 0 where a side has no gram."""
    p = F.when(F.col("candidate_grams") > 0, F.col("matched") / F.col("candidate_grams")).otherwise(0.0)
    r = F.when(F.col("reference_grams") > 0, F.col("matched") / F.col("reference_grams")).otherwise(0.0)
    return counted_f1(counts.withColumns({"precision": p, "recall": r}))


def counted_f1(rows: DataFrame) -> DataFrame:
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def bleu(counts: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """keys, brevity and bleu of the rows of clipped(): geometric mean of the precisions, times the penalty of a shorter candidate; 0 if some n has no match."""
    one = F.col("n") == 1
    log = F.when(F.col("matched") > 0, F.log(F.col("matched") / F.col("candidate_grams")))
    g = counts.groupBy(*keys).agg(F.sum(log).alias("_l"), F.count(log).alias("_k"), F.max(F.when(one, F.col("candidate_grams"))).alias("_c"), F.max(F.when(one, F.col("reference_grams"))).alias("_r"))
    brevity = F.when(F.col("_c") == 0, 0.0).when(F.col("_c") >= F.col("_r"), 1.0).otherwise(F.exp(1 - F.col("_r") / F.col("_c")))
    return g.select(*keys, brevity.alias("brevity"), F.when(F.col("_k") == most, brevity * F.exp(F.col("_l") / most)).otherwise(0.0).alias("bleu"))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two word arrays.

    A fold over the words of `a`: `ends` holds, for each length, the earliest place in `b` at which a common
    subsequence of that length ends. Each place of the word in `b`, from the last to the first, takes the
    first entry that isn't before it. Work is the equal pairs times the length found.
    """
    places = F.sequence(F.size(b), F.lit(1), F.lit(-1))

    def word(ends: Column, w: Column) -> Column:
        at = F.filter(places, lambda j: F.element_at(b, j) == w)
        return F.aggregate(at, ends, lambda e, p: F.concat(F.filter(e, lambda x: x < p), F.array(p), F.slice(F.filter(e, lambda x: x >= p), 2, F.greatest(F.size(b), F.lit(1)))))

    none = F.array().cast("array<int>")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.size(F.aggregate(a, none, word)))


def rouge_l(pairs: DataFrame, keys: list[str], candidate: str, reference: str) -> DataFrame:
    """keys, common, precision, recall and f1 by the longest common subsequence of words."""
    split = pairs.select(*keys, words(F.col(candidate)).alias("_a"), words(F.col(reference)).alias("_b"))
    rows = split.select(*keys, common_subsequence(F.col("_a"), F.col("_b")).cast("long").alias("common"), F.size("_a").alias("_n"), F.size("_b").alias("_m"))
    p = F.when(F.col("_n") > 0, F.col("common") / F.col("_n")).otherwise(0.0)
    r = F.when(F.col("_m") > 0, F.col("common") / F.col("_m")).otherwise(0.0)
    return counted_f1(rows.withColumns({"precision": p, "recall": r})).drop("_n", "_m")
