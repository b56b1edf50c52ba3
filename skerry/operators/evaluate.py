"""Evaluation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import quantiles


def recall(found: Column, gold: Column) -> Column:
    """Share of the gold set that was found; 1 where there is no gold."""
    return F.when(F.size(gold) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(found, gold)) / F.size(F.array_distinct(gold)))


def hit(found: Column, gold: Column) -> Column:
    """Whether any of the gold set was found; true where there is none."""
    return (F.size(gold) == 0) | F.arrays_overlap(found, gold)


def contains_all(answer: Column, needles: Column) -> Column:
    """Whether the answer holds every needle, case ignored."""
    return F.forall(needles, lambda n: F.lower(answer).contains(F.lower(n)))


def p95_nearest_rank(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, p95: the value at rank min(n - 1, floor(0.95 n)) from 0; a group of any size is never sorted."""
    return quantiles.exact(df, by, value, [0.95]).select(*by, F.col("value").alias("p95"))


def weighted_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """kappa and n: Cohen's kappa with squared weights over two integer ratings."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy("i").agg(F.sum("o").alias("r")), cells.groupBy("j").agg(F.sum("o").alias("c"))
    n = cells.agg(F.sum("o").alias("n"))
    apart = F.pow(F.col("i") - F.col("j"), F.lit(2))
    seen = cells.agg(F.sum(apart * F.col("o")).alias("seen"))
    chance = rows.crossJoin(cols).agg(F.sum(apart * F.col("r") * F.col("c")).alias("chance"))  # as many rows as ratings
    return seen.crossJoin(chance).crossJoin(n).select(F.when(F.col("chance") == 0, F.lit(1.0)).otherwise(1 - F.col("seen") * F.col("n") / F.col("chance")).alias("kappa"), "n")


#: Ranges of values whose distinct ones a task of spearman() puts in order.
RANGES = 256


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho: correlation of average ranks.

    Ranks come from counts of distinct values. These are dealt to ranges between sketched quantiles; a range's first rank is the
    sum of those below, and within it a running sum adds to that, so no task has all values, and no row is ever numbered.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(c: str, name: str) -> DataFrame:
        counts = cut(rows.groupBy(F.col(c).alias(f"_{name}")).agg(F.count("*").alias("_k")))
        bounds = counts.select(F.col(f"_{name}").cast("double").alias("v")).approxQuantile("v", [i / RANGES for i in range(1, RANGES)], 0.002)
        edges = F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
        dealt = counts.withColumn("_b", F.size(F.filter(edges, lambda e: e <= F.col(f"_{name}").cast("double"))))
        sums = dealt.groupBy("_b").agg(F.sum("_k").alias("_s"))
        below = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_below"))  # as many rows as ranges
        upto = F.sum("_k").over(Window.partitionBy("_b").orderBy(f"_{name}"))
        placed = dealt.withColumn("_u", upto).join(F.broadcast(below), "_b")
        return placed.select(f"_{name}", (F.col("_below") + F.col("_u") - F.col("_k") + (F.col("_k") + 1) / 2).alias(name))

    return rows.join(ranks(x, "_rx"), rows[x] == F.col("__rx")).join(ranks(y, "_ry"), rows[y] == F.col("__ry")).agg(F.corr("_rx", "_ry").alias("rho"))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """n rows of each stratum, the same ones every time, by digest of the key."""
    order = Window.partitionBy(stratum).orderBy(F.sha2(F.col(key).cast("string"), 256), key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def regression_gate(baseline: DataFrame, candidate: DataFrame, by: str, score: str, delta: float, strict: list[str]) -> DataFrame:
    """by, change and passed: no criterion may drop by more than delta, those of `strict` not at all."""
    b, c = baseline.select(by, F.col(score).alias("_b")), candidate.select(by, F.col(score).alias("_c"))
    change = F.col("_c") - F.col("_b")
    return b.join(c, by).select(by, change.alias("change"), (change >= F.when(F.col(by).isin(*strict), 0.0).otherwise(-delta)).alias("passed"))


def run_benchmark(questions: DataFrame, gold: DataFrame, modes: dict[str, DataFrame], k: int = 5, categories: list | None = None, first: int | None = None) -> DataFrame:
    """question_id, category, mode, found, wanted, recall and hit of each question under each mode, the same questions for all.

    questions (question_id, category), gold (question_id, item) or (category, item), and for each mode ranked items (question_id, item, rank).
    `categories` keeps those only, `first` the first so many questions by id; then the first k items of a question
    count. Gold of a category is that of all its questions but for the item of a question's own id. A question without gold has recall 1 and a hit; one of which a mode found nothing stays, with none found.
    """
    if k < 1 or (first is not None and first < 1) or (categories is not None and not categories):
        raise ValueError("k and first must be at least 1, and categories not empty")
    asked = questions.select("question_id", "category")
    if categories is not None:
        asked = asked.where(F.col("category").isin(*categories))
    if first is not None:
        asked = asked.orderBy("question_id").limit(first)
    by = "question_id" if "question_id" in gold.columns else "category"
    right = gold.select(by, "item").distinct()
    wanted = right.groupBy(by).agg(F.count("*").alias("wanted"))
    if by == "category":  # pairs of questions and gold would be as many as their product
        own = asked.join(right.withColumnRenamed("item", "question_id"), ["category", "question_id"], "left_semi").select("question_id", F.lit(1).alias("_own"))
        wanted = asked.join(wanted, "category").join(own, "question_id", "left").select("question_id", (F.col("wanted") - F.coalesce("_own", F.lit(0))).alias("wanted")).where("wanted > 0")
    ranked = None
    for mode, items in modes.items():
        some = items.where(F.col("rank") <= k).select("question_id", "item", F.lit(mode).alias("mode"))
        ranked = some if ranked is None else ranked.unionByName(some)
    ranked = ranked.distinct()
    if by == "category":
        ranked = ranked.where("item <> question_id").join(asked, "question_id")
    found = ranked.join(right, [by, "item"], "left_semi").groupBy("question_id", "mode").agg(F.count("*").alias("found"))
    each = asked.withColumn("mode", F.explode(F.array(*map(F.lit, modes)))).join(found, ["question_id", "mode"], "left").join(wanted, "question_id", "left")
    none = F.col("wanted").isNull()
    each = each.withColumns({"found": F.coalesce("found", F.lit(0)), "recall": F.when(none, 1.0).otherwise(F.coalesce("found", F.lit(0)) / F.col("wanted")), "hit": none | (F.coalesce("found", F.lit(0)) > 0)})
    return each.withColumn("wanted", F.coalesce("wanted", F.lit(0)))


def summary(outcomes: DataFrame) -> DataFrame:
    """mode, category (null: all), n, recall and hit_rate of run_benchmark()'s rows."""
    return outcomes.groupingSets([["mode", "category"], ["mode"]], "mode", "category").agg(F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement and kappa (Cohen's, without weights) of two ratings; 1 where chance alone would always agree."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy("i").agg(F.sum("o").alias("r")), cells.groupBy(F.col("j").alias("i")).agg(F.sum("o").alias("c"))
    seen = cells.agg(F.sum("o").alias("n"), F.sum(F.when(F.col("i") == F.col("j"), F.col("o")).otherwise(0)).alias("same"))
    chance = rows.join(cols, "i").agg(F.coalesce(F.sum(F.col("r") * F.col("c")), F.lit(0)).alias("chance"))
    by = F.col("chance") / (F.col("n") * F.col("n"))
    return seen.crossJoin(chance).select("n", (F.col("same") / F.col("n")).alias("agreement"), F.when(by == 1, 1.0).otherwise((F.col("same") / F.col("n") - by) / (1 - by)).alias("kappa"))  # one row each
