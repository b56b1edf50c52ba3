"""Routing, entity linking, fact ranking and rank fusion, over many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .store import top_n_per

#: What marks a question about relations, and one about passages.
GRAPH_MARKERS = (
    r"\bconnect(ed|ion|ions)?\b",
    r"\brelated\b",
    r"\brelationship\b",
    r"\bbetween\b",
    r"\bboth\b",
    r"\bpartner(s|ship)?\b",
    r"\bcompetitor(s)?\b",
    r"\bcompete(s)?\b",
    r"\binvest(s|ed|or|ors|ment)?\b",
    r"\bacquire(d|s)?\b",
    r"\bacquisition\b",
    r"\bsuppl(y|ies|ier|iers)\b",
    r"\bwho else\b",
    r"\bhow many\b",
    r"\bcount\b",
    r"\blist all\b",
    r"\bwhich compan(y|ies)\b",
    r"\bboard\b",
    r"\bsupply chain\b",
    r"\bvia\b",
    r"\bthrough\b",
)
VECTOR_MARKERS = (
    r"^what is\b",
    r"^what are\b",
    r"^define\b",
    r"\bdefinition\b",
    r"\bdescribe\b",
    r"\bexplain\b",
    r"\bknown for\b",
    r"\bmission\b",
    r"\bhistory\b",
    r"\bfocus(ed|es)? on\b",
)
RRF_K = 60


def hits(question: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns a question holds."""
    low = F.lower(F.trim(question))
    out = F.lit(0)
    for p in patterns:
        out = out + low.rlike(p).cast("int")
    return out


def route(questions: DataFrame, accept: float = 0.6) -> DataFrame:
    """Adds route, confidence and fallback to (question, entities). Below `accept` the route is hybrid; counts go to the graph."""
    g, v, n = hits(F.col("question"), GRAPH_MARKERS), hits(F.col("question"), VECTOR_MARKERS), F.col("entities")
    rule = (
        F.when(n >= 2, F.struct(F.lit("graph").alias("r"), F.when(g > 0, 0.85).otherwise(0.70).alias("c")))
        .when((g > 0) & (v > 0), F.struct(F.lit("hybrid").alias("r"), F.lit(0.70).alias("c")))
        .when(g >= 2, F.struct(F.lit("graph").alias("r"), F.lit(0.85).alias("c")))
        .when(g == 1, F.struct(F.lit("graph").alias("r"), F.when(n > 0, 0.65).otherwise(0.50).alias("c")))
        .when(v >= 1, F.struct(F.lit("vector").alias("r"), F.lit(0.75).alias("c")))
        .otherwise(F.struct(F.lit("vector").alias("r"), F.lit(0.40).alias("c")))
    )
    ruled = questions.withColumn("_rule", rule)
    low = F.col("_rule.c") < accept
    return ruled.withColumn("route", F.when(low, "hybrid").otherwise(F.col("_rule.r"))).withColumn("confidence", F.col("_rule.c")).withColumn("fallback", low).drop("_rule")


def link_entities(questions: DataFrame, forms: DataFrame, limit: int = 4) -> DataFrame:
    """question_id, position, entity_id, form: entities of a question by their forms (entity_id, form).

    Questions are cut into word n-grams that are joined with the forms; longer forms come first (ties by form,
    then id); one that is part of an accepted longer form, or of an entity seen already, is passed over.
    """
    known = forms.select("entity_id", T.normalize_name(F.col("form")).alias("form")).where("form <> ''").distinct().withColumn("_n", F.size(F.split("form", " ")))
    longest = known.agg(F.max("_n")).first()[0] or 0
    words = questions.select("question_id", F.split(T.normalize_name(F.col("question")), " ").alias("w"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(max(1, longest)), F.size("w"))), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    met = words.select("question_id", F.explode(F.array_distinct(grams)).alias("form")).join(known, "form")
    ordered = met.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("form")).alias("l"), "form", "entity_id"))).alias("c"))
    seed = F.array().cast("array<struct<l:int,form:string,entity_id:string>>")

    def step(acc: Column, c: Column) -> Column:
        inside = F.exists(acc, lambda a: a["form"].contains(c["form"]))
        seen = F.exists(acc, lambda a: a["entity_id"] == c["entity_id"])
        return F.when((F.size(acc) >= limit) | inside | seen, acc).otherwise(F.concat(acc, F.array(c)))

    return ordered.select("question_id", F.posexplode(F.aggregate("c", seed, step)).alias("position", "e")).select("question_id", "position", "e.entity_id", "e.form")


def rank_facts(facts: DataFrame, limit: int = 10) -> DataFrame:
    """Adds score and rank to (question_id, statement, hops, confidence, covered): covered entities, confidence, few hops.

    Where there is a column `between`, facts that it marks have a base of 0.95 whatever their confidence.
    """
    between = F.coalesce("between", F.lit(False)) if "between" in facts.columns else F.lit(False)
    base = F.when(between, F.lit(0.95)).when(F.col("hops") == 1, F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.7))
    scored = facts.withColumn("score", F.col("covered") * 10 + base - F.col("hops") * 0.1)
    best = top_n_per(scored.withColumn("_key", F.lower("statement")), ["question_id", "_key"], [F.desc("score"), "hops", "statement"], 1).drop("_key")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "hops", "statement")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def rrf(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """question_id, item, score: reciprocal rank fusion of (question_id, list, item, rank)."""
    return ranked.groupBy("question_id", "item").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))
