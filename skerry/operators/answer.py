"""Context numbering and validation of cited answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

REFUSAL = "INSUFFICIENT_EVIDENCE"


def number_context(facts: DataFrame, passages: DataFrame, most_facts: int = 8, most_passages: int = 5, chars: int = 700) -> DataFrame:
    """question_id, marker, kind, chunk_ids, text: facts first, then passages, repeated texts once, markers from 1.

    Both inputs are (question_id, position, chunk_ids, text).
    """

    def part(df: DataFrame, kind: int, most: int) -> DataFrame:
        clean = df.select("question_id", F.lit(kind).alias("k"), "position", "chunk_ids", F.substring(T.squeeze(F.col("text")), 1, chars).alias("text"))
        first = clean.withColumn("_n", F.row_number().over(Window.partitionBy("question_id", F.lower("text")).orderBy("position"))).where("_n = 1").drop("_n")
        return first.withColumn("_n", F.row_number().over(Window.partitionBy("question_id").orderBy("position"))).where(F.col("_n") <= most).drop("_n")

    rows = part(facts, 0, most_facts).unionByName(part(passages, 1, most_passages))
    order = Window.partitionBy("question_id").orderBy("k", "position")
    return rows.select("question_id", F.row_number().over(order).alias("marker"), F.when(F.col("k") == 0, "fact").otherwise("passage").alias("kind"), F.array_distinct("chunk_ids").alias("chunk_ids"), "text")


def render(context: DataFrame) -> DataFrame:
    """question_id and the numbered block of its context."""
    line = F.format_string("[%d] (%s) %s", "marker", "kind", "text")
    return context.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("marker", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))


def validate(answers: DataFrame, context: DataFrame) -> DataFrame:
    """question_id, refused, cited, invalid, chunk_ids, uncited and verdict of each (question_id, answer)."""
    have = context.groupBy("question_id").agg(F.sort_array(F.collect_list("marker")).alias("_have"), F.map_from_entries(F.collect_list(F.struct("marker", "chunk_ids"))).alias("_ids"))
    rows = answers.join(have, "question_id", "left")
    none = F.array().cast("array<int>")
    refused = F.coalesce(F.trim("answer"), F.lit("")).isin("") | F.coalesce(F.col("answer").contains(REFUSAL), F.lit(False))
    used = F.array_distinct(F.coalesce(T.markers(F.col("answer")), none))
    rows = rows.select("question_id", refused.alias("refused"), used.alias("_used"), F.coalesce("_have", none).alias("_have"), "_ids", F.coalesce(T.uncited(F.col("answer"), REFUSAL), F.array().cast("array<string>")).alias("uncited"))
    rows = rows.withColumn("cited", F.array_sort(F.array_intersect("_used", "_have"))).withColumn("invalid", F.array_sort(F.array_except("_used", "_have")))
    verdict = F.when(F.col("refused"), "refused").when(F.size("invalid") > 0, "invalid_marker").when(F.size("cited") == 0, "no_citation").when(F.size("uncited") > 0, "uncited_sentence").otherwise("ok")
    ids = F.array_distinct(F.flatten(F.transform("cited", lambda m: F.col("_ids")[m])))
    return rows.select("question_id", "refused", "cited", "invalid", F.coalesce(ids, F.array().cast("array<string>")).alias("chunk_ids"), "uncited", verdict.alias("verdict"))


def problem(verdict: Column) -> Column:
    """Whether an answer needs a repair: claims that nothing backs."""
    return verdict.isin("invalid_marker", "no_citation", "uncited_sentence")


def settle(answers: DataFrame, repaired: DataFrame, context: DataFrame) -> DataFrame:
    """question_id, answer, verdict, refused, repaired and cited after one repair at most.

    `repaired` has second answers (question_id, answer); they are looked at only where the first has a
    problem. One that has a problem, too, or is a refusal or missing, becomes a refusal.
    """
    first = validate(answers, context).select("question_id", "cited", "verdict").join(answers.select("question_id", "answer"), "question_id")
    bad = first.where(problem(F.col("verdict"))).select("question_id")
    again = repaired.join(bad, "question_id", "left_semi").select("question_id", "answer")
    second = validate(again, context).select("question_id", F.col("cited").alias("_c"), F.col("verdict").alias("_v")).join(again.select("question_id", F.col("answer").alias("_a")), "question_id")
    rows = first.join(second, "question_id", "left").withColumn("repaired", problem(F.col("verdict")))
    fixed = F.coalesce(F.col("_v") == "ok", F.lit(False))
    refused = F.when(F.col("repaired"), ~fixed).otherwise(F.col("verdict") == "refused")
    answer = F.when(refused, F.lit(REFUSAL)).when(F.col("repaired"), F.trim("_a")).otherwise(F.trim("answer"))
    cited = F.when(refused, F.array().cast("array<int>")).when(F.col("repaired"), F.col("_c")).otherwise(F.col("cited"))
    return rows.select("question_id", answer.alias("answer"), F.coalesce("_v", "verdict").alias("verdict"), refused.alias("refused"), "repaired", cited.alias("cited"))
