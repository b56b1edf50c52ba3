"""Text files as documents and JSON question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_space


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each *.txt file of a folder (not of those below), bad UTF-8 replaced, ids from name and content."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    rows = raw.select(name.alias("filename"), F.col("path").alias("source"), strip_space(F.make_valid_utf8(F.col("content").cast("string"))).alias("content"), "length")
    return rows.select(
        F.sha2("filename", 256).alias("document_id"),
        "filename",
        "source",
        F.initcap(F.replace(F.regexp_replace("filename", r"\.txt$", ""), F.lit("_"), F.lit(" "))).alias("title"),
        "content",
        F.sha2("content", 256).alias("content_hash"),
        F.create_map(F.lit("path"), F.col("source"), F.lit("size"), F.col("length").cast("string")).alias("metadata"),
    ).orderBy("filename")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a benchmark file {"questions": [...]}."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("questions").alias("q")).select("q.*")
