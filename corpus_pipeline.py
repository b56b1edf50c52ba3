"""Corpus pipeline: quality, near-duplicates, repeated passages, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import decontaminate, importance, pieces, simhash, suffix_array
from skerry.llm.queries import tokenizer_path
from skerry.llm.rest import unpacked
from skerry.session import scratch, ship
from skerry.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; the others go. Null and empty texts count as texts without n-grams; an empty table stays empty."""
    ship(spark)
    found = importance.resample(docs, table(spark, sf_dir, "labels"))
    return unpacked(found.where("selected"), "text", docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, similarity 0.8): that of the least doc_id, those without one coming last.

    Rows are told apart by doc_id and text: of one doc_id, or none, each text that is like no other stays; rows
    that agree in both are one. All texts without words, null ones too, are one class, so one of them stays. An empty table stays empty.
    """
    ship(spark)
    return unpacked(simhash.first_of_similar(docs), "text", docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words, or 400 bytes, that stand elsewhere, too; all documents stay."""
    ship(spark)
    return unpacked(suffix_array.remove_repeats(docs, keep_text=True, over=50), "kept", docs.columns, changed=True)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; the others go. Null and empty texts stay; so do all rows if there is no item."""
    ship(spark)
    found = decontaminate.find_windows(docs, table(spark, sf_dir, "benchmark"), keep=True)
    return unpacked(found.where(F.size("hits") == 0), "text", docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids, the ids, their digest and that of the decoded text. A null text is an empty one, with no ids; rows that repeat stay."""
    ship(spark)
    return pieces.encode_texts(docs, tokenizer_path(), keep_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("contamination", contamination), ("encoding", encoding)]
#: SQL has neither the models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
