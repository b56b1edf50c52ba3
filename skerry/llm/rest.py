"""Columns that an operator doesn't use but hands on, packed so that their names can't clash with its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(docs: DataFrame):
    """All columns but the text as one struct column `rest`."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")


def unpacked(df: DataFrame, text: str, columns: list[str], changed: bool = False) -> DataFrame:
    """The table's columns again, with the named text; if texts are `changed`, n_chars follows where there is such a column."""
    out = df.select("rest.*", F.col(text).alias("text"))
    if changed and "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[f"`{c}`" for c in columns])
