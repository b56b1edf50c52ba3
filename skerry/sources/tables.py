"""Readers of the Parquet tables in a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, lazily; the caller's filters and columns reach the scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
