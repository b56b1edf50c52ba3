"""Evaluation results as files: JSON lines, and Markdown tables of summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines; nulls are kept as nulls."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def cell(c: Column, kind: str, digits: int = 2) -> Column:
    """A value as a cell: numbers with a fraction rounded, null as a dash, bars escaped."""
    text = F.format_number(c, digits).cast("string") if kind in ("double", "float") else c.cast("string")
    return F.coalesce(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("-"))


def markdown(summary: DataFrame, order: list[str], digits: int = 2) -> DataFrame:
    """One row with one column, `table`: a Markdown table of a summary, which is a few rows by its nature."""
    kinds = dict(summary.dtypes)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(f"`{c}`"), kinds[c], digits) for c in summary.columns]), F.lit(" |"))
    head = [f"| {' | '.join(summary.columns)} |", f"|{'---|' * len(summary.columns)}"]
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"])
    return summary.agg(rows.alias("r")).select(F.array_join(F.concat(F.array(*map(F.lit, head)), F.col("r")), "\n").alias("table"))
