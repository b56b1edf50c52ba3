"""Keyed tables: what appends, upserts and deletes change, as plain joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_delta(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Key and action: insert, skip (same digest), replace, or absent (only in the old table)."""
    o = old.select(F.col(key), F.col(digest).alias("_old"), F.lit(True).alias("_in_old"))
    n = new.select(F.col(key), F.col(digest).alias("_new"), F.lit(True).alias("_in_new"))
    action = F.when(F.col("_in_old").isNull(), "insert").when(F.col("_in_new").isNull(), "absent").when(F.col("_old").eqNullSafe(F.col("_new")), "skip").otherwise("replace")
    return o.join(n, key, "full").select(key, action.alias("action"))


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `rows` whose key the table lacks: what an append has to write."""
    return rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")


def pending(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items without a result yet."""
    return items.join(done.select(*keys), keys, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Children whose parent is missing."""
    return child.join(parent.select(*keys), keys, "left_anti")


def violations(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of deleted keys."""
    return {name: t.join(gone.select(key), key, "left_anti") for name, t in tables.items()}


def update_by_key(table: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """The table with a column's new values where there are any."""
    new = changes.select(key, F.col(column).alias("_new"))
    return table.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def merge_last(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union of both, the row of the highest order winning for each key."""
    every = old.unionByName(new)
    rest = [c for c in every.columns if c not in keys]
    best = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def top_n_per(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


#: Values of an IN list that are pushed to the scan; more are joined.
IN_LIST = 1000


def by_key(table: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key, as a predicate that reaches the scan; of null, none."""
    return table.where(F.col(key) == F.lit(value))


def by_keys(table: DataFrame, key: str, values: list) -> DataFrame:
    """The rows of a list of keys; nulls and repeated values count for nothing."""
    wanted = sorted({v for v in values if v is not None})
    if len(wanted) <= IN_LIST:
        return table.where(F.col(key).isin(wanted)) if wanted else table.where("false")
    kind = table.schema[key].dataType.simpleString()
    return table.join(table.sparkSession.createDataFrame([(v,) for v in wanted], f"`{key}` {kind}"), key, "left_semi")


def oldest_pending(items: DataFrame, done: DataFrame, keys: list[str], order: list[str], batch: int) -> DataFrame:
    """The next batch of work: items without a result, in a total order."""
    if batch < 1:
        raise ValueError("batch must be at least 1")
    return pending(items, done, keys).orderBy(*order, *keys).limit(batch)


def upsert_mentions(mentions: DataFrame, entities: DataFrame, chunks: DataFrame, order: str, old: DataFrame | None = None) -> DataFrame:
    """entity_id, chunk_id, confidence after the mentions were written over `old` ones: both ends must exist, and the last by `order` stays."""
    found = mentions.join(entities.select("entity_id"), "entity_id", "left_semi").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    last = found.groupBy("entity_id", "chunk_id").agg(F.max_by("confidence", order).alias("confidence"))
    if old is None:
        return last
    return old.select("entity_id", "chunk_id", "confidence").join(last.select("entity_id", "chunk_id"), ["entity_id", "chunk_id"], "left_anti").unionByName(last)
