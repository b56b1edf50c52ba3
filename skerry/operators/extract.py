"""Validation of extracted entities and relations, and entity resolution."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .components import connected_components
from .graph import merge_edges
from .versions import VersionedTable

PAYLOAD = "struct<entities:array<struct<name:string,type:string,confidence:string>>,relations:array<struct<source:string,type:string,target:string,confidence:string>>>"

#: Entity types, and relation types with the types of their two ends.
ENTITY_TYPES = ("Person", "Company", "Product", "Technology", "Model", "Location")
SIGNATURES = (
    ("FOUNDED", "Person", "Company"),
    ("CEO_OF", "Person", "Company"),
    ("WORKS_AT", "Person", "Company"),
    ("ACQUIRED", "Company", "Company"),
    ("INVESTED_IN", "Company", "Company"),
    ("PARTNERED_WITH", "Company", "Company"),
    ("COMPETES_WITH", "Company", "Company"),
    ("DEVELOPS", "Company", "Product"),
    ("RELEASED", "Company", "Model"),
    ("USES", "Company", "Technology"),
    ("SUPPLIES", "Company", "Product"),
    ("LOCATED_IN", "Company", "Location"),
    ("RUNS_ON", "Model", "Technology"),
    ("POWERS", "Model", "Product"),
    ("BASED_ON", "Product", "Technology"),
)


def signatures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SIGNATURES), "relation string, source_type string, target_type string")


def entity_type(x: Column) -> Column:
    return F.initcap(F.trim(x))


def relation_type(x: Column) -> Column:
    return F.translate(F.upper(F.trim(x)), " -", "__")


def entities(payloads: DataFrame) -> DataFrame:
    """chunk_id, name, type, confidence and reason (null: valid) of each extracted entity of (chunk_id, payload)."""
    e = payloads.select("chunk_id", F.explode(F.from_json("payload", PAYLOAD)["entities"]).alias("e"))
    rows = e.select("chunk_id", F.trim("e.name").alias("name"), entity_type(F.col("e.type")).alias("type"), T.confidence(F.col("e.confidence")).alias("confidence"))
    bad = F.when(F.coalesce(T.normalize_name(F.col("name")), F.lit("")) == "", "empty_name").when(~F.coalesce(F.col("type").isin(*ENTITY_TYPES), F.lit(False)), "unknown_type")
    return rows.withColumn("reason", bad)


def relations(payloads: DataFrame) -> DataFrame:
    """chunk_id, source, relation, target, confidence and reason of each relation; ends are looked up by normalised name."""
    spark = payloads.sparkSession
    r = payloads.select("chunk_id", F.explode(F.from_json("payload", PAYLOAD)["relations"]).alias("r"))
    rows = r.select(
        "chunk_id",
        F.monotonically_increasing_id().alias("_row"),
        F.trim("r.source").alias("source"),
        relation_type(F.col("r.type")).alias("relation"),
        F.trim("r.target").alias("target"),
        T.confidence(F.col("r.confidence")).alias("confidence"),
        T.normalize_name(F.col("r.source")).alias("_s"),
        T.normalize_name(F.col("r.target")).alias("_t"),
    )
    known = entities(payloads).where("reason is null").groupBy("chunk_id", T.normalize_name(F.col("name")).alias("_n")).agg(F.collect_set("type").alias("_types"))
    ends = rows.join(known.select("chunk_id", F.col("_n").alias("_s"), F.col("_types").alias("_st")), ["chunk_id", "_s"], "left").join(known.select("chunk_id", F.col("_n").alias("_t"), F.col("_types").alias("_tt")), ["chunk_id", "_t"], "left")
    typed = ends.join(F.broadcast(signatures(spark)), "relation", "left")  # 15 rows
    reason = (
        F.when(F.col("source_type").isNull(), "unknown_relation")
        .when(F.col("_s") == F.col("_t"), "self_loop")
        .when(F.col("_st").isNull() | F.col("_tt").isNull(), "unknown_endpoint")
        .when(~(F.array_contains("_st", F.col("source_type")) & F.array_contains("_tt", F.col("target_type"))), "signature")
    )
    return typed.select("chunk_id", "source", "relation", "target", "confidence", reason.alias("reason"), F.when(reason.isNull(), F.col("source_type")).alias("source_type"), F.when(reason.isNull(), F.col("target_type")).alias("target_type"))


def resolve(mentions: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """entity_type, raw_name, entity_id, name, aliases, mentions of each raw name of (entity_type, raw_name).

    Names of one type with the same stripped form are one entity, and so are names that `similar`
    (entity_type, left_name, right_name) links. The canonical name is the most frequent, then the longest,
    then the first in order; aliases are the other ones, sorted.
    """
    names = mentions.where("raw_name is not null").groupBy("entity_type", "raw_name").agg(F.count("*").alias("n"))
    formed = names.withColumn("form", T.strip_legal_suffix(T.normalize_name(F.col("raw_name"))))
    if similar is not None:
        of = formed.select("entity_type", "raw_name", F.concat_ws("\u0001", "entity_type", "form").alias("node"))
        links = similar.join(of.withColumnRenamed("raw_name", "left_name").withColumnRenamed("node", "a"), ["entity_type", "left_name"]).join(of.withColumnRenamed("raw_name", "right_name").withColumnRenamed("node", "b"), ["entity_type", "right_name"])
        parts = connected_components(links.select("a", "b"))
        formed = formed.withColumn("node", F.concat_ws("\u0001", "entity_type", "form")).join(parts, "node", "left").withColumn("form", F.coalesce("component", "node")).drop("node", "component")
    order = Window.partitionBy("entity_type", "form").orderBy(F.desc("n"), F.desc(F.length("raw_name")), "raw_name")
    ranked = formed.withColumn("_p", F.row_number().over(order))
    rolled = ranked.groupBy("entity_type", "form").agg(F.sum("n").alias("mentions"), F.min_by("raw_name", "_p").alias("name"), F.sort_array(F.collect_list("raw_name")).alias("_all"))
    out = rolled.select("entity_type", "form", "mentions", "name", F.array_remove("_all", F.col("name")).alias("aliases"), T.entity_id(F.col("entity_type"), F.col("name")).alias("entity_id"))
    return formed.select("entity_type", "raw_name", "form").join(out, ["entity_type", "form"]).drop("form")


#: Cosine from which on two names are one entity; chance that a pair just there is missed.
SIMILAR, MISSED = 0.86, 1e-3


def similar_names(names: DataFrame, threshold: float = SIMILAR, seed: int = 3) -> DataFrame:
    """entity_type, left_name, right_name: links among names (entity_type, raw_name, embedding) of one type that connect what is alike.

    Candidates share a bucket of random hyperplanes; buckets get narrower and more as names get more, so that
    one holds a few hundred and a pair at the threshold is missed with a chance of MISSED. All of a bucket are
    compared by exact cosine and leave as a forest: a link for each part that a name joins, never all pairs. Vectors that are the same but for rounding are held once. Null and zero vectors link nothing.
    """
    rows = names.where("raw_name is not null and embedding is not null").select("entity_type", "raw_name", F.col("embedding").cast("array<double>").alias("x")).dropDuplicates(["entity_type", "raw_name"])
    first = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim")).first()
    dim = first.dim or 1
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(4, math.ceil(math.log2(max(1, first.n) / 256 + 1)))
    bands = math.ceil(math.log(MISSED) / math.log(1 - agree**bits))
    planes = names.sparkSession.sparkContext.broadcast(np.random.default_rng(seed).normal(size=(bands * bits, dim)))

    def keyed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [np.array(v, float) for v in part.column(2).to_pylist()]
                keep = [i for i, v in enumerate(own) if len(v) == dim and np.isfinite(v).all() and v.any()]
                if not keep:
                    continue
                x = np.array([own[i] / np.linalg.norm(own[i]) for i in keep])
                on = (x @ planes.value.T > 0).reshape(len(x), bands, bits)
                key = (on * (1 << np.arange(bits, dtype=np.int64))).sum(2) + (np.arange(bands, dtype=np.int64) << bits)
                kind, name = part.column(0).take(pa.array(keep)), part.column(1).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([kind, name, pa.array(list(x), pa.list_(pa.float64())), pa.array(list(key), pa.list_(pa.int64()))], ["entity_type", "raw_name", "x", "keys"])

    def compare(batches):
        """A bucket's vectors pass one by one. A vector is held only where it is like no other so far, or ties up what was not yet tied."""
        bucket, held, kept, up = None, np.empty((0, dim)), [], []

        def find(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for batch in batches:
            out = []
            for kind, key, name, vector in zip(*(c.to_pylist() for c in batch.columns)):
                v = np.array(vector)
                if (kind, key) != bucket:
                    bucket, held, kept, up = (kind, key), np.empty((0, dim)), [], []
                near = held @ v
                tops = {}
                for i in np.flatnonzero(near >= threshold).tolist():
                    tops.setdefault(find(i), i)  # of those that hang together already, one
                out += [(kind, kept[i], name) for i in tops.values()]
                if not len(near) or near.max() < 1 - 1e-12:
                    held, kept = np.vstack([held, v]), [*kept, name]
                    up.append(len(up))
                    roots = [*tops, len(up) - 1]
                else:
                    roots = list(tops)
                for r in roots[1:]:
                    up[find(r)] = find(roots[0])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out) if out else ((), (), ()))], ["entity_type", "left_name", "right_name"])

    buckets = rows.mapInArrow(keyed, "entity_type string, raw_name string, x array<double>, keys array<long>").select("entity_type", F.explode("keys").alias("key"), "raw_name", "x")
    dealt = buckets.repartition("entity_type", "key").sortWithinPartitions("entity_type", "key", "raw_name")
    return dealt.mapInArrow(compare, "entity_type string, left_name string, right_name string").distinct()


def graph_payload(payloads: DataFrame, similar: DataFrame | None = None) -> dict[str, DataFrame]:
    """What extractions (chunk_id, payload) write to a graph: entities, mentions, relations, links (chunk to entity) and skipped.

    Names are resolved over all chunks. Relations whose ends aren't entities of their chunk, or have become
    one entity by resolution, are `skipped`, as are none that validation rejects.
    """
    valid = entities(payloads).where("reason is null").select("chunk_id", F.col("type").alias("entity_type"), F.col("name").alias("raw_name"), "confidence")
    resolved = resolve(valid.select("entity_type", "raw_name"), similar).select("entity_type", "raw_name", "entity_id", "name", "aliases", "mentions")
    local = valid.join(resolved, ["entity_type", "raw_name"])
    nodes = resolved.select("entity_id", "name", F.col("entity_type").alias("type"), F.lower("name").alias("normalized"), "aliases", "mentions").dropDuplicates(["entity_id"])
    mentioned = local.groupBy("entity_id", "chunk_id").agg(F.max("confidence").alias("confidence"))
    links = local.select("chunk_id", "entity_id", F.col("name").alias("entity_name"), "entity_type").distinct()
    ends = local.select("chunk_id", "entity_type", T.normalize_name(F.col("raw_name")).alias("_n"), "entity_id").distinct()
    told = relations(payloads).where("reason is null").withColumn("_row", F.monotonically_increasing_id())
    for end in ("source", "target"):
        mine = ends.select("chunk_id", F.col("_n").alias(f"_{end}"), F.col("entity_type").alias(f"{end}_type"), F.col("entity_id").alias(f"{end}_id"))
        told = told.withColumn(f"_{end}", T.normalize_name(F.col(end))).join(mine, ["chunk_id", f"_{end}", f"{end}_type"], "left")
    found = told.groupBy("_row").agg(*[F.min(c).alias(c) for c in ("source_id", "relation", "target_id", "chunk_id", "confidence")]).drop("_row")
    good = F.coalesce(F.col("source_id") != F.col("target_id"), F.lit(False))
    return {"entities": nodes, "mentions": mentioned, "relations": found.where(good), "links": links, "skipped": found.where(~good)}


def write_payload(payload: dict[str, DataFrame], path: str, chunks: DataFrame | None = None) -> dict[str, int]:
    """Merge a payload into the tables under a path, each a whole new version, and count what each then holds (relations by their chunks).

    Entities and links are replaced by key. A mention needs its entity, of this payload or one before, and its chunk if `chunks`
    (chunk_id) is given; its confidence is the last one written. A relation adds its chunk to those it has and keeps the
    highest confidence. What is skipped is kept as told. A payload written twice changes nothing.
    """
    spark = payload["entities"].sparkSession
    tables = {name: VersionedTable(spark, f"{path}/{name}") for name in ("entities", "mentions", "relations", "links", "skipped")}
    tables["entities"].merge(payload["entities"], ["entity_id"])
    known = tables["entities"].read().select("entity_id")
    mentions = payload["mentions"].join(known, "entity_id", "left_semi")
    if chunks is not None:
        mentions = mentions.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    tables["mentions"].merge(mentions.select("entity_id", "chunk_id", "confidence"), ["entity_id", "chunk_id"])
    both = [known.withColumnRenamed("entity_id", f"{end}_id") for end in ("source", "target")]
    told = payload["relations"].join(both[0], "source_id", "left_semi").join(both[1], "target_id", "left_semi").select("source_id", "relation", "target_id", "chunk_id", "confidence")
    after = tables["relations"].version()
    before = tables["relations"].read(after)
    if before is not None:
        told = told.unionByName(before.select("source_id", "relation", "target_id", F.explode("chunk_ids").alias("chunk_id"), "confidence"))
    tables["relations"].write(merge_edges(told.withColumn("ordinal", F.col("chunk_id"))), after)
    tables["links"].merge(payload["links"], ["chunk_id", "entity_id"])
    tables["skipped"].merge(payload["skipped"], payload["skipped"].columns)
    return {name: t.read().agg(F.coalesce(F.sum(F.size("chunk_ids")), F.lit(0)) if name == "relations" else F.count("*")).first()[0] for name, t in tables.items()}


def top_merged(resolved: DataFrame, n: int = 25) -> DataFrame:
    """The entities of several names that are mentioned most: entity_type, name, names, mentions; ties by name and type."""
    one = resolved.select("entity_id", "entity_type", "name", (F.size("aliases") + 1).alias("names"), "mentions").distinct()
    return one.where("names > 1").orderBy(F.desc("mentions"), "name", "entity_type").limit(n).select("entity_type", "name", "names", "mentions")
