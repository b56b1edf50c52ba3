"""Extraction payloads: parsing, coercion, validation; names and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract as X
from ..operators import models as M
from ..operators.components import connected_components
from ..session import scratch
from ..sources.tables import table
from . import vector
from .registry import query


@query("json_extract", "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("json_field_counts", "SELECT CAST(props->>'k' AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")
def json_field_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.from_json("props", "k int")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


_TAGS = "concat('{\"tags\": [', event_id % 3, ', ', event_id % 5, ', ', event_id % 3, '], \"kind\": \"', event_type, '\"}')"


@query("json_array_counts", "SELECT event_type AS kind, tag, count(*) AS n FROM (SELECT event_type, unnest([event_id % 3, event_id % 5, event_id % 3])::BIGINT AS tag FROM events) GROUP BY 1, 2")
def json_array_counts(spark, sf_dir):
    """Groups of what an array inside a JSON text holds."""
    rows = table(spark, sf_dir, "events").select(F.from_json(F.expr(_TAGS), "tags array<bigint>, kind string").alias("j"))
    return rows.select("j.kind", F.explode("j.tags").alias("tag")).groupBy("kind", "tag").agg(F.count("*").alias("n"))


@query("graph_written", "WITH c AS (SELECT * FROM (SELECT count(*) FILTER (WHERE s_suppkey % 4 <> 0) AS r, count(*) AS s, count(DISTINCT s_nationkey) FILTER (WHERE s_suppkey % 4 <> 0) AS n FROM supplier)) SELECT s + n AS entities, s + r AS mentions, r AS relations, s + r AS links, 0::BIGINT AS skipped FROM c")
def graph_written(spark, sf_dir):
    """What stands in a graph's tables after the suppliers' extractions were written as two payloads, the second of which repeats rows of the first."""
    path, all_ = scratch(spark, "graph"), payloads(spark, sf_dir)
    key = F.substring("chunk_id", 2, 20).cast("long")
    for some in (all_.where(key % 3 != 1), all_.where(key % 3 != 0)):
        counts = X.write_payload(X.graph_payload(some), path, all_)
    return spark.createDataFrame([counts], "entities long, mentions long, relations long, links long, skipped long")


@query("extract_backfill", "SELECT 'k' || s_suppkey AS chunk_id, CASE WHEN s_suppkey % 9 = 4 THEN 0 ELSE 2 END AS entities, CASE WHEN s_suppkey % 9 = 4 THEN 0 ELSE 1 END AS relations, CASE WHEN s_suppkey % 9 = 4 THEN 'gave up' END AS error FROM supplier")
def extract_backfill(spark, sf_dir):
    """Extraction that stops after two rounds and goes on: each chunk is asked about once, failures are kept and not asked again."""
    text = F.concat(F.col("s_name"), F.lit(" works with Beta"), F.when(F.col("s_suppkey") % 9 == 4, " (illegible)").otherwise("."))
    items = table(spark, sf_dir, "supplier").select(F.concat(F.lit("k"), "s_suppkey").alias("chunk_id"), text.alias("text"))
    done, failed, model = scratch(spark, "extracted"), scratch(spark, "extract-failed"), M.RuleExtractor(("(illegible)",))
    size = max(1, items.count() // 3)
    M.backfill(spark, items, model, "chunk_id", "text", done, failed, size, 2, M.completed)
    M.backfill(spark, items, model, "chunk_id", "text", done, failed, size, None, M.completed)
    got, lost = spark.read.parquet(done), spark.read.parquet(failed)
    read = F.from_json("answer", X.PAYLOAD)
    rows = got.select("chunk_id", F.size(read["entities"]).alias("entities"), F.size(read["relations"]).alias("relations"), F.lit(None).cast("string").alias("error"))
    return rows.unionByName(lost.select("chunk_id", F.lit(0).alias("entities"), F.lit(0).alias("relations"), "error"))


#: A payload for each supplier: two entities and three relations, valid and not, from its own row.
_PAYLOAD = """to_json(named_struct('entities', array(
 named_struct('name', s_name, 'type', 'company', 'confidence', element_at(array('high','0.7','LOW','2','x'), cast(s_suppkey % 5 + 1 as int))),
 named_struct('name', concat('City ', s_nationkey), 'type', if(s_suppkey % 4 = 0, 'planet', ' LOCATION '), 'confidence', cast(null as string))),
 'relations', array(
 named_struct('source', upper(s_name), 'type', 'located-in', 'target', concat('City ', s_nationkey), 'confidence', 'medium'),
 named_struct('source', s_name, 'type', 'ACQUIRED', 'target', s_name, 'confidence', '1'),
 named_struct('source', concat('City ', s_nationkey), 'type', 'SUPPLIES', 'target', s_name, 'confidence', '0.5'),
 named_struct('source', s_name, 'type', 'INVENTED', 'target', 'nobody', 'confidence', '0.5'))))"""


def payloads(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("concat('k', s_suppkey) as chunk_id", f"{_PAYLOAD} as payload")


_COERCE = "CASE s_suppkey % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 WHEN 2 THEN 0.3 ELSE 1.0 END"


@query("validate_entities", f"SELECT 'k' || s_suppkey AS chunk_id, s_name AS name, 'Company' AS type, CAST({_COERCE} AS DOUBLE) AS confidence, NULL::VARCHAR AS reason FROM supplier UNION ALL SELECT 'k' || s_suppkey, 'City ' || s_nationkey, CASE WHEN s_suppkey % 4 = 0 THEN 'Planet' ELSE 'Location' END, 1.0, CASE WHEN s_suppkey % 4 = 0 THEN 'unknown_type' END FROM supplier")
def validate_entities(spark, sf_dir):
    return X.entities(payloads(spark, sf_dir))


_RELS = "SELECT 'k' || s_suppkey AS chunk_id, upper(s_name) AS source, 'LOCATED_IN' AS relation, 'City ' || s_nationkey AS target, 0.6::DOUBLE AS confidence, CASE WHEN s_suppkey % 4 = 0 THEN 'unknown_endpoint' END AS reason FROM supplier UNION ALL SELECT 'k' || s_suppkey, s_name, 'ACQUIRED', s_name, 1.0, 'self_loop' FROM supplier UNION ALL SELECT 'k' || s_suppkey, 'City ' || s_nationkey, 'SUPPLIES', s_name, 0.5, CASE WHEN s_suppkey % 4 = 0 THEN 'unknown_endpoint' ELSE 'signature' END FROM supplier UNION ALL SELECT 'k' || s_suppkey, s_name, 'INVENTED', 'nobody', 0.5, 'unknown_relation' FROM supplier"


@query("validate_extraction", _RELS)
def validate_extraction(spark, sf_dir):
    return X.relations(payloads(spark, sf_dir)).select("chunk_id", "source", "relation", "target", "confidence", "reason")


@query("reject_histogram", f"SELECT reason, count(*) AS n FROM ({_RELS}) WHERE reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 12")
def reject_histogram(spark, sf_dir):
    return X.relations(payloads(spark, sf_dir)).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(12)


@query("confidence_coerce", "SELECT p_partkey, CAST(CASE p_partkey % 7 WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 WHEN 3 THEN 1.0 WHEN 4 THEN 0.25 WHEN 5 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS confidence FROM part")
def confidence_coerce(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ("High", "medium", " low ", "soon", "0.25", "-3", "7"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.confidence(raw).alias("confidence"))


@query("type_tolerance", "SELECT event_id, upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) AS entity_type, upper(replace(replace('is-' || event_type || ' by', '-', '_'), ' ', '_')) AS relation FROM events")
def type_tolerance(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", X.entity_type(F.concat(F.lit(" "), F.upper("event_type"))).alias("entity_type"), X.relation_type(F.concat(F.lit("is-"), F.col("event_type"), F.lit(" by"))).alias("relation"))


_NORM = r"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("normalize_name", f"SELECT doc_id, sha256({_NORM.format(x='text')}) AS digest FROM documents")
def normalize_name(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_name(F.col("text")), 256).alias("digest"))


@query("strip_suffix", f"SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'inc ltd' ELSE {_NORM.format(x='c_name')} END AS form FROM customer")
def strip_suffix(spark, sf_dir):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat("c_name", F.lit(", Inc."))).when(k == 1, F.concat("c_name", F.lit(" Co LTD"))).when(k == 3, F.lit("Inc Ltd")).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.strip_legal_suffix(T.normalize_name(name)).alias("form"))


@query("entity_id", f"SELECT c_custkey, sha256('company:' || {_NORM.format(x='c_name')}) AS entity_id FROM customer")
def entity_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.entity_id(F.lit("Company"), F.upper("c_name")).alias("entity_id"))


def _mentions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    forms = F.array(F.col("c_name"), F.concat("c_name", F.lit(" Inc")), F.concat("c_name", F.lit(" Inc")), F.upper(F.concat("c_name", F.lit(", Ltd"))))
    return c.select(F.lit("Company").alias("entity_type"), F.explode(forms).alias("raw_name")).unionByName(c.where("c_custkey % 10 = 0").select(F.lit("Product").alias("entity_type"), F.col("c_name").alias("raw_name")))


_M = "m AS (SELECT 'Company' AS t, unnest([c_name, c_name || ' Inc', c_name || ' Inc', upper(c_name || ', Ltd')]) AS r, c_custkey AS k FROM customer UNION ALL SELECT 'Product', c_name, c_custkey FROM customer WHERE c_custkey % 10 = 0), g AS (SELECT t, k, r, count(*) AS n FROM m GROUP BY 1, 2, 3)"


@query("resolve_exact", f"WITH {_M}, z AS (SELECT *, row_number() OVER (PARTITION BY t, k ORDER BY n DESC, length(r) DESC, r) AS p, sum(n) OVER (PARTITION BY t, k) AS total FROM g) SELECT a.t AS entity_type, a.r AS raw_name, b.r AS name, CAST(a.total AS BIGINT) AS mentions FROM z a JOIN z b ON a.t = b.t AND a.k = b.k AND b.p = 1")
def resolve_exact(spark, sf_dir):
    return X.resolve(_mentions(spark, sf_dir)).select("entity_type", "raw_name", "name", "mentions")


@query("canonical_alias", f"WITH {_M}, z AS (SELECT *, row_number() OVER (PARTITION BY t, k ORDER BY n DESC, length(r) DESC, r) AS p FROM g) SELECT t AS entity_type, max(r) FILTER (WHERE p = 1) AS name, coalesce(string_agg(r, '|' ORDER BY r) FILTER (WHERE p > 1), '') AS aliases FROM z GROUP BY t, k")
def canonical_alias(spark, sf_dir):
    return X.resolve(_mentions(spark, sf_dir)).select("entity_type", "name", F.array_join("aliases", "|").alias("aliases")).distinct()


@query("resolve_similar", f"WITH {_M}, h AS (SELECT t, k - k % 2 AS k, r, sum(n) AS n FROM g WHERE t = 'Company' GROUP BY 1, 2, 3), z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, length(r) DESC, r) AS p, sum(n) OVER (PARTITION BY k) AS total FROM h) SELECT a.r AS raw_name, b.r AS name, CAST(a.total AS BIGINT) AS mentions FROM z a JOIN z b ON a.k = b.k AND b.p = 1")
def resolve_similar(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    even = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("left_name"), (F.col("c_custkey") + 1).alias("k"))
    similar = even.join(c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("right_name")), "k").select(F.lit("Company").alias("entity_type"), "left_name", "right_name")
    return X.resolve(_mentions(spark, sf_dir).where("entity_type = 'Company'"), similar).select("raw_name", "name", "mentions")


@query("json_object", "SELECT event_id, '{\"a\": {\"b\": \"}\"}, \"n\": ' || (event_id % 9) || '}' AS payload FROM events")
def json_object(spark, sf_dir):
    raw = F.concat(F.lit('Sure:\n```json\n{"a": {"b": "}"}, "n": '), (F.col("event_id") % 9).cast("string"), F.lit("}\n``` and {more}"))
    return table(spark, sf_dir, "events").select("event_id", T.json_object(raw).alias("payload"))


@query("duration_seconds", "SELECT event_id, round((event_id % 3) * 3600 + (event_id % 60) * 60 + (event_id % 10) / 10.0 + (event_id % 5) / 1000.0, 6)::DOUBLE AS seconds FROM events")
def duration_seconds(spark, sf_dir):
    e = F.col("event_id")
    raw = F.concat((e % 3).cast("string"), F.lit("h"), (e % 60).cast("string"), F.lit("m"), ((e % 10) / 10).cast("string"), F.lit("s"), (e % 5).cast("string"), F.lit("ms"))
    return table(spark, sf_dir, "events").select("event_id", F.round(T.duration_seconds(raw), 6).alias("seconds"))


@query("graph_payload", "SELECT (SELECT count(*) FROM supplier) + (SELECT count(DISTINCT s_nationkey) FROM supplier WHERE s_suppkey % 4 <> 0) AS entities, count(*) + count(*) FILTER (WHERE s_suppkey % 4 <> 0) AS mentions, count(*) FILTER (WHERE s_suppkey % 4 <> 0) AS relations, count(*) + count(*) FILTER (WHERE s_suppkey % 4 <> 0) AS links, 0::BIGINT AS skipped FROM supplier")
def graph_payload(spark, sf_dir):
    """How many rows the extractions of all suppliers write to a graph."""
    parts = [df.agg(F.count("*").alias(name)) for name, df in X.graph_payload(payloads(spark, sf_dir)).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query("top_merged", f"WITH {_M}, z AS (SELECT *, row_number() OVER (PARTITION BY t, k ORDER BY n DESC, length(r) DESC, r) AS p FROM g) SELECT t AS entity_type, max(r) FILTER (WHERE p = 1) AS name, CAST(count(*) AS INTEGER) AS names, CAST(sum(n) AS BIGINT) AS mentions FROM z GROUP BY t, k HAVING count(*) > 1 ORDER BY mentions DESC, name, entity_type LIMIT 25")
def top_merged(spark, sf_dir):
    return X.top_merged(X.resolve(_mentions(spark, sf_dir)))


@query("similar_entities", f"WITH RECURSIVE p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {vector._COS.format(a='a.embedding', b='b.embedding')} >= 0.86), r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, p.y FROM r JOIN p ON r.seen = p.x) SELECT node AS vec_id, min(seen) AS entity FROM r GROUP BY 1")
def similar_entities(spark, sf_dir):
    """Vectors of one label that a chain of cosines of 0.86 or more connects, as the least of them."""
    v = table(spark, sf_dir, "embeddings")
    links = X.similar_names(v.select(F.col("label").cast("string").alias("entity_type"), F.col("vec_id").cast("string").alias("raw_name"), "embedding"))
    parts = connected_components(links.select(F.col("left_name").cast("long"), F.col("right_name").cast("long")))
    return v.select("vec_id").join(parts, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.coalesce("component", "vec_id").alias("entity"))
