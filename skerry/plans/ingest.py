"""Documents to chunks, and the checks of keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import models, store
from ..operators.versions import VersionedTable
from ..session import scratch, ship
from ..sources.tables import table
from .registry import query


@query("doc_hash", "SELECT doc_id, sha256(text) AS content_hash, length(text) AS n FROM documents")
def doc_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.length("text").cast("long").alias("n"))


@query("dup_groups", "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


_WINDOWS = r"""
WITH d AS (SELECT doc_id, text, greatest(0, CAST(ceil((length(text) - 800) / 700.0) AS INTEGER)) AS last FROM documents),
w AS (SELECT doc_id, i, regexp_replace(substr(text, i * 700 + 1, 800), '^\s+|\s+$', '', 'g') AS chunk FROM (SELECT doc_id, text, unnest(range(0, last + 1)) AS i FROM d)),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, chunk FROM w WHERE chunk <> '')
"""


def chunks(spark, sf_dir):
    """(doc_id, chunk_index, chunk, chunk_id) of fixed windows."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(T.fixed_windows(F.col("text"))).alias("chunk_index", "chunk"))
    return rows.withColumn("chunk_id", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256))


@query("chunk_windows", _WINDOWS + "SELECT doc_id, chunk_index, sha256(concat_ws(':', doc_id::VARCHAR, chunk_index::VARCHAR)) AS chunk_id, length(chunk) AS n, sha256(chunk) AS digest FROM c")
def chunk_windows(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", F.length("chunk").cast("long").alias("n"), F.sha2("chunk", 256).alias("digest"))


@query("chunk_stats", _WINDOWS + "SELECT n_chunks, count(*) AS docs, max(longest) AS longest FROM (SELECT doc_id, count(*) AS n_chunks, max(length(chunk)) AS longest FROM c GROUP BY 1) GROUP BY 1")
def chunk_stats(spark, sf_dir):
    per = chunks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("chunk")).cast("long").alias("longest"))
    return per.groupBy("n_chunks").agg(F.count("*").alias("docs"), F.max("longest").alias("longest"))


_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_SUM = "coalesce(list_sum(list_transform({x}, lambda w: length(w))), 0)"
#: A step of the recursion takes each document's next paragraph.
_PACKED = rf"""
WITH RECURSIVE pg AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda p: {_STRIP.format(x='p')}), lambda p: p <> '') AS ps FROM documents),
r AS (SELECT doc_id, 0::BIGINT AS i, []::VARCHAR[] AS cur, []::VARCHAR[] AS done FROM pg
UNION ALL SELECT doc_id, i, CASE WHEN large THEN [] WHEN filled THEN cur[list_filter(range(1, len(cur) + 2), lambda k: {_SUM.format(x='cur[k:]')} <= 100)[1]:] || [p] ELSE cur || [p] END,
  CASE WHEN large THEN closed || list_filter(list_transform(range(0, greatest(0, CAST(ceil((length(p) - 800) / 700.0) AS BIGINT)) + 1), lambda w: {_STRIP.format(x='substr(p, w * 700 + 1, 800)')}), lambda c: c <> '') WHEN filled THEN closed ELSE done END
FROM (SELECT *, length(p) > 800 AS large, len(cur) > 0 AND {_SUM.format(x='cur')} + length(p) > 800 AS filled, CASE WHEN len(cur) > 0 THEN done || [array_to_string(cur, chr(10) || chr(10))] ELSE done END AS closed
  FROM (SELECT r.doc_id, r.i + 1 AS i, r.cur, r.done, pg.ps[r.i + 1] AS p FROM r JOIN pg ON pg.doc_id = r.doc_id AND r.i < len(pg.ps)))),
f AS (SELECT r.doc_id, CASE WHEN len(cur) > 0 THEN done || [array_to_string(cur, chr(10) || chr(10))] ELSE done END AS cs FROM r JOIN pg ON pg.doc_id = r.doc_id AND r.i = len(pg.ps))
SELECT doc_id, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS chunk_index, unnest(cs) AS chunk FROM f
"""


@query("paragraph_chunks", _PACKED)
def paragraph_chunks(spark, sf_dir):
    """Greedy paragraph packing; sentences' line breaks count as blank lines, as no text here has any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return docs.select("doc_id", F.posexplode(T.pack_paragraphs(F.col("text"))).alias("chunk_index", "chunk"))


def _versions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 7 <> 3").select("doc_id", F.sha2("text", 256).alias("digest"))
    new = docs.where("doc_id % 11 <> 5").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return old, new


@query(
    "upsert_delta",
    "WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 3), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 5) "
    "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'absent' WHEN o.h = n.h THEN 'skip' ELSE 'replace' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id",
)
def upsert_delta(spark, sf_dir):
    return store.upsert_delta(*_versions(spark, sf_dir), "doc_id", "digest")


@query("insert_if_absent", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 7 = 3")
def insert_if_absent(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return store.insert_if_absent(docs.where("doc_id % 7 <> 3"), docs, ["doc_id"])


@query("update_by_key", "SELECT p_partkey, p_name, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) THEN (SELECT max(l_quantity) FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l_quantity >= 50) ELSE p_retailprice END AS p_retailprice FROM part p")
def update_by_key(spark, sf_dir):
    changes = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("p_retailprice"))
    return store.update_by_key(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), changes, "p_partkey", "p_retailprice")


@query("pending_anti", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_anti(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return store.pending(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("orphan_check", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_check(spark, sf_dir):
    return store.orphans(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("unique_check", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_check(spark, sf_dir):
    return store.violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("cascade_delete", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")
    kept = store.cascade_delete({"orders": table(spark, sf_dir, "orders").select("o_orderkey"), "lines": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("one"))}, gone, "o_orderkey")
    return kept["orders"].join(kept["lines"], "o_orderkey", "left").groupBy("o_orderkey").agg(F.count("one").alias("n"))


@query("merge_last", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def merge_last(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return store.merge_last(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query("table_counts", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS embedded, (SELECT count(*) FROM labels) AS labels")
def table_counts(spark, sf_dir):
    one = [table(spark, sf_dir, t).agg(F.count(F.lit(1) if c is None else F.col(c)).alias(n)) for t, c, n in (("documents", None, "documents"), ("embeddings", "embedding", "embedded"), ("labels", None, "labels"))]
    return one[0].crossJoin(one[1]).crossJoin(one[2])  # one row each


@query("point_lookup", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 17")
def point_lookup(spark, sf_dir):
    return store.by_key(table(spark, sf_dir, "documents"), "doc_id", 17).select("doc_id", "lang", "source", "n_chars")


@query("in_list_lookup", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (3, 17, 99, -1)")
def in_list_lookup(spark, sf_dir):
    return store.by_keys(table(spark, sf_dir, "documents"), "doc_id", [3, 17, 17, None, 99, -1]).select("doc_id", "lang", "source", "n_chars")


@query("pending_batch", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderdate, o_orderkey LIMIT 100")
def pending_batch(spark, sf_dir):
    """The 100 oldest orders without a returned line: the next batch of a resumable job."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return store.oldest_pending(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), done, ["o_orderkey"], ["o_orderdate"], 100)


@query("embed_backfill")
def embed_backfill(spark, sf_dir):
    """Customers' names embedded by the stub provider, in two rounds: key, length of the vector, model."""
    ship(spark)
    done, failed = scratch(spark, "embedded"), scratch(spark, "embed-failed")
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    models.backfill(spark, names, models.StubProvider(), "c_custkey", "c_name", done, failed, batch=-(-names.count() // 2) or 1)
    return spark.read.parquet(done).select("c_custkey", F.size("embedding").alias("dim"), "model")


@query(
    "documents_written",
    "WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 3), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 5) "
    "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.h, o.h) AS content_hash, CASE WHEN n.doc_id IS NULL OR o.h = n.h THEN 1 ELSE 2 END AS version FROM o FULL JOIN n ON o.doc_id = n.doc_id",
)
def documents_written(spark, sf_dir):
    """The documents' table after two ingests: what is new or changed is written with the second, what is the same isn't, what is gone stays."""
    docs = table(spark, sf_dir, "documents")
    first = docs.where("doc_id % 7 <> 3").select("doc_id", "text")
    second = docs.where("doc_id % 11 <> 5").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    stored = VersionedTable(spark, scratch(spark, "documents"))
    for version, rows in enumerate((first, second), 1):
        new, old = rows.withColumn("content_hash", F.sha2("text", 256)), stored.read()
        if old is not None:
            change = store.upsert_delta(old, new, "doc_id", "content_hash").where("action in ('insert', 'replace')")
            new = new.join(change.select("doc_id"), "doc_id", "left_semi")
        stored.merge(new.withColumn("version", F.lit(version)), ["doc_id"])
    return stored.read().select("doc_id", "content_hash", "version")


@query(
    "mention_upsert",
    "WITH m AS (SELECT 'C' || o_custkey AS entity_id, CAST(l_orderkey AS VARCHAR) AS chunk_id, 1 - l_discount AS confidence, l_linenumber AS o FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT 'S' || l_suppkey, CAST(l_orderkey AS VARCHAR), 1 - l_discount, l_linenumber FROM lineitem), "
    "k AS (SELECT * FROM m WHERE (entity_id[1] = 'C' AND CAST(entity_id[2:] AS BIGINT) IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) OR entity_id[1] = 'S') AND CAST(chunk_id AS BIGINT) IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 1)) SELECT entity_id, chunk_id, round(arg_max(confidence, o * 10 + confidence), 6) AS confidence FROM k GROUP BY 1, 2",
)
def mention_upsert(spark, sf_dir):
    """Mentions in two writes: those of an unknown entity or chunk are left out, and the last confidence stays."""
    line = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_suppkey", "1 - l_discount as confidence", "l_linenumber * 10 + 1 - l_discount as ordinal")
    buyers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(line, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr("concat('C', o_custkey) as entity_id", "cast(l_orderkey as string) as chunk_id", "confidence", "ordinal")
    every = buyers.unionByName(line.selectExpr("concat('S', l_suppkey) as entity_id", "cast(l_orderkey as string) as chunk_id", "confidence", "ordinal"))
    entities = table(spark, sf_dir, "customer").where("c_acctbal > 0").selectExpr("concat('C', c_custkey) as entity_id").unionByName(line.selectExpr("concat('S', l_suppkey) as entity_id").distinct())
    chunks = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 1").selectExpr("cast(o_orderkey as string) as chunk_id")
    early = store.upsert_mentions(every.where("ordinal < 30"), entities, chunks, "ordinal")
    now = store.upsert_mentions(every.where("ordinal >= 30"), entities, chunks, "ordinal", early)
    return now.withColumn("confidence", F.round("confidence", 6))
