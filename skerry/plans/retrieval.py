"""Routing, linking, ranking and fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retrieve as R
from ..operators.store import top_n_per
from ..sources.tables import table
from . import vector
from .registry import query

#: Questions made of event rows, for the routing rules.
_TEMPLATES = ("Who founded it and how are they connected?", "Explain why it works", "Which companies partner?", "Describe the path", "Just this", "What is the overview?", "How many are there?", "Is it related?")


def questions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.element_at(F.array(*map(F.lit, _TEMPLATES)), (F.col("event_id") % 8 + 1).cast("int"))
    return e.select(F.col("event_id").alias("question_id"), text.alias("question"), (F.floor(F.col("event_id") / 8) % 3).cast("int").alias("entities"))


def _count(patterns):
    return " + ".join(f"CAST(regexp_matches(lower(question), '{p}') AS INTEGER)" for p in patterns)


_QS = "q AS (SELECT event_id AS question_id, [" + ", ".join(f"'{t}'" for t in _TEMPLATES) + f"][event_id % 8 + 1] AS question, CAST(event_id // 8 % 3 AS INTEGER) AS entities FROM events), m AS (SELECT *, {_count(R.GRAPH_MARKERS)} AS g, {_count(R.VECTOR_MARKERS)} AS v FROM q), r AS (SELECT *, CASE WHEN entities >= 2 THEN 'graph' WHEN g > 0 AND v > 0 THEN 'hybrid' WHEN g >= 1 THEN 'graph' ELSE 'vector' END AS base, CAST(CASE WHEN entities >= 2 THEN CASE WHEN g > 0 THEN 0.85 ELSE 0.7 END WHEN g > 0 AND v > 0 THEN 0.7 WHEN g >= 2 THEN 0.85 WHEN g = 1 THEN CASE WHEN entities > 0 THEN 0.65 ELSE 0.5 END WHEN v >= 1 THEN 0.75 ELSE 0.4 END AS DOUBLE) AS confidence FROM m)"


@query("route_heuristic", f"WITH {_QS} SELECT question_id, CASE WHEN confidence < 0.6 THEN 'hybrid' ELSE base END AS route, confidence, confidence < 0.6 AS fallback FROM r")
def route_heuristic(spark, sf_dir):
    return R.route(questions(spark, sf_dir)).select("question_id", "route", "confidence", "fallback")


@query("routing_log", f"WITH {_QS} SELECT CASE WHEN confidence < 0.6 THEN 'hybrid' ELSE base END AS route, count(*) AS n, round(avg(confidence), 6) AS confidence, count(*) FILTER (WHERE confidence < 0.6) AS fallbacks FROM r GROUP BY 1")
def routing_log(spark, sf_dir):
    return R.route(questions(spark, sf_dir)).groupBy("route").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count_if("fallback").alias("fallbacks"))


@query("link_entities", "WITH q AS (SELECT c_custkey AS question_id, n_nationkey AS n, r_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT question_id, position, CASE position WHEN 0 THEN CASE WHEN nl > rl OR nl = rl AND nn < rn THEN 'N' || n ELSE 'R' || r END ELSE CASE WHEN nl > rl OR nl = rl AND nn < rn THEN 'R' || r ELSE 'N' || n END END AS entity_id FROM (SELECT question_id, n, r, lower(n_name) AS nn, lower(r_name) AS rn, length(n_name) AS nl, length(r_name) AS rl, unnest([0, 1]) AS position FROM q JOIN nation ON n = n_nationkey JOIN region ON r = r_regionkey WHERE NOT contains(lower(n_name), lower(r_name)) AND NOT contains(lower(r_name), lower(n_name)))")
def link_entities(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    clear = ~F.lower("n_name").contains(F.lower("r_name")) & ~F.lower("r_name").contains(F.lower("n_name"))
    qs = c.where(clear).select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("Is "), F.initcap("n_name"), F.lit("'s place in "), F.col("r_name"), F.lit("?")).alias("question"))
    forms = table(spark, sf_dir, "nation").selectExpr("concat('N', n_nationkey) as entity_id", "n_name as form").unionByName(table(spark, sf_dir, "region").selectExpr("concat('R', r_regionkey) as entity_id", "r_name as form"))
    return R.link_entities(qs, forms).select("question_id", "position", "entity_id")


def facts(spark, sf_dir):
    """Facts for a question of each customer: its orders' lines as statements."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount", "l_linenumber")
    return table(spark, sf_dir, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr("o_custkey as question_id", "concat('part ', l_partkey % 50) as statement", "cast(l_linenumber % 2 + 1 as int) as hops", "l_discount as confidence", "cast(l_partkey % 3 as int) as covered", "cast(l_orderkey as string) as chunk_id")


_F = "f AS (SELECT o_custkey AS question_id, 'part ' || (l_partkey % 50) AS statement, l_linenumber % 2 + 1 AS hops, l_partkey % 3 * 10 + CASE WHEN l_linenumber % 2 + 1 = 1 THEN coalesce(nullif(l_discount, 0), 1.0) ELSE 0.7 END - (l_linenumber % 2 + 1) * 0.1 AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey), d AS (SELECT *, row_number() OVER (PARTITION BY question_id, statement ORDER BY score DESC, hops) AS p FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, hops, statement) AS rank FROM d WHERE p = 1)"


@query("rank_facts", f"WITH {_F} SELECT question_id, CAST(rank AS INTEGER) AS rank, statement, round(score, 6) AS score FROM k WHERE rank <= 5")
def rank_facts(spark, sf_dir):
    return R.rank_facts(facts(spark, sf_dir), 5).select("question_id", "rank", "statement", F.round("score", 6).alias("score"))


@query("dedupe_facts", f"WITH {_F} SELECT question_id, count(*) AS n, round(sum(score), 4) AS score FROM k GROUP BY 1")
def dedupe_facts(spark, sf_dir):
    return R.rank_facts(facts(spark, sf_dir), 1 << 30).groupBy("question_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))


def ranked_lists(spark, sf_dir):
    """Two rankings for each query vector: by vector, and by label and id as a graph would give them."""
    v = table(spark, sf_dir, "embeddings")
    near = vector.knn(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.lit("vector").alias("list"), F.col("vec_id").alias("item"), "rank")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "label")
    first = top_n_per(v.select(F.col("vec_id").alias("item"), "label"), ["label"], ["item"], 11)  # ten, and the question's own
    mates = q.join(first, "label").where("item <> question_id")
    order = Window.partitionBy("question_id").orderBy("item")
    graph = mates.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("question_id", F.lit("graph").alias("list"), "item", "rank")
    return near.unionByName(graph)


_RRF = f"WITH {vector._PAIRS}, g AS (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), u AS (SELECT query_id, vec_id, rank FROM r WHERE rank <= 5 UNION ALL SELECT query_id, vec_id, rank FROM g WHERE rank <= 10), s AS (SELECT query_id AS question_id, vec_id AS item, sum(1.0::DOUBLE / (60 + rank)) AS score FROM u GROUP BY 1, 2)"


@query("rrf_fuse", _RRF + " SELECT question_id, item, round(score, 8) AS score FROM s")
def rrf_fuse(spark, sf_dir):
    return R.rrf(ranked_lists(spark, sf_dir)).select("question_id", "item", F.round("score", 8).alias("score"))


@query("rerank_passages", _RRF + ", o AS (SELECT s.*, row_number() OVER (PARTITION BY s.question_id ORDER BY round(s.score, 8) DESC, item) AS position FROM s JOIN r ON r.query_id = s.question_id AND r.vec_id = s.item AND r.rank <= 5) SELECT question_id, CAST(position AS INTEGER) AS position, item, round(score, 8) AS score FROM o")
def rerank_passages(spark, sf_dir):
    """Fusion re-orders the vector passages; items of the graph alone don't enter."""
    lists = ranked_lists(spark, sf_dir)
    fused = R.rrf(lists).withColumn("score", F.round("score", 8)).join(lists.where("list = 'vector'").select("question_id", "item"), ["question_id", "item"], "left_semi")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "item")
    return fused.withColumn("position", F.row_number().over(order)).select("question_id", "position", "item", "score")


@query("rerank_facts", "WITH c AS (SELECT o_custkey AS question_id, 'part ' || (l_partkey % 50) AS statement, min(l_linenumber % 2 + 1) AS hops, max(1.0::DOUBLE / (60 + l_linenumber)) AS best FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY best DESC, hops, statement) AS position FROM c) SELECT question_id, CAST(position AS INTEGER) AS position, statement, round(best, 8) AS best FROM o WHERE position <= 3")
def rerank_facts(spark, sf_dir):
    """Facts by the best score of their chunks."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    f = table(spark, sf_dir, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("question_id"), F.concat(F.lit("part "), F.col("l_partkey") % 50).alias("statement")).agg(F.min(F.col("l_linenumber") % 2 + 1).alias("hops"), F.max(F.lit(1.0) / (F.lit(60) + F.col("l_linenumber"))).alias("best"))
    order = Window.partitionBy("question_id").orderBy(F.desc("best"), "hops", "statement")
    return f.withColumn("position", F.row_number().over(order)).where("position <= 3").select("question_id", "position", "statement", F.round("best", 8).alias("best"))


@query("hybrid_retrieve", _RRF + ", hp AS (SELECT s.question_id, s.item, row_number() OVER (PARTITION BY s.question_id ORDER BY round(s.score, 8) DESC, item) AS position FROM s JOIN r ON r.query_id = s.question_id AND r.vec_id = s.item AND r.rank <= 5) SELECT question_id, count(*) AS passages, string_agg(CAST(item AS VARCHAR), '|' ORDER BY position) AS items FROM hp GROUP BY 1")
def hybrid_retrieve(spark, sf_dir):
    p = rerank_passages(spark, sf_dir)
    return p.groupBy("question_id").agg(F.count("*").alias("passages"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "item"))), lambda x: x["item"].cast("string")), "|").alias("items"))
