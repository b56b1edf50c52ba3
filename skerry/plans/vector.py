"""Vector search and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import ann, ivf
from ..session import scratch
from ..sources.tables import table
from .registry import query

_Q = "q AS (SELECT embedding AS qv FROM embeddings ORDER BY vec_id LIMIT 1)"
_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE)))"


def _first(spark, sf_dir):
    """The vector of the smallest id, as a one-row table."""
    v = table(spark, sf_dir, "embeddings")
    return v.agg(F.min_by("embedding", "vec_id").alias("qv"))


def _top(spark, sf_dir, measure, k=5):
    v = table(spark, sf_dir, "embeddings").where("embedding is not null")
    scored = v.crossJoin(F.broadcast(_first(spark, sf_dir))).select("vec_id", "label", F.round(measure(F.col("embedding"), F.col("qv")), 6).alias("score"))
    return scored


@query("topk_cosine", f"WITH {_Q} SELECT vec_id, label, round({_COS.format(a='embedding', b='qv')}, 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 5")
def topk_cosine(spark, sf_dir):
    return _top(spark, sf_dir, V.cosine).orderBy(F.desc("score"), "vec_id").limit(5)


@query("topk_l2", f"WITH {_Q} SELECT vec_id, label, round(sqrt(list_sum(list_transform(list_zip(embedding, qv), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 6) AS score FROM embeddings, q ORDER BY score, vec_id LIMIT 5")
def topk_l2(spark, sf_dir):
    return _top(spark, sf_dir, V.l2).orderBy("score", "vec_id").limit(5)


@query("topk_ip", f"WITH {_Q} SELECT vec_id, label, round(-list_sum(list_transform(list_zip(embedding, qv), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score FROM embeddings, q ORDER BY score, vec_id LIMIT 5")
def topk_ip(spark, sf_dir):
    return _top(spark, sf_dir, lambda a, b: -V.dot(a, b)).orderBy("score", "vec_id").limit(5)


_PAIRS = f"p AS (SELECT a.vec_id AS query_id, b.vec_id, a.label AS ql, b.label AS bl, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)"


def knn(spark, sf_dir, k=5):
    return ann.knn(table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0"), table(spark, sf_dir, "embeddings"), k)


@query("knn_batch", f"WITH {_PAIRS} SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5")
def knn_batch(spark, sf_dir):
    return knn(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score")


@query("recall_at_k", f"WITH {_PAIRS} SELECT ql AS label, count(DISTINCT query_id) AS queries, round(avg(CASE WHEN ql = bl THEN 1.0 ELSE 0.0 END), 6) AS precision_at_5, round(sum(CASE WHEN hit THEN 1.0 ELSE 0 END) / count(DISTINCT query_id), 6) AS hit_rate FROM (SELECT *, ql = bl AND row_number() OVER (PARTITION BY query_id, ql = bl ORDER BY rank) = 1 AS hit FROM r WHERE rank <= 5) GROUP BY 1")
def recall_at_k(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = knn(spark, sf_dir).join(labels.withColumnRenamed("label", "bl"), "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("label")), "query_id")
    per = near.groupBy("query_id", "label").agg(F.sum((F.col("bl") == F.col("label")).cast("int")).alias("same"), F.count("*").alias("n"))
    return per.groupBy("label").agg(F.count("*").alias("queries"), F.round(F.sum("same") / F.sum("n"), 6).alias("precision_at_5"), F.round(F.avg((F.col("same") > 0).cast("double")), 6).alias("hit_rate"))


@query("sim_join_threshold", f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS.format(a='a.embedding', b='b.embedding')} >= 0.3")
def sim_join_threshold(spark, sf_dir):
    return ann.similarity_join(table(spark, sf_dir, "embeddings"), "label", 0.3)


@query("threshold_sweep", f"WITH s AS (SELECT a.label = b.label AS same, {_COS.format(a='a.embedding', b='b.embedding')} AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id), t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]::DOUBLE[]) AS threshold) SELECT threshold, count(*) FILTER (WHERE score >= threshold AND same) AS correct, count(*) FILTER (WHERE score >= threshold AND NOT same) AS wrong, count(*) FILTER (WHERE score < threshold AND same) AS missed FROM s, t GROUP BY 1")
def threshold_sweep(spark, sf_dir):
    return ann.threshold_counts(table(spark, sf_dir, "embeddings"), "label", [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7])


@query("top1_margin", f"WITH s AS (SELECT a.vec_id AS q, a.label = b.label AS same, {_COS.format(a='a.embedding', b='b.embedding')} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), m AS (SELECT q, max(score) FILTER (WHERE same) AS gold, max(score) FILTER (WHERE NOT same) AS other FROM s GROUP BY 1) SELECT count(*) AS queries, round(avg(CASE WHEN gold > other THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(gold - other), 6) AS margin FROM m")
def top1_margin(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    same = F.col("label") == F.col("ql")

    def best(pairs):
        return pairs.groupBy("query_id").agg(F.max(F.when(same, F.col("score"))).alias("gold"), F.max(F.when(~same, F.col("score"))).alias("other"))

    m = ann.labelled_scores(v.where("vec_id % 20 = 0"), v, "label", best)
    if m is None:
        m = spark.createDataFrame([], "query_id long, gold double, other double")
    return m.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce((F.col("gold") > F.col("other")).cast("double"), F.lit(0.0))), 6).alias("top1"), F.round(F.avg(F.col("gold") - F.col("other")), 6).alias("margin"))


@query("ann_lsh")
def ann_lsh(spark, sf_dir):
    """Approximate twin of knn_batch."""
    v = table(spark, sf_dir, "embeddings")
    return ann.lsh_knn(v.where("vec_id % 20 = 0"), v, 5)


@query("vector_literal", "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: CAST(CAST(x AS DECIMAL(12, 6)) AS VARCHAR)), ',') || ']' AS literal FROM embeddings")
def vector_literal(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.literal(F.col("embedding")).alias("literal"))


@query("ann_ivf")
def ann_ivf(spark, sf_dir):
    """Approximate twin of knn_batch from an index in partitions, written and then searched."""
    v, path = table(spark, sf_dir, "embeddings"), scratch(spark, "ivf")
    cells = max(4, min(1024, round(v.count() ** 0.5)))
    ivf.write_index(v, path, cells)
    return ivf.search(spark, path, v.where("vec_id % 20 = 0"), 5, max(3, cells // 4))


@query("semantic_cache", f"WITH p AS (SELECT a.vec_id, b.vec_id AS answer_id, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id), w AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, answer_id DESC) AS r FROM p WHERE score >= 0.35) SELECT e.vec_id, w.vec_id IS NOT NULL AS hit, answer_id, score FROM embeddings e LEFT JOIN w ON e.vec_id = w.vec_id AND r = 1")
def semantic_cache(spark, sf_dir):
    """Each question in the order of ids: whether an earlier one is near enough to answer it, and which is nearest."""
    v = table(spark, sf_dir, "embeddings")
    found = ivf.earlier_within(v, 0.35)
    return v.select("vec_id").join(found, "vec_id", "left").select("vec_id", F.col("answer_id").isNotNull().alias("hit"), "answer_id", "score")


@query("cache_saving", f"WITH p AS (SELECT a.vec_id, max(round({_COS.format(a='a.embedding', b='b.embedding')}, 6)) AS score FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id GROUP BY 1), t AS (SELECT unnest([0.35, 0.4, 0.5]::DOUBLE[]) AS threshold) SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS hits, (SELECT count(*) FROM embeddings) - count(*) FILTER (WHERE score >= threshold) AS calls FROM p, t GROUP BY 1")
def cache_saving(spark, sf_dir):
    """How many calls a semantic cache saves at each threshold, from one pass at the least of them."""
    v, grid = table(spark, sf_dir, "embeddings"), [0.35, 0.4, 0.5]
    found = ivf.earlier_within(v, min(grid)).select("score", F.explode(F.array(*map(F.lit, grid))).alias("threshold"))
    n = v.count()
    return found.groupBy("threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("hits")).withColumn("calls", F.lit(n) - F.col("hits"))
