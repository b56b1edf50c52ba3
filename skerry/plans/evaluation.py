"""Retrieval evaluation, rater agreement, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import overlap as L
from ..operators import report
from ..operators import retrieve as R
from ..session import cut
from ..sources.tables import table
from . import retrieval, vector
from .registry import query

_OUT = f"WITH {vector._PAIRS}, t AS (SELECT query_id, ql, list(vec_id) FILTER (WHERE rank <= 5) AS found, list(vec_id) FILTER (WHERE ql = bl) AS gold FROM r GROUP BY 1, 2), o AS (SELECT query_id, ql AS category, CASE WHEN gold IS NULL THEN 1.0 ELSE len(list_intersect(found, gold)) / len(gold)::DOUBLE END AS recall, gold IS NULL OR len(list_intersect(found, gold)) > 0 AS hit, (query_id * 7 % 101)::DOUBLE AS latency FROM t)"


def outcomes(spark, sf_dir):
    """query_id, category, recall, hit, latency of each query vector; gold are its label's other vectors."""
    v = table(spark, sf_dir, "embeddings")
    found = vector.knn(spark, sf_dir).groupBy("query_id").agg(F.collect_list("vec_id").alias("found"))
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("category"))
    gold = q.join(v.select("vec_id", F.col("label").alias("category")), "category").where("vec_id <> query_id").groupBy("query_id").agg(F.collect_list("vec_id").alias("gold"))
    rows = q.join(found, "query_id").join(gold, "query_id", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<long>")))
    return rows.select("query_id", "category", E.recall(F.col("found"), F.col("gold")).alias("recall"), E.hit(F.col("found"), F.col("gold")).alias("hit"), (F.col("query_id") * 7 % 101).cast("double").alias("latency"))


@query("document_recall", _OUT + " SELECT query_id, round(recall, 6) AS recall, hit FROM o")
def document_recall(spark, sf_dir):
    return outcomes(spark, sf_dir).select("query_id", F.round("recall", 6).alias("recall"), "hit")


@query("summary_by_category", _OUT + " SELECT category, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS hit_rate, median(latency) AS latency FROM o GROUP BY GROUPING SETS ((category), ())")
def summary_by_category(spark, sf_dir):
    return outcomes(spark, sf_dir).rollup("category").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.median("latency").alias("latency"))


#: Both modes' ranked items of the same questions: vector search, and its fusion with what the labels' graph gives.
_MODES = retrieval._RRF + ", o AS (SELECT question_id, item, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 8) DESC, item) AS rank FROM s), i AS (SELECT 'vector' AS mode, query_id AS question_id, vec_id AS item FROM r WHERE rank <= 5 UNION ALL SELECT 'hybrid', question_id, item FROM o WHERE rank <= 5), qs AS (SELECT vec_id AS question_id, label AS category FROM embeddings WHERE vec_id % 20 = 0{some}), gs AS (SELECT q.question_id, v.vec_id AS item FROM qs q JOIN embeddings v ON v.label = q.category AND v.vec_id <> q.question_id), wn AS (SELECT question_id, count(*) AS wanted FROM gs GROUP BY 1), fn AS (SELECT mode, question_id, count(*) AS found FROM i JOIN gs USING (question_id, item) GROUP BY 1, 2), oc AS (SELECT qs.question_id, category, m.mode, coalesce(found, 0) AS found, coalesce(wanted, 0) AS wanted, CASE WHEN wanted IS NULL THEN 1.0::DOUBLE ELSE coalesce(found, 0) / wanted::DOUBLE END AS recall, wanted IS NULL OR coalesce(found, 0) > 0 AS hit FROM qs CROSS JOIN (SELECT unnest(['vector', 'hybrid']) AS mode) m LEFT JOIN fn ON fn.question_id = qs.question_id AND fn.mode = m.mode LEFT JOIN wn ON wn.question_id = qs.question_id)"


def _runs(spark, sf_dir, **bounds):
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("label").alias("category"))
    gold = v.select(F.col("label").alias("category"), F.col("vec_id").alias("item"))
    lists = cut(retrieval.ranked_lists(spark, sf_dir))
    fused = R.rrf(lists).withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 8)), "item")))
    return E.run_benchmark(q, gold, {"vector": lists.where("list = 'vector'"), "hybrid": fused}, **bounds)


@query("benchmark_runs", _MODES.format(some="") + " SELECT question_id, category, mode, found, wanted, round(recall, 6) AS recall, hit FROM oc")
def benchmark_runs(spark, sf_dir):
    """Each question's outcome with vector and with hybrid retrieval."""
    return _runs(spark, sf_dir).withColumn("recall", F.round("recall", 6))


@query("benchmark_filtered", _MODES.format(some=" AND label IN (1, 3, 5) ORDER BY vec_id LIMIT 7") + " SELECT mode, category, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS hit_rate FROM oc GROUP BY GROUPING SETS ((mode, category), (mode))")
def benchmark_filtered(spark, sf_dir):
    """The summary of a run over three categories and their first seven questions."""
    return E.summary(_runs(spark, sf_dir, categories=[1, 3, 5], first=7)).withColumns({"recall": F.round("recall", 6), "hit_rate": F.round("hit_rate", 6)})


@query("recall_delta", _MODES.format(some="") + ", m AS (SELECT category, avg(recall) FILTER (WHERE mode = 'vector') AS a, avg(recall) FILTER (WHERE mode = 'hybrid') AS b FROM oc GROUP BY 1) SELECT category, round(a, 6) AS vector, round(b, 6) AS hybrid, round(b - a, 6) AS delta FROM m")
def recall_delta(spark, sf_dir):
    """What hybrid retrieval adds to vector retrieval on the same questions."""
    wide = _runs(spark, sf_dir).groupBy("category").pivot("mode", ["vector", "hybrid"]).agg(F.avg("recall"))
    return wide.select("category", F.round("vector", 6).alias("vector"), F.round("hybrid", 6).alias("hybrid"), F.round(F.col("hybrid") - F.col("vector"), 6).alias("delta"))


@query("answer_contains", "SELECT conv_id, turn, contains(lower(text), 'the') AND contains(lower(text), 'on') AS ok FROM conversations")
def answer_contains(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", E.contains_all(F.col("text"), F.array(F.lit("The"), F.lit("on"))).alias("ok"))


@query("p95_nearest_rank", "SELECT event_type, list_sort(list(value))[least(count(*) - 1, CAST(floor(count(*) * 0.95) AS BIGINT)) + 1] AS p95 FROM events GROUP BY 1")
def p95_nearest_rank(spark, sf_dir):
    return E.p95_nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("median_latency", "SELECT event_type, median(value) AS median FROM events GROUP BY 1")
def median_latency(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.median("value").alias("median"))


@query("weighted_kappa", "WITH c AS (SELECT l_linenumber AS i, CAST(ceil(l_quantity / 8) AS INTEGER) AS j, count(*)::DOUBLE AS o FROM lineitem GROUP BY 1, 2), r AS (SELECT i, sum(o) AS r FROM c GROUP BY 1), s AS (SELECT j, sum(o) AS c FROM c GROUP BY 1) SELECT round(1 - (SELECT sum((i - j) * (i - j) * o) * sum(o) FROM c) / (SELECT sum((i - j) * (i - j) * r * c) FROM r, s), 6) AS kappa, (SELECT CAST(sum(o) AS BIGINT) FROM c) AS n")
def weighted_kappa(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("a"), F.ceil(F.col("l_quantity") / 8).cast("int").alias("b"))
    return E.weighted_kappa(pairs, "a", "b").select(F.round("kappa", 6).alias("kappa"), "n")


@query("label_kappa", "WITH c AS (SELECT quality AS i, toxic AS j, count(*)::DOUBLE AS o FROM labels GROUP BY 1, 2), r AS (SELECT i, sum(o) AS r FROM c GROUP BY 1), s AS (SELECT j, sum(o) AS c FROM c GROUP BY 1) SELECT round(1 - (SELECT sum((i - j) * (i - j) * o) * sum(o) FROM c) / (SELECT sum((i - j) * (i - j) * r * c) FROM r, s), 6) AS kappa, (SELECT CAST(sum(o) AS BIGINT) FROM c) AS n")
def label_kappa(spark, sf_dir):
    return E.weighted_kappa(table(spark, sf_dir, "labels"), "quality", "toxic").select(F.round("kappa", 6).alias("kappa"), "n")


@query("spearman", "WITH a AS (SELECT l_quantity AS x, l_discount AS y FROM lineitem), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM a) SELECT round(corr(rx, ry), 6) AS rho FROM k")
def spearman(spark, sf_dir):
    return E.spearman(table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount"), "l_quantity", "l_discount").select(F.round("rho", 6).alias("rho"))


@query("self_agreement", "WITH p AS (SELECT a.l_orderkey AS k, CAST(a.l_tax * 100 AS INTEGER) AS x, CAST(b.l_tax * 100 AS INTEGER) AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2) , o AS (SELECT count(*)::DOUBLE AS n, avg(CASE WHEN x = y THEN 1.0 ELSE 0 END)::DOUBLE AS a FROM p), e AS (SELECT sum(r * c) AS s FROM (SELECT x, count(*)::DOUBLE AS r FROM p GROUP BY 1) JOIN (SELECT y AS x, count(*)::DOUBLE AS c FROM p GROUP BY 1) USING (x)) SELECT CAST(n AS BIGINT) AS n, round(a, 6) AS agreement, round((a - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM o, e")
def self_agreement(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") * 100).cast("decimal(9,0)").cast("int").alias("tax"))
    a, b = line.where("l_linenumber = 1").select("l_orderkey", F.col("tax").alias("x")), line.where("l_linenumber = 2").select("l_orderkey", F.col("tax").alias("y"))
    return E.kappa(a.join(b, "l_orderkey"), "x", "y").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("flip_rate", "WITH v AS (SELECT l_orderkey AS item, l_linenumber % 2 AS position, max(l_returnflag) AS verdict FROM lineitem GROUP BY 1, 2) SELECT count(*) AS n, round(avg(CASE WHEN a.verdict <> b.verdict THEN 1.0 ELSE 0 END), 6) AS flip_rate FROM v a JOIN v b ON a.item = b.item AND a.position = 0 AND b.position = 1")
def flip_rate(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.max(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag"))).alias("a"), F.max(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_returnflag"))).alias("b"))
    return v.where("a is not null and b is not null").agg(F.count("*").alias("n"), F.round(F.avg((F.col("a") != F.col("b")).cast("double")), 6).alias("flip_rate"))


@query("length_bias", "SELECT round(corr(n_chars, quality), 6) AS bias, count(*) AS n FROM documents JOIN labels USING (doc_id)")
def length_bias(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").agg(F.round(F.corr("n_chars", "quality"), 6).alias("bias"), F.count("*").alias("n"))


@query("self_preference", "SELECT l_linestatus AS judge, l_returnflag AS author, round(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0 END), 6) AS win_rate, count(*) AS n FROM lineitem GROUP BY 1, 2")
def self_preference(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("judge"), F.col("l_returnflag").alias("author")).agg(F.round(F.avg((F.col("l_quantity") > 25).cast("double")), 6).alias("win_rate"), F.count("*").alias("n"))


@query("stratified_sample", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents) WHERE n <= 20")
def stratified_sample(spark, sf_dir):
    return E.stratified_sample(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 20)


@query("regression_gate", "WITH b AS (SELECT event_type, avg(value) FILTER (WHERE event_id % 2 = 0) AS x, avg(value) FILTER (WHERE event_id % 2 = 1) AS y FROM events GROUP BY 1) SELECT event_type, round(y - x, 6) AS change, y - x >= CASE WHEN event_type = 'error' THEN 0 ELSE -0.5 END AS passed FROM b")
def regression_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = [e.where(F.col("event_id") % 2 == k).groupBy("event_type").agg(F.avg("value").alias("score")) for k in (0, 1)]
    return E.regression_gate(*side, "event_type", "score", 0.5, ["error"]).withColumn("change", F.round("change", 6))


@query("top_disagreements", "SELECT l_orderkey, l_linenumber, abs(l_quantity - l_tax * 500) AS gap FROM lineitem ORDER BY round(gap, 6) DESC, l_orderkey, l_linenumber LIMIT 20")
def top_disagreements(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.abs(F.col("l_quantity") - F.col("l_tax") * 500).alias("gap")).orderBy(F.desc(F.round("gap", 6)), "l_orderkey", "l_linenumber").limit(20)


@query("metric_thresholds", "SELECT l_returnflag AS metric, count(*) AS n, count(*) FILTER (WHERE l_discount >= 0.05) AS passed, round(avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0 END), 6) AS pass_rate FROM lineitem GROUP BY 1")
def metric_thresholds(spark, sf_dir):
    ok = F.col("l_discount") >= 0.05
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("metric")).agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"), F.round(F.avg(ok.cast("double")), 6).alias("pass_rate"))


@query("ngram_overlap", "WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), p AS (SELECT a.item_id AS a_id, b.item_id AS b_id, list_distinct(a.w) AS x, list_distinct(b.w) AS y FROM w a JOIN w b ON b.item_id = a.item_id + 1) SELECT a_id, b_id, round(len(list_intersect(x, y)) / len(x)::DOUBLE, 6) AS precision, round(len(list_intersect(x, y)) / len(y)::DOUBLE, 6) AS recall FROM p")
def ngram_overlap(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split("text", " ")).alias("w"))
    p = w.select(F.col("item_id").alias("a_id"), F.col("w").alias("x"), (F.col("item_id") + 1).alias("b_id")).join(w.select(F.col("item_id").alias("b_id"), F.col("w").alias("y")), "b_id")
    both = F.size(F.array_intersect("x", "y"))
    return p.select("a_id", "b_id", F.round(both / F.size("x"), 6).alias("precision"), F.round(both / F.size("y"), 6).alias("recall"))


_TURNS = "pr AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2), tk AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(coalesce(x, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS x, list_filter(string_split_regex(lower(coalesce(y, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS y FROM pr), gm AS (SELECT conv_id, turn, n, 0 AS s, unnest(list_transform(range(1, len(x) - n + 2), lambda i: array_to_string(x[i:i + n - 1], ' '))) AS g FROM tk, (SELECT unnest([1, 2, 3, 4]) AS n) UNION ALL SELECT conv_id, turn, n, 1, unnest(list_transform(range(1, len(y) - n + 2), lambda i: array_to_string(y[i:i + n - 1], ' '))) FROM tk, (SELECT unnest([1, 2, 3, 4]) AS n)), ct AS (SELECT conv_id, turn, n, g, count(*) FILTER (WHERE s = 0) AS c, count(*) FILTER (WHERE s = 1) AS r FROM gm GROUP BY 1, 2, 3, 4), cl AS (SELECT conv_id, turn, n, sum(least(c, r)) AS m, sum(c) AS c, sum(r) AS r FROM ct GROUP BY 1, 2, 3), pc AS (SELECT *, CASE WHEN c > 0 THEN m / c::DOUBLE ELSE 0 END AS p, CASE WHEN r > 0 THEN m / r::DOUBLE ELSE 0 END AS q FROM cl)"


def turn_pairs(spark, sf_dir):
    """conv_id, turn, x, y: each turn beside the same speaker's next one, in which it counts as the candidate."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return c.withColumnRenamed("text", "x").join(c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("y")), ["conv_id", "turn"])


@query("rouge_n", f"WITH {_TURNS} SELECT conv_id, turn, n, CAST(m AS BIGINT) AS matched, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM pc")
def rouge_n(spark, sf_dir):
    f = L.rouge_n(L.clipped(turn_pairs(spark, sf_dir), ["conv_id", "turn"], "x", "y"))
    return f.select("conv_id", "turn", "n", "matched", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("bleu", f"WITH {_TURNS}, lg AS (SELECT conv_id, turn, sum(CASE WHEN m > 0 THEN ln(m / c::DOUBLE) END) AS l, count(CASE WHEN m > 0 THEN 1 END) AS k, max(c) FILTER (WHERE n = 1)::DOUBLE AS c, max(r) FILTER (WHERE n = 1)::DOUBLE AS r FROM cl GROUP BY 1, 2), bv AS (SELECT *, CASE WHEN c = 0 THEN 0.0 WHEN c >= r THEN 1.0 ELSE exp(1 - r / c) END::DOUBLE AS b FROM lg) SELECT conv_id, turn, round(b, 6) AS brevity, round(CASE WHEN k = 4 THEN b * exp(l / 4) ELSE 0 END, 6) AS bleu FROM bv")
def bleu(spark, sf_dir):
    f = L.bleu(L.clipped(turn_pairs(spark, sf_dir), ["conv_id", "turn"], "x", "y"), ["conv_id", "turn"])
    return f.select("conv_id", "turn", F.round("brevity", 6).alias("brevity"), F.round("bleu", 6).alias("bleu"))


#: Places of each word in the other text, last first, make a list whose longest rising subsequence is as long as the texts' common one.
_LCS = "lcs AS (SELECT conv_id, turn, len(x) AS n, len(y) AS m, len(list_reduce(list_transform(flatten(list_transform(x, lambda w: list_reverse(list_filter(range(1, len(y) + 1), lambda j: y[j] = w)))), lambda p: [p]), lambda e, v: list_filter(e, lambda z: z < v[1]) || v || list_filter(e, lambda z: z >= v[1])[2:], []::BIGINT[])) AS common FROM tk), lp AS (SELECT *, CASE WHEN n > 0 THEN common / n::DOUBLE ELSE 0 END AS p, CASE WHEN m > 0 THEN common / m::DOUBLE ELSE 0 END AS q FROM lcs)"


@query("rouge_l", f"WITH {_TURNS}, {_LCS} SELECT conv_id, turn, CAST(common AS BIGINT) AS common, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM lp")
def rouge_l(spark, sf_dir):
    """Longest common subsequences of words."""
    f = L.rouge_l(turn_pairs(spark, sf_dir), ["conv_id", "turn"], "x", "y")
    return f.select("conv_id", "turn", "common", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("score_drift", "WITH d AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, avg(value) AS score FROM events GROUP BY 1) SELECT day, round(score, 6) AS score, round(score - lag(score) OVER (ORDER BY day), 6) AS drift FROM d")
def score_drift(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("score"))
    drift = F.col("score") - F.lag("score").over(Window.orderBy("day"))  # as many rows as days
    return d.select("day", F.round("score", 6).alias("score"), F.round(drift, 6).alias("drift"))


@query("markdown_table", "WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1) SELECT '| l_returnflag | n | quantity |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || l_returnflag || ' | ' || n || ' | ' || format('{:,.2f}', quantity) || ' |', chr(10) ORDER BY l_returnflag) AS \"table\" FROM s")
def markdown_table(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("quantity"))
    return report.markdown(s, ["l_returnflag"])


@query("document_union", "SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def document_union(spark, sf_dir):
    """Documents that either of two lists holds, once each."""
    of = {k: F.collect_set(F.when(F.col("l_returnflag") == k, F.col("l_partkey"))).alias(k) for k in ("A", "R")}
    both = table(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'R')").groupBy("l_orderkey").agg(*of.values())  # an order has few lines
    return both.select("l_orderkey", F.size(F.array_union("A", "R")).cast("long").alias("n"))
