"""Research findings and run logs: pages as sources, conversations as steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.store import top_n_per
from ..sources.tables import table
from .registry import query


@query("dedupe_url", "SELECT url, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1")
def dedupe_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query("domain_cap", "SELECT domain, page_id FROM (SELECT regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS domain, page_id, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/:]+)', 1) ORDER BY page_id) AS n FROM pages) WHERE n <= 3")
def domain_cap(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1).alias("domain"), "page_id")
    return top_n_per(p, ["domain"], ["page_id"], 3)


@query("finding_status", "SELECT l_partkey AS claim, count(DISTINCT l_suppkey) AS sources, CASE WHEN count(DISTINCT l_suppkey) >= 3 THEN 'confirmed' WHEN count(DISTINCT l_suppkey) = 2 THEN 'supported' ELSE 'single' END AS status FROM lineitem GROUP BY 1")
def finding_status(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("claim")).agg(F.count_distinct("l_suppkey").alias("sources"))
    return g.withColumn("status", F.when(F.col("sources") >= 3, "confirmed").when(F.col("sources") == 2, "supported").otherwise("single"))


@query("run_resume_state", "SELECT conv_id AS run_id, max(turn) AS last_step, arg_max(role, turn) AS state, count(*) AS steps FROM conversations GROUP BY 1")
def run_resume_state(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("run_id")).agg(F.max("turn").alias("last_step"), F.max_by("role", "turn").alias("state"), F.count("*").alias("steps"))


@query("step_trace", "SELECT conv_id AS run_id, turn AS step, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS chars_so_far FROM conversations")
def step_trace(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("step"), "role", F.lag("role").over(w).alias("previous"), F.sum(F.length("text").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("chars_so_far"))


@query("json_log", "SELECT conv_id, '{\"conv_id\":' || conv_id || ',\"turns\":' || count(*) || '}' AS line FROM conversations GROUP BY 1")
def json_log(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return g.select("conv_id", F.to_json(F.struct("conv_id", "turns")).alias("line"))


@query("tool_calls", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) = 'user>assistant' AS exact, count(DISTINCT role) AS roles FROM conversations GROUP BY 1")
def tool_calls(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("calls"))
    return g.select("conv_id", (F.col("calls") == F.array(F.lit("user"), F.lit("assistant"))).alias("exact"), F.size(F.array_distinct("calls")).cast("long").alias("roles"))
