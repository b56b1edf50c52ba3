"""Context and citations; facts are lines of orders, passages benchmark items, answers made to hit every case."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answer as A
from ..sources.tables import table
from .registry import query


def _context(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    facts = line.selectExpr("l_orderkey as question_id", "l_linenumber * 1000000 + l_partkey as position", "array(concat('p', l_partkey)) as chunk_ids", "concat('line  of part ', l_partkey % 3) as text")
    passages = table(spark, sf_dir, "orders").selectExpr("o_orderkey as question_id", "1L as position", "array(concat('o', o_orderkey)) as chunk_ids", "concat(' order by ', o_custkey) as text")
    return A.number_context(facts, passages)


_CTX = "f AS (SELECT l_orderkey AS question_id, 0 AS k, l_linenumber * 1000000 + l_partkey AS position, 'p' || l_partkey AS chunk, 'line of part ' || (l_partkey % 3) AS text, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY l_linenumber * 1000000 + l_partkey) AS rn FROM lineitem), c AS (SELECT question_id, k, position, chunk, text FROM f WHERE rn = 1 UNION ALL SELECT o_orderkey, 1, 1, 'o' || o_orderkey, 'order by ' || o_custkey FROM orders), x AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY k, position) AS marker, CASE k WHEN 0 THEN 'fact' ELSE 'passage' END AS kind, chunk, text FROM c)"


@query("context_numbering", f"WITH {_CTX} SELECT question_id, CAST(marker AS INTEGER) AS marker, kind, chunk AS chunk_ids, text FROM x")
def context_numbering(spark, sf_dir):
    return _context(spark, sf_dir).withColumn("chunk_ids", F.array_join("chunk_ids", "|"))


@query("context_block", f"WITH {_CTX} SELECT question_id, sha256(string_agg('[' || marker || '] (' || kind || ') ' || text, chr(10) ORDER BY marker)) AS block FROM x GROUP BY 1")
def context_block(spark, sf_dir):
    return A.render(_context(spark, sf_dir)).select("question_id", F.sha2("block", 256).alias("block"))


_ANSWERS = ("It is a line of that order [1]. See also [2] and [1].", "This one was never ordered [77].", "There is no marker in this long sentence.", "INSUFFICIENT_EVIDENCE", "   ", "The first is cited here [1]. The second sentence is not cited at all.", "The marker follows the stop of the sentence. [1]")


def _answers(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, _ANSWERS)), (F.floor(F.col("o_orderkey") / 10) % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), text.alias("answer"))


_ANS = f"WITH {_CTX}, a AS (SELECT o_orderkey AS question_id, [" + ", ".join(f"'{a}'" for a in _ANSWERS) + "][o_orderkey // 10 % 7 + 1] AS answer FROM orders), u AS (SELECT question_id, answer, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda m: CAST(m AS INTEGER)))) AS used FROM a), h AS (SELECT question_id, list(CAST(marker AS INTEGER)) AS have FROM x GROUP BY 1), v AS (SELECT u.*, list_filter(used, lambda m: list_contains(have, m)) AS cited, list_filter(used, lambda m: NOT coalesce(list_contains(have, m), false)) AS invalid, len(list_filter(regexp_extract_all(answer, '[^.!?]+[.!?]+(\\s*\\[\\d+\\])*'), lambda s: length(trim(s)) >= 25 AND NOT regexp_matches(s, '\\[\\d+\\]'))) AS uncited FROM u LEFT JOIN h USING (question_id))"


@query("citation_markers", _ANS + " SELECT question_id, array_to_string(used, '|') AS used FROM v")
def citation_markers(spark, sf_dir):
    return _answers(spark, sf_dir).select("question_id", F.array_join(F.array_sort(F.array_distinct(T.markers(F.col("answer")))).cast("array<string>"), "|").alias("used"))


def _validated(spark, sf_dir):
    return A.validate(_answers(spark, sf_dir), _context(spark, sf_dir))


@query("invalid_markers", _ANS + " SELECT question_id, array_to_string(invalid, '|') AS invalid FROM v WHERE len(invalid) > 0")
def invalid_markers(spark, sf_dir):
    return _validated(spark, sf_dir).where(F.size("invalid") > 0).select("question_id", F.array_join(F.col("invalid").cast("array<string>"), "|").alias("invalid"))


@query("uncited_sentences", _ANS + " SELECT question_id, CAST(uncited AS INTEGER) AS uncited FROM v")
def uncited_sentences(spark, sf_dir):
    return _validated(spark, sf_dir).select("question_id", F.size("uncited").alias("uncited"))


@query("citation_verdict", _ANS + " SELECT question_id, array_to_string(cited, '|') AS cited, CASE WHEN trim(answer) = '' OR contains(answer, 'INSUFFICIENT_EVIDENCE') THEN 'refused' WHEN len(invalid) > 0 THEN 'invalid_marker' WHEN len(cited) = 0 THEN 'no_citation' WHEN uncited > 0 THEN 'uncited_sentence' ELSE 'ok' END AS verdict FROM v")
def citation_verdict(spark, sf_dir):
    return _validated(spark, sf_dir).select("question_id", F.array_join(F.col("cited").cast("array<string>"), "|").alias("cited"), "verdict")


_VERDICT = "CASE WHEN trim({v}.answer) = '' OR contains({v}.answer, 'INSUFFICIENT_EVIDENCE') THEN 'refused' WHEN len({v}.invalid) > 0 THEN 'invalid_marker' WHEN len({v}.cited) = 0 THEN 'no_citation' WHEN {v}.uncited > 0 THEN 'uncited_sentence' ELSE 'ok' END"
#: The chain of a, u and v again, for second answers.
_AGAIN = _ANS.removeprefix(f"WITH {_CTX}, ").replace("// 10 % 7", "% 7").replace("a AS (SELECT o", "a2 AS (SELECT o", 1).replace("u AS (SELECT question_id, answer", "u2 AS (SELECT question_id, answer").replace("FROM a)", "FROM a2)").replace(" h AS (SELECT question_id, list(CAST(marker AS INTEGER)) AS have FROM x GROUP BY 1),", "").replace("v AS (SELECT u.*", "v2 AS (SELECT u2.*").replace("FROM u LEFT", "FROM u2 LEFT")


@query(
    "citation_repair",
    f"{_ANS}, {_AGAIN}, z AS (SELECT v.question_id, v.answer, v.cited, {_VERDICT.format(v='v')} AS v1, v2.answer AS a2, v2.cited AS c2, {_VERDICT.format(v='v2')} AS v2 FROM v JOIN v2 USING (question_id)), y AS (SELECT *, v1 NOT IN ('ok', 'refused') AS repaired, CASE WHEN v1 IN ('ok', 'refused') THEN v1 = 'refused' ELSE v2 <> 'ok' END AS refused FROM z) "
    "SELECT question_id, CASE WHEN refused THEN 'INSUFFICIENT_EVIDENCE' WHEN repaired THEN trim(a2) ELSE trim(answer) END AS answer, CASE WHEN repaired THEN v2 ELSE v1 END AS verdict, refused, repaired, CASE WHEN refused THEN '' ELSE array_to_string(CASE WHEN repaired THEN c2 ELSE cited END, '|') END AS cited FROM y",
)
def citation_repair(spark, sf_dir):
    """Answers after one repair at most; what still has a problem is refused."""
    second = F.element_at(F.array(*map(F.lit, _ANSWERS)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    again = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), second.alias("answer"))
    return A.settle(_answers(spark, sf_dir), again, _context(spark, sf_dir)).withColumn("cited", F.array_join(F.col("cited").cast("array<string>"), "|"))


@query("answer_segments", _ANS + " SELECT question_id, generate_subscripts(seg, 1) AS position, unnest(seg) AS segment, regexp_matches(unnest(seg), '^\\[\\d+\\]$') AS marker FROM (SELECT question_id, regexp_extract_all(answer, '\\[\\d+\\]|[^\\[]+|\\[') AS seg FROM v)")
def answer_segments(spark, sf_dir):
    """Answers split at their markers, as a page shows them: runs of text and markers in turn."""
    cut = _answers(spark, sf_dir).select("question_id", F.posexplode(T.segments(F.col("answer"))).alias("position", "segment"))
    return cut.select("question_id", (F.col("position") + 1).cast("long").alias("position"), "segment", F.col("segment").rlike(r"^\[\d+\]$").alias("marker"))


@query("trace_ids", "SELECT o_orderkey AS question_id, length(md5('trace:' || o_orderkey)) AS n, md5('trace:' || o_orderkey) AS trace_id, CAST(CASE o_orderkey % 6 WHEN 0 THEN 0.5 WHEN 1 THEN 0.9 WHEN 2 THEN 0.0 WHEN 3 THEN 1.0 WHEN 4 THEN 0.25 ELSE 0.5 END AS DOUBLE) AS confidence FROM orders")
def trace_ids(spark, sf_dir):
    """Trace ids that a question's key decides (so that a retried task gives the same), and a classifier's confidence, held to 0 and 1; 0.5 where it has none."""
    raw = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ("0.9", "-1", "7.5", "0.25", "sure"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    trace = F.md5(F.concat(F.lit("trace:"), F.col("o_orderkey").cast("string")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.length(trace).cast("long").alias("n"), trace.alias("trace_id"), T.classifier_confidence(raw).alias("confidence"))
