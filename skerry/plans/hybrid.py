"""Graph and hybrid retrieval over the relational graph: six questions about each nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hybrid as H
from ..operators import retrieve as R
from ..sources.tables import table
from . import graph as G
from .registry import query

#: One question of each kind a route can take: two entities, a description, a count, no entity, no marker, a graph route without entity.
_ASKED = ("How is {a} connected to {b}?", "Describe {a}", "How many partners does {a} have?", "Explain how partners compete", "Is {a} large?", "Which companies compete?")


def questions(spark, sf_dir):
    """question_id, question: nation n is {a}, the one five further on, in its region, is {b}."""
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey as k", "n_name as a")
    other = n.selectExpr("(k + 20) % 25 as k", "a as b")
    text = [F.replace(F.replace(F.lit(t), F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b")) for t in _ASKED]
    return n.join(other, "k").select("k", F.posexplode(F.array(*text)).alias("type", "question")).select((F.col("k") * 6 + F.col("type")).alias("question_id"), "question")


def _linked(spark, sf_dir):
    forms = table(spark, sf_dir, "nation").selectExpr("concat('N', n_nationkey) as entity_id", "n_name as form")
    return R.link_entities(questions(spark, sf_dir), forms)


def _passages(spark, sf_dir):
    n = table(spark, sf_dir, "customer").count()
    q = questions(spark, sf_dir).select("question_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank"))
    return q.select("question_id", F.concat(F.lit("c"), (F.col("question_id") * 13 + F.col("rank") * 7) % n).alias("chunk_id"), "rank")


def _phrase(c):
    return f"CASE {c} WHEN 'SUPPLIES' THEN 'supplies' ELSE lower(replace({c}, '_', ' ')) END"


def _facts(limit):
    far = f"x.name || ' ' || {_phrase('r1')} || ' ' || y.name || ', which ' || {_phrase('r2')} || ' ' || z.name || '.'"
    return f"""{G._ASSERT.rstrip()}, {G._BI}, {G._NODES},
k AS (SELECT n_nationkey AS k, n_name AS form, 'N' || n_nationkey AS id FROM nation),
m0 AS (SELECT k * 6 + t AS question_id, form, id FROM k, (SELECT unnest([0, 1, 2, 4]) AS t) UNION ALL SELECT (k + 20) % 25 * 6, form, id FROM k),
m AS (SELECT * FROM m0 x WHERE NOT EXISTS (SELECT 1 FROM m0 y WHERE y.question_id = x.question_id AND y.form <> x.form AND contains(y.form, x.form))),
l AS (SELECT question_id, id AS entity_id, row_number() OVER (PARTITION BY question_id ORDER BY length(form) DESC, lower(form), id) - 1 AS pos FROM m),
w AS (SELECT question_id, list(lower(name)) AS wanted, count(*) AS c FROM l JOIN n USING (entity_id) GROUP BY 1),
h AS (SELECT question_id, l.entity_id, source_id, relation, target_id, chunks, confidence, row_number() OVER (PARTITION BY question_id, l.entity_id ORDER BY confidence DESC, source_id, relation, target_id) AS p FROM l JOIN e ON source_id = l.entity_id OR target_id = l.entity_id),
f1 AS (SELECT question_id, s.name || ' ' || {_phrase('relation')} || ' ' || t.name || '.' AS statement, 1 AS hops, coalesce(nullif(confidence, 0), 1)::DOUBLE AS base, [s.name, t.name] AS names, chunks FROM h JOIN n s ON s.entity_id = source_id JOIN n t ON t.entity_id = target_id WHERE p <= {4 * limit}),
pr AS (SELECT x.question_id, x.entity_id AS s, y.entity_id AS t FROM l x JOIN l y ON x.question_id = y.question_id AND x.pos < y.pos),
sh AS (SELECT question_id, x.a, x.relation AS r1, x.b, y.relation AS r2, y.a AS c, x.chunks || '|' || y.chunks AS chunks, 0.95::DOUBLE AS base, row_number() OVER (PARTITION BY question_id, s, t ORDER BY x.relation, x.b, y.relation) AS p FROM pr JOIN b x ON x.a = s JOIN b y ON y.a = t AND x.b = y.b AND x.edge <> y.edge WHERE x.b <> s AND x.b <> t),
tw AS (SELECT l.question_id, x.a, x.relation AS r1, x.b, y.relation AS r2, y.b AS c, x.chunks || '|' || y.chunks AS chunks, 0.7::DOUBLE AS base, row_number() OVER (PARTITION BY l.question_id ORDER BY x.relation, x.b, y.relation, y.b) AS p FROM l JOIN w ON l.question_id = w.question_id AND w.c = 1 JOIN b x ON x.a = l.entity_id JOIN b y ON x.b = y.a AND x.edge <> y.edge WHERE y.b <> x.a),
f2 AS (SELECT question_id, {far} AS statement, 2 AS hops, base, [x.name, y.name, z.name] AS names, chunks FROM (SELECT * FROM sh UNION ALL SELECT * FROM tw) u JOIN n x ON x.entity_id = u.a JOIN n y ON y.entity_id = u.b JOIN n z ON z.entity_id = u.c WHERE p <= {limit}),
fs AS (SELECT f.*, len(list_filter(wanted, lambda v: list_contains(list_transform(names, lambda x: lower(x)), v))) * 10 + base - hops * 0.1::DOUBLE AS score FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2) f JOIN w USING (question_id)),
fd AS (SELECT *, row_number() OVER (PARTITION BY question_id, lower(statement) ORDER BY score DESC, hops, statement) AS d FROM fs),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, hops, statement) AS rank FROM fd WHERE d = 1) WHERE rank <= {limit})"""


@query("graph_retrieve", f"WITH {_facts(25)} SELECT question_id, CAST(rank AS INTEGER) AS rank, statement, hops, round(score, 6) AS score, sha256(chunks) AS chunks FROM fr")
def graph_retrieve(spark, sf_dir):
    """Facts in words: edges of each linked nation, what two nations share, paths of two edges from one alone."""
    f = H.graph_facts(_linked(spark, sf_dir), G.edges_at(spark, sf_dir), G.nodes(spark, sf_dir), 25)
    return f.select("question_id", "rank", "statement", "hops", F.round("score", 6).alias("score"), F.sha2(F.array_join("chunk_ids", "|"), 256).alias("chunks"))


_HYBRID = f"""WITH {_facts(15)},
q AS (SELECT question_id, t, ['graph', 'vector', 'graph', 'hybrid', 'hybrid', 'graph'][t + 1] AS route, CASE WHEN t = 0 AND c = 1 THEN 0.65 ELSE [0.85, 0.75, 0.85, 0.7, 0.4, 0.85][t + 1] END::DOUBLE AS confidence FROM (SELECT k, k * 6 + t AS question_id, t FROM k, (SELECT unnest(range(6)) AS t)) LEFT JOIN w USING (question_id)),
ps AS (SELECT question_id, t, 'c' || ((question_id * 13 + r * 7) % (SELECT count(*) FROM customer)) AS item, r AS rank FROM q, (SELECT unnest(range(1, 6)) AS r)),
fg AS (SELECT fr.* FROM fr WHERE question_id % 6 <> 1),
ch AS (SELECT question_id, rank, unnest(string_split(chunks, '|')) AS item, unnest(range(len(string_split(chunks, '|')))) AS place FROM fg),
fo AS (SELECT question_id, item, row_number() OVER (PARTITION BY question_id ORDER BY o) AS rank FROM (SELECT question_id, item, min(rank * 10000000 + place) AS o FROM ch GROUP BY 1, 2)),
sc AS (SELECT question_id, item, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT question_id, item, rank FROM ps WHERE t <> 1 UNION ALL SELECT * FROM fo) GROUP BY 1, 2),
hp AS (SELECT question_id, item, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(score, 0) DESC, rank) AS position FROM ps LEFT JOIN sc USING (question_id, item)),
bf AS (SELECT question_id, rank, max(score) AS best FROM ch JOIN sc USING (question_id, item) GROUP BY 1, 2),
hf AS (SELECT * FROM (SELECT question_id, statement, row_number() OVER (PARTITION BY question_id ORDER BY best DESC, hops, rank) AS position FROM fg JOIN bf USING (question_id, rank)) WHERE position <= 5)"""


@query(
    "hybrid_answers",
    _HYBRID + " SELECT question_id, route, confidence, CAST(coalesce(c, 0) AS INTEGER) AS entities, coalesce(nf, 0) AS n_facts, route = 'graph' AND nf IS NULL AS fallback FROM q LEFT JOIN w USING (question_id) LEFT JOIN (SELECT question_id, count(*) AS nf FROM hf GROUP BY 1) USING (question_id)",
)
def hybrid_answers(spark, sf_dir):
    return _hybrid(spark, sf_dir)[0]


@query("hybrid_evidence", _HYBRID + " SELECT 'passage' AS kind, question_id, CAST(position AS INTEGER) AS position, item FROM hp UNION ALL SELECT 'fact', question_id, CAST(position AS INTEGER), statement FROM hf")
def hybrid_evidence(spark, sf_dir):
    """Fused passages and facts of each question, in their order."""
    _, hits, told = _hybrid(spark, sf_dir)
    return hits.select(F.lit("passage").alias("kind"), "question_id", "position", F.col("chunk_id").alias("item")).unionByName(told.select(F.lit("fact").alias("kind"), "question_id", "position", F.col("statement").alias("item")))


def _hybrid(spark, sf_dir):
    return H.hybrid(questions(spark, sf_dir), _linked(spark, sf_dir), G.edges_at(spark, sf_dir), G.nodes(spark, sf_dir), _passages(spark, sf_dir))


@query("routing_by_passages", _HYBRID + " SELECT route, coalesce(np, 0) AS passages, count(*) AS n, round(avg(confidence), 6) AS confidence FROM q LEFT JOIN (SELECT question_id, count(*) AS np FROM hp GROUP BY 1) USING (question_id) GROUP BY 1, 2")
def routing_by_passages(spark, sf_dir):
    """Questions by their route and by how many passages they got."""
    answers, hits, _ = _hybrid(spark, sf_dir)
    n = hits.groupBy("question_id").agg(F.count("*").alias("passages"))
    both = answers.join(n, "question_id", "left").withColumn("passages", F.coalesce("passages", F.lit(0)).cast("long"))
    return both.groupBy("route", "passages").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))
