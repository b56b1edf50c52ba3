"""Graph retrieval and hybrid retrieval of many questions at once: facts in words, passages, fusion, fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut, small
from . import graph as G
from . import retrieve as R
from .store import top_n_per

#: How a relation reads; others read as their own words in small letters.
PHRASES = {
    "CEO_OF": "is the CEO of",
    "FOUNDED": "founded",
    "WORKS_AT": "works at",
    "PREVIOUSLY_WORKED_AT": "previously worked at",
    "BOARD_MEMBER_OF": "sits on the board of",
    "INVESTED_IN": "has invested in",
    "ACQUIRED": "acquired",
    "PARTNERS_WITH": "partners with",
    "COMPETES_WITH": "competes with",
    "SUPPLIES": "supplies",
    "DEVELOPS": "develops",
    "USES": "uses",
    "OPERATES_IN": "operates in",
    "BASED_ON": "is based on",
    "HEADQUARTERED_IN": "is headquartered in",
}


def phrase(relation: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    return F.coalesce(known[relation], F.lower(F.translate(relation, "_", " ")))


def one_hop_words(source: Column, relation: Column, target: Column) -> Column:
    return F.concat(source, F.lit(" "), phrase(relation), F.lit(" "), target, F.lit("."))


def two_hop_words(start: Column, first: Column, middle: Column, second: Column, end: Column) -> Column:
    return F.concat(start, F.lit(" "), phrase(first), F.lit(" "), middle, F.lit(", which "), phrase(second), F.lit(" "), end, F.lit("."))


def _named(df: DataFrame, names: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the names of the nodes in the given columns. Names are read once, those of these nodes alone."""
    rows, ids = cut(df), None
    for column in columns:
        own = rows.select(F.col(column).alias("entity_id"))
        ids = own if ids is None else ids.union(own)
    some = small(names.join(small(ids.distinct()), "entity_id"))
    for column, name in columns.items():
        rows = rows.join(some.select(F.col("entity_id").alias(column), F.col("name").alias(name)), column)
    return rows


def graph_facts(linked: DataFrame, edges: G.Edges, nodes: DataFrame, limit: int = 25) -> DataFrame:
    """question_id, rank, statement, hops, between, relation_path, entities, chunk_ids, covered and score of each question's facts.

    `linked` has question_id, position and entity_id. All its entities give their edges, 4 * limit each; each
    pair of a question gives its shared neighbours, and an entity that is alone its paths of two edges, `limit`
    each. What is cut is last by confidence, then by ids. Facts are ranked by rank_facts(), statements once.
    What is cut is cut once an entity or pair, before questions are joined to it. Edges may be a function, see graph.edges_at().
    """
    names = nodes.select("entity_id", "name")
    asked = small(linked.select("question_id", "position", "entity_id"))
    known = small(asked.select("entity_id").distinct())
    own = G.edges_at(edges, known)
    ends = [own.select(F.col(f"{end}_id").alias("entity_id"), "source_id", "relation", "target_id", "chunk_ids", "confidence") for end in ("source", "target")]
    near = known.join(ends[0], "entity_id").unionByName(known.join(ends[1].where("source_id <> target_id"), "entity_id"))
    near = asked.join(top_n_per(near, ["entity_id"], [F.desc_nulls_last("confidence"), "source_id", "relation", "target_id"], 4 * limit), "entity_id")
    near = _named(near, names, {"source_id": "s", "target_id": "t"})
    facts = near.select("question_id", one_hop_words(F.col("s"), F.col("relation"), F.col("t")).alias("statement"), F.lit(1).alias("hops"), F.lit(False).alias("between"), F.array("relation").alias("relation_path"), F.array("s", "t").alias("entities"), "chunk_ids", "confidence")

    left, right = asked.withColumnRenamed("entity_id", "start"), asked.select("question_id", F.col("position").alias("_p"), F.col("entity_id").alias("end"))
    pairs = left.join(right, "question_id").where("position < _p").select("question_id", "start", "end")  # a question links few entities
    shared = top_n_per(G.shared_neighbour(own, pairs), ["start", "end"], ["relation_1", "middle", "relation_2"], limit).join(pairs, ["start", "end"])
    shared = shared.select("question_id", F.col("start").alias("a"), "relation_1", F.col("middle").alias("b"), "relation_2", F.col("end").alias("c"), "chunk_ids", F.lit(True).alias("between"))

    alone = asked.groupBy("question_id").agg(F.count("*").alias("n"), F.first("entity_id").alias("node_0")).where("n = 1").select("question_id", "node_0")
    paths = G.first_two_hop(edges, alone.select(F.col("node_0").alias("entity_id")), limit).join(alone, "node_0")
    paths = paths.select("question_id", F.col("node_0").alias("a"), "relation_1", F.col("node_1").alias("b"), "relation_2", F.col("node_2").alias("c"), "chunk_ids", F.lit(False).alias("between"))

    far = _named(shared.unionByName(paths), names, {"a": "x", "b": "y", "c": "z"})
    far = far.select("question_id", two_hop_words(F.col("x"), F.col("relation_1"), F.col("y"), F.col("relation_2"), F.col("z")).alias("statement"), F.lit(2).alias("hops"), "between", F.array("relation_1", "relation_2").alias("relation_path"), F.array("x", "y", "z").alias("entities"), "chunk_ids", F.lit(None).cast("double").alias("confidence"))

    wanted = small(asked.join(names, "entity_id")).groupBy("question_id").agg(F.collect_set(T.normalize_name(F.col("name"))).alias("_w"))
    touched = F.transform("entities", lambda x: T.normalize_name(x))
    every = facts.unionByName(far).join(wanted, "question_id").withColumn("covered", F.size(F.array_intersect("_w", touched))).drop("_w")
    return R.rank_facts(every, limit)


def first_occurrence(rows: DataFrame, by: str, item: str, order: list[str]) -> DataFrame:
    """by, item, rank: the distinct items of each group, in the order in which they first occur."""
    first = rows.groupBy(by, item).agg(F.min(F.struct(*order)).alias("_o"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("_o", item))).drop("_o")


def hybrid(questions: DataFrame, linked: DataFrame, edges: G.Edges, nodes: DataFrame, passages: DataFrame, limit: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, passages, facts) of questions (question_id, question) and their vector passages (question_id, chunk_id, rank).

    answers: question_id, route, confidence, entities (linked), n_facts and fallback: a graph route that found
    no fact. Passages always stay. Unless the route is vector, facts (3 * limit, cut to limit at last) and
    passages are put in order by the fused ranks of the chunks they point at; ties keep the order they had.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    counted = linked.groupBy("question_id").agg(F.count("*").cast("int").alias("entities"))
    routed = R.route(questions.join(counted, "question_id", "left").withColumn("entities", F.coalesce("entities", F.lit(0)))).drop("fallback")
    fused = routed.where("route <> 'vector'").select("question_id")
    facts = cut(graph_facts(linked.join(fused, "question_id", "left_semi"), edges, nodes, 3 * limit))
    chunks = facts.select("question_id", "rank", F.posexplode("chunk_ids").alias("at", "item"))
    lists = passages.join(fused, "question_id", "left_semi").select("question_id", F.lit("vector").alias("list"), F.col("chunk_id").alias("item"), "rank").unionByName(first_occurrence(chunks, "question_id", "item", ["rank", "at"]).select("question_id", F.lit("graph").alias("list"), "item", "rank"))
    scores = R.rrf(lists)

    place = Window.partitionBy("question_id").orderBy(F.desc("_s"), "rank")
    hits = passages.join(scores.select("question_id", F.col("item").alias("chunk_id"), F.col("score").alias("_s")), ["question_id", "chunk_id"], "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    hits = hits.select("question_id", F.row_number().over(place).alias("position"), "chunk_id").where(F.col("position") <= limit)

    best = chunks.join(scores, ["question_id", "item"]).groupBy("question_id", "rank").agg(F.max("score").alias("best"))
    order = Window.partitionBy("question_id").orderBy(F.desc("best"), "hops", "rank")
    told = facts.join(best, ["question_id", "rank"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    told = told.select("question_id", F.row_number().over(order).alias("position"), "statement", "hops", "best", "chunk_ids").where(F.col("position") <= limit)

    found = told.groupBy("question_id").agg(F.count("*").alias("n_facts"))
    answers = routed.select("question_id", "route", "confidence", "entities").join(found, "question_id", "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))
    return answers.withColumn("fallback", (F.col("route") == "graph") & (F.col("n_facts") == 0)), hits, told
