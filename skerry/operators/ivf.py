"""An inverted file over vectors: coarse centroids, a table partitioned by them, and searches that read few partitions.

Also exact joins in metric cells, for thresholds: what is within a distance of a vector lies in cells that the
triangle inequality names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

#: Vectors that centroids are fitted on, at most; what is indexed is every vector.
SAMPLE = 20_000
#: Queries that one pass sends to all executors, and rows of a cell that a task compares at once.
BLOCK, PART = 2048, 4096


def _unit(column) -> tuple[np.ndarray, np.ndarray]:
    """Rows of usable vectors, and these at length one."""
    own = [np.array(v, float) if v is not None else np.empty(0) for v in column.to_pylist()]
    dim = max(map(len, own), default=0)
    keep = [i for i, v in enumerate(own) if len(v) == dim and np.isfinite(v).all() and v.any()]
    x = np.array([own[i] for i in keep]).reshape(len(keep), dim)
    return np.array(keep, np.int64), x / np.linalg.norm(x, axis=1, keepdims=True) if len(keep) else x


def centroids(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means on at most `sample` vectors, those of least hash of their id, so that a run is like the next."""
    rows = vectors.where("embedding is not null").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    _, x = _unit(rows.column(1).combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float64())))
    if not len(x):
        return np.empty((0, 0))
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    return c


def write_index(vectors: DataFrame, path: str, cells: int = 256, sample: int = SAMPLE) -> None:
    """Index (vec_id, embedding) at `path`: `centroids`, and `lists` partitioned by cell. Null, zero and non-finite vectors stay out."""
    spark = vectors.sparkSession
    c = centroids(vectors, cells, sample)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    sent = spark.sparkContext.broadcast(c)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keep, x = _unit(part.column(1))
                cell = (x @ sent.value.T).argmax(1) if len(x) else np.empty(0, int)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), part.column(0).take(pa.array(keep)), pa.array(list(x), pa.list_(pa.float64()))], ["cell", "vec_id", "unit"])

    dealt = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "cell int, vec_id long, unit array<double>")
    dealt.repartition("cell", F.expr("pmod(hash(vec_id), 4)")).write.partitionBy("cell").parquet(f"{path}/lists")  # a hot cell is four files and tasks


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int = 12) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query (vec_id, embedding) by cosine in the `probes` cells whose centroids are nearest.

    A block of queries is sent at once; only partitions that some query of it probes are read, and a row is scored for the queries
    that probe its cell. Ties go to the smaller id; a query is not its own neighbour.
    """
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # as many as there are cells
    c = np.array([r.centroid for r in rows])
    lists, found = spark.read.schema("vec_id long, unit array<double>, cell int").parquet(f"{path}/lists"), None
    asked = queries.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").orderBy("vec_id").toLocalIterator()
    while len(c) and (block := [r for _, r in zip(range(BLOCK), asked)]):
        keep, x = _unit(pa.array([r.embedding for r in block], pa.list_(pa.float64())))
        if not len(x):
            continue
        ids = np.array([block[i].vec_id for i in keep], np.int64)
        order = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
        by_cell = {int(cell): np.flatnonzero((order == cell).any(1)) for cell in np.unique(order)}
        sent = spark.sparkContext.broadcast((ids, x, by_cell))

        def run(batches, sent=sent):
            ids, x, by_cell = sent.value
            for batch in batches:
                own, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                unit = np.array(batch.column(1).to_pylist()).reshape(batch.num_rows, -1)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for cell in np.unique(cells):
                    at, qs = np.flatnonzero(cells == cell), by_cell.get(int(cell), np.empty(0, np.int64))
                    s = x[qs] @ unit[at].T
                    if s.shape[1] > k + 1:  # ties of the last place stay
                        floor = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]
                        q, v = np.nonzero(s >= floor[:, None] - 1e-9)
                    else:
                        q, v = np.nonzero(np.ones_like(s, bool))
                    other = ids[qs[q]] != own[at[v]]
                    q, v = q[other], v[other]
                    out.append((ids[qs[q]], own[at[v]], s[q, v]))
                cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["query_id", "vec_id", "score"])

        near = lists.where(F.col("cell").isin(list(by_cell))).mapInArrow(run, "query_id long, vec_id long, score double")
        part = cut(_first(near.withColumn("score", F.round("score", 6)), k))
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found


def _first(near: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def earlier_within(vectors: DataFrame, threshold: float, cells: int = 64, part: int = PART) -> DataFrame:
    """vec_id, answer_id, score: the nearest earlier vector (smaller vec_id) with a cosine of `threshold` or more; of equals, the latest. Exact.

    Each vector has its home cell and is sent to each other cell that one within reach of it can have as home: on the
    unit sphere such a centroid is at most twice the reach farther than its own. A cell's homes are dealt to parts of about
    `part` rows, and what is sent there passes them all, so that a crowded cell is many tasks; a vector's best in each part
    leaves, never its pairs.
    """
    spark = vectors.sparkSession
    c = centroids(vectors, cells)
    if not len(c):
        return spark.createDataFrame([], "vec_id long, answer_id long, score double")
    reach, sent = float(np.sqrt(max(0.0, 2 - 2 * (threshold - 1e-6)))), spark.sparkContext.broadcast(c)

    def run(batches):
        c = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                keep, x = _unit(rows.column(1))
                apart = np.sqrt(np.maximum(0, 2 - 2 * (x @ c.T))) if len(x) else np.empty((0, len(c)))
                home = apart.argmin(1) if len(x) else np.empty(0, int)
                to = [np.flatnonzero(d <= d[h] + 2 * reach + 1e-9) for d, h in zip(apart, home)]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(keep)), pa.array(list(x), pa.list_(pa.float64())), pa.array(home, pa.int32()), pa.array(to, pa.list_(pa.int32()))], ["vec_id", "unit", "home", "cells"])

    placed = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, unit array<double>, home int, cells array<int>"))
    parts = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / F.lit(part)).cast("int").alias("parts"))  # a row for each cell
    homes = placed.join(F.broadcast(parts), placed.home == parts.cell).select("cell", F.expr("pmod(hash(vec_id), parts)").alias("part"), F.lit(0).alias("side"), "vec_id", "unit")
    asks = placed.select(F.explode("cells").alias("cell"), "vec_id", "unit").join(F.broadcast(parts), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "vec_id", "unit")
    dealt = homes.unionByName(asks).repartition("cell", "part").sortWithinPartitions("cell", "part", "side", "vec_id")

    def compare(batches):
        at, ids, held = None, np.empty(0, np.int64), np.empty((0, 0))
        for batch in batches:
            key = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            side, own, unit = batch.column(2).to_numpy(), batch.column(3).to_numpy(), np.array(batch.column(4).to_pylist()).reshape(batch.num_rows, -1)
            out: list[tuple] = []
            start = 0
            while start < len(key):
                end = start + 1
                while end < len(key) and key[end] == key[start] and side[end] == side[start]:
                    end += 1
                if key[start] != at:
                    at, ids, held = key[start], np.empty(0, np.int64), np.empty((0, unit.shape[1]))
                if not side[start]:
                    ids, held = np.concatenate([ids, own[start:end]]), np.concatenate([held, unit[start:end]])
                elif len(ids):
                    for lo in range(start, end, 512):
                        mine = own[lo : min(lo + 512, end)]
                        s = np.round(unit[lo : lo + len(mine)] @ held.T, 6)
                        s[(ids[None, :] >= mine[:, None]) | (s < threshold)] = -2
                        best = s.max(1)
                        for i in np.flatnonzero(best >= threshold).tolist():
                            out.append((int(mine[i]), int(ids[s[i] == best[i]].max()), float(best[i])))
                start = end
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["vec_id", "answer_id", "score"])

    met = dealt.mapInArrow(compare, "vec_id long, answer_id long, score double")
    best = met.groupBy("vec_id").agg(F.max(F.struct("score", "answer_id")).alias("m"))
    return best.select("vec_id", "m.answer_id", "m.score")
