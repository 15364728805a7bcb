"""Exact top-k search as a Voronoi kNN join.

The highest inner products of a query are its nearest neighbours once every candidate gets one more component,
sqrt(M - |v|^2) with M the largest |v|^2, and queries get 0 there. Candidates and queries are grouped by the nearest
of ``PIVOTS`` candidates. Summaries of a candidate group are its count, its extreme distances to the pivot and its
k + 1 smallest; those of a query group its count and largest distance. They give each query group a bound on the
distance of its k-th neighbour (k + 1, as one may be the query itself), and by the triangle inequality a band of
distances to each pivot outside of which no candidate can be a neighbour. Small query groups share a block, large ones
are cut into several, and only candidates inside the band of one of its groups are replicated to a block, where
queries meet blocks of candidates; the best k of each are merged. README has the share of candidates replicated.

Components are floor(64 x) as integers; scores are exact: single precision is used only while every sum stays below
2^24, double below 2^53, 64-bit integers below 2^63, and Python's integers beyond. Candidates are cut into blocks by
hash of the id, whatever the groups' size, so one frequent vector or one large group makes many tasks.

Defined cases: a vector that is null or holds a null, NaN or infinity takes no part, nor does a null id, nor a vector
whose squared length is beyond a double; every row is a candidate of every other row, so rows that repeat an id are
searched and found each, and equal rows are found as often as they occur; ties go to the smaller vec_id; shorter
vectors are padded with zeros; a score beyond 64 bits is the largest or smallest of them; fewer than k candidates
give fewer rows; an empty table gives none; other columns are ignored. Only pivots and summaries (their number is
fixed) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinlode.llm.common import stash, table

K, PIVOTS, SCALE = 20, 16, 64
#: Candidates and queries per block.
ROWS, QUERIES = 8192, 1024
SLACK = 1e-6


def _ints(v: list) -> np.ndarray | None:
    if v is None or any(x is None for x in v):
        return None
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * np.asarray(v, float))
        if not np.isfinite((x**2).sum()):
            return None
    return x.astype(np.int32) if (np.abs(x) < 2**31).all() else x


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [_ints(v) for v in batch.column("embedding").to_pylist()]
        good = pa.array([i for i, v in enumerate(made) if v is not None], pa.int32())
        own = [v for v in made if v is not None]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(good), batch.column("query").take(good), pa.array([v.tobytes() for v in own], pa.binary()), pa.array([float((v.astype(float) ** 2).sum()) for v in own], pa.float64()), pa.array([len(v) for v in own], pa.int32())],
            names=["vec_id", "query", "v", "norm", "dim"],
        )


def _matrix(blobs, dims, dim: int) -> np.ndarray:
    """Rows of integers, as doubles if one is beyond 32 bits."""
    rows = [np.frombuffer(b, np.int32 if len(b) == 4 * n else np.float64) for b, n in zip(blobs, dims)]
    out = np.zeros((len(rows), dim), np.int32 if all(r.dtype == np.int32 for r in rows) else np.float64)
    for o, row in zip(out, rows):
        o[: len(row)] = row
    return out


def products(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = max(1, q.shape[1]) * float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(s.astype(float)).max(initial=0))
    if most < 2**62:
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        return (q.astype(kind) @ s.astype(kind).T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(s).T, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, times: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, each as often as ``times`` says."""
    keep = np.flatnonzero(times > 0)
    if len(keep) > k:
        part = scores[keep]
        least = np.partition(part, len(part) - k)[len(part) - k]
        keep = keep[part >= least]
    keep = keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.repeat(keep, np.minimum(times[keep], k))[:k]


def knn_join(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null").select("vec_id", is_query.alias("query"), "embedding")
    ready = rows.mapInArrow(_clean, "vec_id long, query boolean, v binary, norm double, dim int")
    ready = ready.groupBy("vec_id", "query", "v", "norm", "dim").agg(F.count(F.lit(1)).alias("times"))  # equal rows
    ready = stash(ready, "vectors")
    facts = ready.agg(F.max("norm").alias("norm"), F.max("dim").alias("dim"), F.sum("times").alias("n")).first()
    out_schema = "query_id long, rank int, vec_id long, score long"
    if not facts.n:
        return spark.createDataFrame([], out_schema)
    high, dim = facts.norm, max(facts.dim, 1)
    pivots = ready.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(PIVOTS).select("v", "dim").collect()
    centre = _matrix([r.v for r in pivots], [r.dim for r in pivots], dim).astype(float)
    centre = np.column_stack([centre, np.sqrt(np.maximum(high - (centre**2).sum(axis=1), 0))])
    between = np.sqrt(np.maximum(((centre[:, None] - centre[None]) ** 2).sum(axis=2), 0))

    def distances(v: np.ndarray, last: np.ndarray) -> np.ndarray:
        x = np.column_stack([v.astype(float), last])
        sq = (x**2).sum(axis=1)[:, None] + (centre**2).sum(axis=1)[None] - 2 * x @ centre.T
        return np.sqrt(np.maximum(sq, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v").to_pylist(), batch.column("dim").to_pylist(), dim)
            norm = batch.column("norm").to_numpy()
            d = distances(v, np.sqrt(np.maximum(high - norm, 0)))
            cell = d.argmin(axis=1)
            e = distances(v, np.zeros(len(v)))
            qcell = e.argmin(axis=1)
            n = np.arange(len(v))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("query"), batch.column("v"), batch.column("dim"), batch.column("times"), pa.array(cell, pa.int32()), pa.array(d[n, cell]), pa.array(qcell, pa.int32()), pa.array(e[n, qcell])], names=["vec_id", "query", "v", "dim", "times", "cell", "far", "qcell", "qfar"])

    placed = stash(ready.mapInArrow(assign, "vec_id long, query boolean, v binary, dim int, times long, cell int, far double, qcell int, qfar double"), "placed")
    nearest = Window.partitionBy("cell", "part").orderBy("far", "vec_id")
    # the k + 1 smallest of each hashed part first, so that no window holds a whole group
    parts = placed.select("cell", "far", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part"))
    near = parts.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1)
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("far", "vec_id"))).where(F.col("n") <= k + 1).select("cell", "far").collect()
    groups = placed.where("query").groupBy("qcell").agg(F.max("qfar").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    blocks: list[list[tuple[int, float, float]]] = []  # of queries: (group, radius, limit) of the groups that have any there
    own: dict[int, tuple[int, int]] = {}  # first block and number of blocks of a query group
    room = 0
    for g in sorted(groups, key=lambda g: g.qcell):
        tops = sorted(g.radius + between[g.qcell, r.cell] + r.far for r in near)
        limit = (tops[k] if len(tops) > k else np.inf) * (1 + SLACK) + SLACK
        chunks = -(-g.n // QUERIES)
        if g.n > room:
            blocks += [[] for _ in range(chunks)]
            room = QUERIES if chunks == 1 else 0
        own[g.qcell] = (len(blocks) - chunks, chunks)
        room -= g.n if chunks == 1 else 0
        for c in range(chunks):
            blocks[len(blocks) - 1 - c].append((g.qcell, g.radius, limit))
    sides = -(-facts.n // ROWS)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates to the blocks of queries with a group whose band holds them."""
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                cell, far = part.column("cell").to_numpy(), part.column("far").to_numpy()
                side = ((part.column("vec_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(sides)).astype(np.int32)
                for c, inside in enumerate(blocks):
                    wanted = np.zeros(len(cell), bool)
                    for g, radius, limit in inside:
                        apart = between[g][cell]
                        wanted |= np.maximum(apart - radius - far, far - apart - radius) <= limit
                    hit = np.flatnonzero(wanted)
                    rows = pa.array(hit, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), c), pa.int32()), pa.array(side[hit]), *[part.column(n).take(rows) for n in ("vec_id", "v", "dim", "times")]], names=["c", "b", "vec_id", "v", "dim", "times"])

    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        names, kinds = ["query_id", "v", "n", "vec_id", "score"], ["int64", "object", "int64", "int64", "int64"]
        out: list[tuple] = []
        if len(queries) and len(data):
            ids, times, s = data["vec_id"].to_numpy(), data["times"].to_numpy(), _matrix(data["v"], data["dim"], dim)
            place: dict[tuple, int] = {x: i for i, x in enumerate(zip(data["vec_id"], data["v"]))}
            for at in range(0, len(queries), 256):
                part = queries.iloc[at : at + 256]
                scores = products(_matrix(part["v"], part["dim"], dim), s)
                for q, v, n, row in zip(part["vec_id"], part["v"], part["times"], scores):
                    here = place.get((q, v))
                    if here is not None:  # not the query's own row
                        times[here] -= 1
                    top = best(row, ids, times, k)
                    if here is not None:
                        times[here] += 1
                    out.append((np.full(len(top), q), np.full(len(top), v, object), np.full(len(top), n), ids[top], row[top]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 5
        return pd.DataFrame({name: pd.Series(c, dtype=kind) for name, c, kind in zip(names, cols, kinds)})

    first, chunk = ([F.create_map(*[F.lit(x) for g in own for x in (g, own[g][i])])[F.col("qcell")] for i in (0, 1)] if own else [F.lit(0), F.lit(1)])
    queries = placed.where("query").select((first + F.pmod(F.xxhash64("vec_id", "v"), chunk)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("b"), "vec_id", "v", "dim", "times")
    spreaded = placed.select("vec_id", "v", "dim", "times", "cell", "far").mapInArrow(spread, "c int, b int, vec_id long, v binary, dim int, times long")
    found = queries.groupBy("c", "b").cogroup(spreaded.groupBy("c", "b")).applyInPandas(solve, "query_id long, v binary, n long, vec_id long, score long")
    order = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    top = top.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n")))  # equal queries have equal results
    return top.select("query_id", "rank", "vec_id", "score")


def op3_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), p AS (
  SELECT q.rid, q.vec_id AS query_id, s.vec_id, list_inner_product(q.e, s.e)::BIGINT AS score
  FROM v q JOIN v s ON q.vec_id % 20 = 0 AND s.rid <> q.rid
), r AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
