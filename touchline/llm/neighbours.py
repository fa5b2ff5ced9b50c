"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected to a few dimensions by a Gaussian (2-stable) matrix, so
the squared projected distance of two points over their squared distance
follows a chi-square law.  A task indexes blocks of its rows with a kd-tree
over the projections and, for each query, verifies points on the original
vectors in order of projected distance, leaf by leaf, until the chi-square
test holds: a point that would still enter the result has been missed with
probability ``1 - confidence`` at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.tables import staged

DIMS = 8                  # projected dimensions (even)
LEAF = 48                 # points of a leaf
INDEX_ROWS = 1 << 16      # rows of one kd-tree
QUERY_BLOCK = 1 << 15     # queries of one pass over the rows
SCHEMA = "query_id bigint, vec_id bigint, score double"


def chi_square_quantile(p: float, m: int) -> float:
    """``x`` with P(chi-square of ``m`` degrees <= x) = ``p``, for even ``m``."""
    lo, hi = 0.0, 1e3
    for _ in range(200):
        x = (lo + hi) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        lo, hi = (x, hi) if below < p else (lo, x)
    return hi


class KdTree:
    """Leaves of a kd-tree as runs of reordered points with bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(points))
        self.start, low, high, todo = [], [], [], [(0, len(points))]
        while todo:
            lo, hi = todo.pop()
            part = points[order[lo:hi]]
            a, b = part.min(axis=0), part.max(axis=0)
            if hi - lo <= leaf:
                self.start.append((lo, hi))
                low.append(a)
                high.append(b)
                continue
            # Halves by rank, so points that coincide are split as well.
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(part[:, np.argmax(b - a)], mid)]
            todo += [(lo, lo + mid), (lo + mid, hi)]
        self.order, self.low, self.high = order, np.array(low), np.array(high)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Least squared distance of a point to every leaf's box."""
        return np.square(np.maximum(0, np.maximum(self.low - q, q - self.high))).sum(axis=1)


def projection(dim: int, m: int = DIMS, seed: int = 23) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, m))


def search_block(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int,
                 confidence: float, best: list) -> int:
    """Improve ``best[i] = (distances, ids)`` of every query by a block of
    vectors; returns the number of verified points."""
    a = projection(x.shape[1])
    p, pq = x @ a, q @ a
    tree = KdTree(p)
    x, ids = x[tree.order], ids[tree.order]
    limit = chi_square_quantile(confidence, DIMS)
    # Equal vectors may project a rounding error apart.
    slack = 1e-12 * float(np.square(p).sum(axis=1).max(initial=0) + 1)
    verified = 0
    for i in range(len(q)):
        bound = tree.bounds(pq[i])
        order = np.argsort(bound, kind="stable")
        dist, near = best[i]
        at, step = 0, 4
        while at < len(order):
            if len(dist) == k and bound[order[at]] > limit * dist[-1] ** 2 + slack:
                break
            take = order[at:at + step]
            rows = np.concatenate([np.arange(*tree.start[j]) for j in take])
            rows = rows[ids[rows] != q_ids[i]]
            d = np.sqrt(np.square(x[rows] - q[i]).sum(axis=1))
            verified += len(rows)
            if len(dist) == k:
                use = d <= dist[-1]
                rows, d = rows[use], d[use]
            dist, near = np.concatenate((dist, d)), np.concatenate((near, ids[rows]))
            first = np.lexsort((near, dist))[:k]
            dist, near = dist[first], near[first]
            at += step
            step = min(step * 2, 64)
        best[i] = (dist, near)
    return verified


def _vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that take part."""
    col = batch.column(1)
    size = pc.list_value_length(col).fill_null(-1).to_numpy()
    ok = (size == dim) & ~np.array(batch.column(0).is_null())
    rows = pa.array(np.flatnonzero(ok))
    flat = col.take(rows).flatten()
    v = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy().reshape(-1, dim)
    good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
    return batch.column(0).take(rows).to_numpy()[good], v[good]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding", confidence: float = 0.99) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found of every
    query, by Euclidean distance in double precision, nearest first, ties to
    the smaller id; all candidates if there are fewer.

    Queries are rows of the same form; a row with a query's id is its own and
    no candidate.  Rows with a null id, and vectors that are null, zero, of
    another length than the table's commonest, or hold null or non-finite
    components take no part.  Rows that repeat an id count once per row among
    the candidates and once among the queries, there with the smallest of its
    vectors in order.  Queries come in blocks of ``QUERY_BLOCK``, one pass over
    the rows each; if there are several, queries and each pass's result are
    staged, so the driver holds one block at a time.
    """
    src = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"),
                         F.col(vector_col).cast("array<double>").alias("v"))
    asked = queries.select(F.col(id_col).cast("bigint").alias("vec_id"),
                           F.col(vector_col).cast("array<double>").alias("v"))
    sizes = (src.filter("v is not null").groupBy(F.size("v").alias("d")).count()
             .orderBy(F.desc("count"), "d").first())
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    empty = vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    found = empty
    if sizes is not None and sizes["d"] > 0:
        dim = sizes["d"]
        good = ((F.size("v") == dim) & F.col("vec_id").isNotNull()
                & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e)
                           & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0))
        asked = asked.filter(good).groupBy("vec_id").agg(F.min("v").alias("v"))
        n = asked.count()
        blocks = -(-n // QUERY_BLOCK)
        asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        if blocks > 1:
            asked = staged(asked, "queries")
        for b in range(blocks):
            part = asked.filter(F.col("block") == b).collect()
            q_ids = np.array([r["vec_id"] for r in part], np.int64)
            q = np.array([r["v"] for r in part], np.float64).reshape(-1, dim)

            def run(batches, q_ids=q_ids, q=q):
                best = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
                held, rows = [], 0

                def flush():
                    ids = np.concatenate([h[0] for h in held])
                    x = np.concatenate([h[1] for h in held])
                    held.clear()
                    if len(ids):
                        search_block(ids, x, q_ids, q, k, confidence, best)

                for batch in batches:
                    held.append(_vectors(batch, dim))
                    rows += len(held[-1][0])
                    if rows >= INDEX_ROWS:
                        flush()
                        rows = 0
                if held:
                    flush()
                n = np.array([len(d) for d, _ in best], np.int64)
                if n.sum():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([i for _, i in best])),
                         pa.array(np.concatenate([d for d, _ in best]))], schema=schema)

            near = src.mapInArrow(run, SCHEMA)
            found = found.union(staged(near, "near") if blocks > 1 else near)
    # At most k rows of a query come from each task.
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
