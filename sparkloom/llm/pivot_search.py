"""Exact top-k search by inner product with a pivot table.

A vector gets one more component, the root of (largest squared length - its squared length); a query gets a
zero there. Then the largest inner product is the smallest Euclidean distance, and the distances to a set of
pivots give a lower bound of every distance by the triangle inequality. Candidates are evaluated in the order
of their largest lower bound until the bound passes the k-th best score. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.llm.common import store

CHUNK = 512


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v) with floor(scale * x) as long for each component; vectors that are null or hold null or non-finite components are left out."""
    v = F.col(vector_col)
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(~bad).select(F.col(id_col).cast("long").alias("id"),
                                      F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def matrix(lists: pa.ListArray) -> np.ndarray:
    ends = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    return values.reshape(len(lists), -1) if len(lists) else np.empty((0, 0), dtype=np.int64)


def lift(v: np.ndarray, largest: float) -> np.ndarray:
    """The additional component, as a last column."""
    rest = largest - np.einsum("ij,ij->i", v.astype(np.float64), v.astype(np.float64))
    return np.column_stack([v.astype(np.float64), np.sqrt(np.maximum(rest, 0))])


def query_distances(q: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From queries, whose additional component is zero, to the pivots: not those of the index, where the same rows are candidates."""
    return distances(np.column_stack([q.astype(np.float64), np.zeros(len(q))]), pivots)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def choose_pivots(vectors: DataFrame, n_pivots: int, sample: int, largest: float) -> np.ndarray:
    """Mutually distant vectors of a sample with the smallest hashes of their ids (at most ``sample`` rows)."""
    rows = [r["v"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    points = lift(np.array(rows, dtype=np.int64), largest)
    chosen = [0]
    nearest = distances(points, points[:1])[:, 0]
    while len(chosen) < min(n_pivots, len(points)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def pivot_table(vectors: DataFrame, pivots: np.ndarray, largest: float, label: str) -> DataFrame:
    """Stored index of all vectors: (id, v, p) with the distances to the pivots."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = distances(lift(matrix(batch.column("v")), largest), pivots)
            flat = pa.array(p.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), lists], names=["id", "v", "p"])

    return store(vectors.mapInArrow(measure, "id long, v array<long>, p array<double>"), label)


def search_block(queries: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, v: np.ndarray, p: np.ndarray, k: int, largest: float):
    """Best k of one block of vectors for each query: (query ids, ids, scores), ties to smaller ids."""
    q_ids, q, q_pivots = queries
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lengths = (q.astype(np.float64) ** 2).sum(1)
    for i in range(len(q_ids)):
        bound = np.abs(p - q_pivots[i]).max(1)  # of the distance in the lifted space
        best_ids, best = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        order = np.argsort(bound, kind="stable")
        limit = (lengths[i] + largest - bound[order] ** 2) / 2 + 1e-6 * (lengths[i] + largest) + 1  # of the inner product
        for at in range(0, len(order), CHUNK):
            if len(best) == k and limit[at] < best[-1]:
                break
            some = order[at:at + CHUNK]
            some = some[ids[some] != q_ids[i]]
            best_ids, best = np.concatenate([best_ids, ids[some]]), np.concatenate([best, v[some] @ q[i]])
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
        out.append((np.full(len(best), q_ids[i]), best_ids, best))
    return tuple(np.concatenate(c) if out else np.empty(0, dtype=np.int64) for c in zip(*out, strict=True)) if out else (np.empty(0, dtype=np.int64),) * 3


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, n_pivots: int = 32, sample: int = 2000, query_block: int = 4096,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query with all other rows.

    ``is_query`` is a condition on ``id``. Vectors that are null or hold null or non-finite components take no part; all others must have
    one length. A null id can be found by no query and asks none: it is left out. Of repeated ids none is a candidate of its own
    queries, and a repeated query row is asked once. Queries go out in blocks of ``query_block``, each of which scans the stored index once;
    every task keeps k rows for each query, so what is shuffled grows with the queries and the tasks alone.
    """
    spark = vectors.sparkSession
    numbers = integer_vectors(vectors, id_col, vector_col, scale).where(F.col("id").isNotNull())
    squared = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    largest, n_queries = numbers.agg(F.max(squared).cast("double"), F.sum(is_query.cast("long"))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n_queries:
        return empty
    pivots = choose_pivots(numbers, n_pivots, sample, largest)
    index = pivot_table(numbers, pivots, largest, "pivot-table")
    blocks = max(1, -(-n_queries // query_block))
    queries = index.where(is_query).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        rows = queries.where(F.col("block") == block).dropDuplicates(["id"]).orderBy("id").select("id", "v").toArrow()  # about query_block rows
        if not rows.num_rows:
            continue
        rows = rows.combine_chunks().to_batches()[0]
        asked = matrix(rows.column(1))
        shared = spark.sparkContext.broadcast((rows.column(0).to_numpy(), asked, query_distances(asked, pivots)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = search_block(shared.value, batch.column(0).to_numpy(), matrix(batch.column(1)), matrix(batch.column(2)), k, largest)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["query_id", "vec_id", "score"])

        best = index.mapInArrow(search, "query_id long, vec_id long, score long")
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        ranked = ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        ranked = ranked if blocks == 1 else store(ranked, "top-k")
        found = ranked if found is None else found.unionAll(ranked)
    return empty if found is None else found
