"""Whitening of embeddings: exact sums and a centred covariance by Spark, its leading eigenpairs by contour integration.

Only matrices of dimension by dimension reach the driver. Vectors are integers (``floor(scale * x)``), so that sums, and with them the mean
and every deviation from it, are exact and the same in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.common import store
from sparkloom.llm.feast import leading_pairs

LIMIT = (1 << 63) - 1
MEASURED = 1e-9  # variances of the whitened data are corrected until they are this near to one


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v) of the vectors without null or non-finite components; of several lengths the commonest counts, the longer of equally common ones."""
    v = F.col(vector_col)
    clean = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = clean.select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (lengths["d"] if lengths else 0))


def matrix(lists: pa.ListArray) -> np.ndarray:
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].reshape(len(lists), -1)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, sum of each component) as whole numbers of any size: high and low halves are added up apart."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column(0))
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d)), pa.array(np.r_[0, high]), pa.array(np.r_[n, low])], names=["i", "high", "low"])

    totals = fit.select("v").mapInArrow(add_up, "i long, high long, low long").groupBy("i").agg(
        *(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")))
    sums = {r["i"]: (int(r["high"]) << 32) + int(r["low"]) for r in totals.collect()}  # d + 1 rows
    return sums.pop(-1, 0), [sums[i] for i in range(d)] if sums else []


class Centre:
    """The mean as a whole number and a fraction of at most a half, so that large means cost no digits."""

    def __init__(self, n: int, sums: list[int]):
        whole = [(2 * s + n) // (2 * n) for s in sums]
        self.whole = np.array(whole, dtype=np.int64)
        self.rest = np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])

    def apart(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest


def second_moments(rows: DataFrame, n: int, width: int, values) -> np.ndarray:
    """Sum of products of ``values(x)``, over n. A task sends one triangle; cells are added in Spark."""
    above = np.triu_indices(width)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = values(matrix(batch.column(0)))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(above[0]))), pa.array(total[above])], names=["cell", "value"])

    cells = rows.select("v").mapInArrow(add_up, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((width, width))
    for cell, value in cells:  # width squared
        i, j = above[0][cell], above[1][cell]
        out[i, j] = out[j, i] = value / n
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum((n * x - sums)^2) of each row as a whole number; None beyond 64 bits."""
    reach = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(abs(s) for s in sums)
    if reach * reach * x.shape[1] <= LIMIT:
        z = n * x - np.array(sums, dtype=np.int64)
        return np.einsum("ij,ij->i", z, z).tolist()
    z = n * x.astype(object) - np.array(sums, dtype=object)
    return [s if s <= LIMIT else None for s in (z * z).sum(1)]


def whiten(vectors: DataFrame, k: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each vector on the ``k`` leading components of the covariance.

    Mean and covariance are over the distinct integer vectors, each counted once (n of them). Vectors that are null, empty, or hold null or
    non-finite entries are left out, and so are those of another length than the commonest. Repeated rows and null ids are scored like others;
    other columns are not read. With fewer than ``k`` dimensions there are as many components. A component without variance (to double
    precision) has null for ``whitened``; without any variance ``explained`` and ``identity_error`` are null too. ``deviation`` is null beyond 64
    bits. An empty table gives no row. ``identity_error`` is measured on the whitened fit list, whose variances correct the eigenvalues where
    the matrix alone does not give them to nine digits.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col, scale)
    schema = (f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    fit = store(rows.select("v").distinct(), "fit-vectors")
    first = fit.first()
    if first is None:
        return spark.createDataFrame([], schema)
    d = len(first["v"])
    n, sums = exact_sums(fit, d)
    centre = Centre(n, sums)
    covariance = second_moments(fit, n, d, centre.apart)
    k, trace = min(k, d), float(np.trace(covariance))
    e, u = leading_pairs(covariance, k)
    real = int(np.sum(e > 4 * d * np.finfo(float).eps * max(e[0], 0.0)))
    error = None
    for _ in range(3 if real else 0):
        axes = u[:, :real] / np.sqrt(e[:real])
        # the first column stands for the mean of the whitened values, which is taken out as well
        moments = second_moments(fit, n, real + 1, lambda x, axes=axes: np.column_stack([np.ones(len(x)), centre.apart(x) @ axes]))
        found = moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:])
        error = float(np.abs(found - np.eye(real)).max())
        if error <= MEASURED:
            break
        e[:real] *= np.diag(found)
    axes = np.zeros((d, k))
    axes[:, :real] = u[:, :real] / np.sqrt(e[:real])
    explained = (np.where(np.arange(k) < real, e, 0.0) / trace).tolist() if trace > 0 else [None] * k

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            m = len(x)
            values = centre.apart(x) @ axes
            nowhere = np.tile(np.arange(k) >= real, m)
            apart = pa.array(deviations(x, n, sums), type=pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)), apart.take(pa.array(np.repeat(np.arange(m), k))), pa.array(values.ravel(), mask=nowhere),
                pa.array(explained * m, type=pa.float64()), pa.array([error] * (m * k), type=pa.float64())], names=schema_names)

    schema_names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return rows.mapInArrow(score, schema)
