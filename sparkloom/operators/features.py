"""Encoders, scalers, PCA and lookups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.operators.ordered import with_ordinal
from sparkloom.operators.skew import dimension_join
from sparkloom.runtime import cut_lineage


def label_classes(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-null values with ids 0..n-1."""
    values = df.select(F.col(col).alias("value")).filter("value is not null").distinct()
    return with_ordinal(values, ["value"], name="id", derived=True).withColumn("id", F.col("id") - 1)


def label_encode(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Replace categories by ids; the class tables are returned for decoding."""
    classes = {}
    order = df.columns
    for c in cols:
        classes[c] = cut_lineage(label_classes(df, c))
        side = classes[c].select(F.col("value").alias(c), F.col("id").alias("__id"))
        df = dimension_join(df, side, c, "left", probe=True).withColumn(c, F.col("__id")).drop("__id")
    return df.select(*order), classes


def label_decode(df: DataFrame, col: str, classes: DataFrame) -> DataFrame:
    side = classes.select(F.col("id").alias(col), F.col("value").alias("__value"))
    return dimension_join(df, side, col, "left", probe=True).withColumn(col, F.col("__value")).drop("__value").select(*df.columns)


def get_dummies(df: DataFrame, cols: list[str], drop_first: bool = True, max_categories: int = 10_000) -> DataFrame:
    """0/1 column ``col_value`` per category, without the first one when ``drop_first``.

    The categories become columns, so their number must be a plan-sized one.
    """
    for c in cols:
        found = [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).limit(max_categories + 1).collect()]
        if len(found) > max_categories:
            raise ValueError(f"{c} has more than {max_categories} categories; use label_encode")
        kept = found[1:] if drop_first else found
        flags = [F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in kept]
        df = df.select(*[x for x in df.columns if x != c], *flags, F.col(c)).drop(c)
    return df


def standard_fit(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of every column, one pass."""
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def standard_scale(df: DataFrame, cols: list[str], params: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    params = params or standard_fit(df, cols)
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in params.items() if c in cols})


def minmax_fit(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("a", F.min), ("b", F.max))]).first()
    return {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(cols)}


def minmax_apply(df: DataFrame, params: dict[str, tuple[float, float]], clip: bool = False) -> DataFrame:
    """Scale to [0, 1] by fitted bounds; a constant column gives 0."""
    def scaled(c: str, lo: float, hi: float) -> Column:
        x = (F.col(c) - F.lit(lo)) / F.lit(hi - lo if hi != lo else 1.0)
        return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))) if clip else x
    return df.withColumns({c: scaled(c, lo, hi) for c, (lo, hi) in params.items()})


@dataclass
class Components:
    """``mean``; ``axes``: unit directions as columns; ``variances`` along them (divisor n - 1), falling; ``total``: that of all dimensions; ``n`` rows."""

    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    total: float
    n: int


def _rows_of(lists: pa.ListArray) -> np.ndarray:
    lists = lists.drop_null()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def _added(df: DataFrame, col: str, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of a matrix that ``part`` makes of a batch; a task sends its sum, cells are added in Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            x = _rows_of(batch.column(0))
            if len(x):
                total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    cells = df.select(F.col(col).cast("array<double>").alias("x")).mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("v"))
    out = np.zeros(shape[0] * shape[1])
    for cell, value in cells.collect():  # dimensions times components
        out[cell] = value
    return out.reshape(shape)


def pca_fit(df: DataFrame, col: str, k: int, oversample: int = 10, rounds: int = 60, tolerance: float = 1e-9, seed: int = 7) -> Components:
    """Leading ``k`` principal components by randomised subspace iteration; null vectors are left out, all others have one length.

    A round is one scan: the rows, less their mean, times a few directions and back, so that no matrix of dimensions by dimensions is made
    anywhere. Rounds end when the variances of the ``k`` components change by less than ``tolerance`` of the largest.
    """
    known = df.filter(F.col(col).isNotNull())
    size = known.select(F.size(col)).first()
    d = size[0] if size else 0
    if not d:
        return Components(np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    k = min(k, d)
    sums = _added(known, col, (1, d + 1), lambda x: np.append(x.sum(0), len(x))[None, :])[0]
    n, mean = int(sums[-1]), sums[:-1] / sums[-1]
    total = float(_added(known, col, (1, 1), lambda x: np.array([[((x - mean) ** 2).sum()]]))[0, 0]) / max(n - 1, 1)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(d, k + oversample))))[0]
    before = np.full(k, np.inf)
    for _ in range(rounds):
        image = _added(known, col, basis.shape, lambda x, basis=basis: (x - mean).T @ ((x - mean) @ basis)) / max(n - 1, 1)
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        axes = basis @ turn
        if np.abs(values[:k] - before).max() <= tolerance * max(values[0], 0.0):
            break
        before = values[:k]
        basis = np.linalg.qr(image @ turn)[0]
    axes = axes[:, :k]
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    return Components(mean, axes * np.where(signs == 0, 1, signs), np.maximum(values[:k], 0), total, n)


def pca_apply(df: DataFrame, col: str, fitted: Components, name: str = "pc") -> DataFrame:
    """Adds the coordinates on the components; a null vector has none."""
    mean, axes = fitted.mean, fitted.axes

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        known = vectors.notna()
        out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
        if known.any():
            out[known] = pd.Series(list((np.stack(vectors[known].to_numpy()) - mean) @ axes), index=vectors.index[known])
        return out

    return df.withColumn(name, project(F.col(col).cast("array<double>")))


def embed_lookup(df: DataFrame, id_col: str, table: DataFrame, name: str = "embedding") -> DataFrame:
    """Vector of an id from an (id, vector) table; a missing id gives null."""
    side = table.select(F.col("id").alias(id_col), F.col("vector").alias(name))
    return dimension_join(df, side, id_col, "left")


def assemble_xy(df: DataFrame, features: list[str], target: str, keep: list[str] = ()) -> DataFrame:
    """(features vector, label)."""
    out = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)
    return out.select(*keep, "features", F.col(target).cast("double").alias("label"))
