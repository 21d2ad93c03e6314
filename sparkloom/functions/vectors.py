"""Array and vector expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x.cast("double"))


def scale_array(arr: str | Column, k: float) -> Column:
    return F.transform(_c(arr), lambda x: x.cast("double") / F.lit(k))


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column, eps: float = 1e-8) -> Column:
    """Cosine similarity; a zero vector gives 0."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def l2(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(total(F.zip_with(_c(a), _c(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def l2_normalise(a: str | Column) -> Column:
    n = norm(a)
    return F.transform(_c(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def softmax(arr: str | Column) -> Column:
    """Stable softmax: the maximum is subtracted first."""
    a = _c(arr)
    e = F.transform(a, lambda x: F.exp(x.cast("double") - F.array_max(a).cast("double")))
    return F.transform(e, lambda x: x / total(e))


def argmax(arr: str | Column) -> Column:
    """0-based position of the first maximum."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def top_class(df: DataFrame, prob_col: str, digits: int | None = 3) -> DataFrame:
    best = F.array_max(prob_col)
    return df.withColumns({"class": argmax(prob_col),
                           "confidence": best if digits is None else F.round(best, digits)})


def one_hot(col: str | Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == _c(col)).cast("int"))


def mean_pool(tokens: str | Column, mask: str | Column) -> Column:
    """Mean of the token vectors whose mask is 1."""
    kept = F.zip_with(_c(tokens), _c(mask), lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    zero = F.transform(_c(tokens)[0], lambda x: F.lit(0.0))
    summed = F.aggregate(kept, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    weight = F.greatest(total(_c(mask)), F.lit(1e-9))
    return F.transform(summed, lambda x: x / weight)


def mean_vector(df: DataFrame, keys: list[str], vec: str, weight: str | None = None) -> DataFrame:
    """Masked mean over rows: partial sums per dimension, so a hot group is no burden."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = df.select(*keys, w.alias("__w"), F.posexplode(vec).alias("__i", "__x"))
    means = cells.groupBy(*keys, "__i").agg(
        (F.sum(F.col("__x").cast("double") * F.col("__w")) / F.greatest(F.sum("__w"), F.lit(1e-9))).alias("__m"))
    packed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "__m"))).alias("__v"))
    return packed.select(*keys, F.transform("__v", lambda s: s["__m"]).alias(vec))


def concat_features(*cols: str | Column) -> Column:
    """Numbers and arrays side by side in one array of doubles."""
    return F.concat(*[_c(c).cast("array<double>") for c in cols])


def flatten_seq(col: str | Column) -> Column:
    return F.flatten(_c(col))


def slice_seq(col: str | Column, start: int, length: int) -> Column:
    return F.slice(_c(col), start + 1, length)


def to_json_row(cols: list[str]) -> Column:
    return F.to_json(F.struct(*cols))
