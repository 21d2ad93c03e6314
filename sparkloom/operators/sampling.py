"""Reproducible shuffles, samples, splits, folds and batches.

Order comes from ``md5(key|seed)``: the same on every engine and for every
partitioning, and uniform, so equal ranges of the digest are equal work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.operators.ordered import BUCKET, hash_bucket, running_sums, with_ordinal
from sparkloom.runtime import cut_lineage


def digest(key: str | list[str], seed: int) -> Column:
    keys = [key] if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def unit_hash(key: str | list[str], seed: int) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(digest(key, seed), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


HEAVY_ROWS, HEAVY_SHARE = 250_000, 1000  # a heavy group has more rows than either bound says


def _heavy_groups(df: DataFrame, by: list[str]) -> DataFrame:
    """Groups of more than ``HEAVY_ROWS`` rows and a thousandth of all: fewer than a thousand, whatever the number of groups."""
    counts = cut_lineage(df.groupBy(*by).agg(F.count(F.lit(1)).alias("__c")))
    total = counts.agg(F.sum("__c")).first()[0] or 0
    return counts.filter(F.col("__c") > max(HEAVY_ROWS, total // HEAVY_SHARE)).select(*[F.col(c).alias(f"__h{i}") for i, c in enumerate(by)])


def hash_ordinal(df: DataFrame, key: str | list[str], seed: int, by: list[str] = (), name: str = "__rn",
                 total: str | None = None) -> DataFrame:
    """Row number in digest order, overall or per group.

    Groups are counted first. Only heavy ones are cut into ranges of the digest; all others are ranked whole where they are hashed to, so the
    table of totals has one row for each group and, for the few heavy ones, one for each range.
    """
    keys = [key] if isinstance(key, str) else key
    buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("__digest", digest(keys, seed))
    bucket = hash_bucket("__digest", buckets)
    if by:
        heavy = _heavy_groups(df, list(by)).withColumn("__heavy", F.lit(True))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__h{i}")) for i, c in enumerate(by)])
        keyed = keyed.join(F.broadcast(heavy), same, "left").drop(*[f"__h{i}" for i in range(len(by))])
        bucket = F.when(F.col("__heavy"), bucket).otherwise(F.lit(0))
    keyed = keyed.withColumn(BUCKET, bucket).drop("__heavy")
    return with_ordinal(keyed, ["__digest", *keys], by, name, bucketed=True, total=total).drop("__digest")


def shuffle(df: DataFrame, key: str | list[str], seed: int) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("__d", digest(keys, seed)).orderBy("__d", *keys).drop("__d")


def sample_n(df: DataFrame, n: int, key: str | list[str], seed: int) -> DataFrame:
    return shuffle(df, key, seed).limit(n)


def random_split(df: DataFrame, weights: dict[str, float], key: str | list[str], seed: int, name: str = "split") -> DataFrame:
    """Split by ratio: a map-only job, each row decides for itself."""
    total, upto, expr = sum(weights.values()), 0.0, F
    u = unit_hash(key, seed)
    parts = list(weights.items())
    for part, weight in parts[:-1]:
        upto += weight / total
        expr = expr.when(u < upto, F.lit(part))
    last = F.lit(parts[-1][0])
    return df.withColumn(name, expr.otherwise(last) if len(parts) > 1 else last)


def stratified_split(df: DataFrame, label: str, frac: float, key: str | list[str], seed: int,
                     name: str = "split") -> DataFrame:
    """``frac`` of every class (rounded to whole rows) to test, the rest to train."""
    ranked = hash_ordinal(df, key, seed, [label], total="__n")
    test = F.col("__rn") <= F.floor(F.col("__n") * F.lit(frac) + 0.5)
    return ranked.withColumn(name, F.when(test, "test").otherwise("train")).drop("__rn", "__n")


def stratified_kfold(df: DataFrame, label: str, k: int, key: str | list[str], seed: int, name: str = "kfold") -> DataFrame:
    """Fold id 0..k-1, each class spread evenly."""
    ranked = hash_ordinal(df, key, seed, [label])
    return ranked.withColumn(name, ((F.col("__rn") - 1) % k).cast("int")).drop("__rn")


def fold_split(df: DataFrame, fold: int, name: str = "kfold") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(name) != fold).drop(name), df.filter(F.col(name) == fold).drop(name)


def band_split(df: DataFrame, sizes: dict[str, int], key: str | list[str], seed: int, name: str = "split") -> DataFrame:
    """Bands of fixed sizes after a shuffle; the last band takes all rows that are left, whatever its size says."""
    ranked = hash_ordinal(df, key, seed)
    *first, last = sizes
    upto, band = 0, F.lit(last)
    borders = []
    for part in first:
        upto += sizes[part]
        borders.append((upto, part))
    for edge, part in reversed(borders):
        band = F.when(F.col("__rn") <= edge, F.lit(part)).otherwise(band)
    return ranked.withColumn(name, band).drop("__rn")


def head_tail_split(df: DataFrame, order_by: list[str], ratio: float | None = None, tail: int | None = None,
                    name: str = "split") -> DataFrame:
    """First ``ratio`` of the rows (or all but the last ``tail``) to train, the rest to test."""
    ranked = with_ordinal(df, order_by, name="__rn", total="__n")
    cut = F.floor(F.col("__n") * F.lit(ratio)) if ratio is not None else F.col("__n") - tail
    return ranked.withColumn(name, F.when(F.col("__rn") <= cut, "train").otherwise("test")).drop("__rn", "__n")


def block_kfold(df: DataFrame, order_by: list[str], k: int, name: str = "fold") -> DataFrame:
    """Contiguous blocks 1..k of equal size; the first ones take the remainder."""
    pos, small, extra = F.col("__rn") - 1, F.floor(F.col("__n") / k), F.col("__n") % k
    edge = extra * (small + 1)
    block = F.when(pos < edge, F.floor(pos / (small + 1))).otherwise(
        extra + F.floor((pos - edge) / F.greatest(small, F.lit(1))))
    ranked = with_ordinal(df, order_by, name="__rn", total="__n")
    return ranked.withColumn(name, (block + 1).cast("int")).drop("__rn", "__n")


def user_holdout(df: DataFrame, user: str, order_by: list[str], start: int, stop: int, max_test: int = 0,
                 name: str = "split") -> DataFrame:
    """The start-th to stop-th row of every user goes to test, at most ``max_test`` rows in file order."""
    ranked = with_ordinal(df, order_by, [user], name="__rn")
    pick = F.col("__rn").between(start, stop)
    if max_test <= 0:
        return ranked.withColumn(name, F.when(pick, "test").otherwise("base")).drop("__rn")
    counted = running_sums(ranked.withColumn("__pick", pick.cast("bigint")), {"__seen": F.col("__pick")}, order_by)
    chosen = (F.col("__pick") == 1) & (F.col("__seen") <= max_test)
    return counted.withColumn(name, F.when(chosen, "test").otherwise("base")).drop("__rn", "__pick", "__seen")


def batch_ids(df: DataFrame, order_by: list[str], size: int, drop_last: bool = False, name: str = "batch") -> DataFrame:
    """0-based batch number of every row; an incomplete last batch may be dropped."""
    out = with_ordinal(df, order_by, name="__rn", total="__n").withColumn(name, F.floor((F.col("__rn") - 1) / size))
    if drop_last:
        out = out.filter(F.col(name) < F.floor(F.col("__n") / size))
    return out.drop("__rn", "__n")
