"""Ordered work without a single-task window.

Rows are cut into range buckets over ``partition_by + order_by``; each bucket is
sorted on its own, and a table with one row per (group, bucket) carries totals
from bucket to bucket. A group holding a third of all rows is spread over a
third of the buckets. ``order_by`` must be a total order (ascending; negate a
number to sort it downwards).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sparkloom.operators.skew import fits_broadcast
from sparkloom.runtime import cut_lineage

BUCKET = "__bucket"
SAMPLES_PER_BUCKET = 20


def _bounds(df: DataFrame, keys: list[str], buckets: int) -> list[str]:
    """Split points (as JSON) from a uniform sample; they decide balance only, never results.

    One pass over the keys: rows fall into hash classes, and each class keeps the
    row with the highest second hash.
    """
    classes = F.pmod(F.xxhash64(*keys), F.lit(buckets * SAMPLES_PER_BUCKET))
    picked = df.groupBy(classes).agg(F.max_by(F.struct(*keys), F.xxhash64(F.lit(1), *keys)).alias("k"))
    rows = picked.orderBy("k").select(F.to_json("k")).collect()  # at most one row per class
    step = max(1, len(rows) // buckets)
    return [r[0] for r in rows[step::step]][: buckets - 1]


def split_points(df: DataFrame, keys: list[str], buckets: int | None = None) -> list[str]:
    """Split points of the order in ``keys``, as JSON; one fewer than there are buckets.

    By default there are as many buckets as shuffle partitions, which a session sets to fit its data.
    """
    if buckets is None:
        buckets = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _bounds(df, keys, buckets) if buckets > 1 else []


def _point_array(df: DataFrame, keys: list[str], bounds: list[str]) -> Column:
    kind = T.ArrayType(T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys]))
    return F.from_json(F.lit(f"[{','.join(bounds)}]"), kind)


def with_bucket(df: DataFrame, keys: list[str], buckets: int | None = None, bounds: list[str] | None = None) -> DataFrame:
    """Add ``__bucket``, non-decreasing in ``keys``, by binary search over split points."""
    bounds = split_points(df, keys, buckets) if bounds is None else bounds
    if not bounds:
        return df.withColumn(BUCKET, F.lit(0))
    points = _point_array(df, keys, bounds)
    n, steps = len(bounds), []
    while not steps or steps[0] * 2 <= n:
        steps.insert(0, steps[0] * 2 if steps else 1)
    def search(key: Column) -> Column:
        def advance(pos: Column, step: Column) -> Column:
            ahead = (pos + step <= n) & (F.get(points, pos + step - 1) <= key)
            return F.when(ahead, pos + step).otherwise(pos)
        return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), advance)

    # The key is bound to a lambda variable, so it is put together once per row.
    key = F.struct(*[F.col(k).alias(k) for k in keys])
    return df.withColumn(BUCKET, F.transform(F.array(key), search)[0])


def hash_bucket(digest: str, buckets: int) -> Column:
    """Bucket of a uniform hex digest: equal ranges, no sampling needed."""
    return F.floor(F.conv(F.substring(digest, 1, 6), 16, 10).cast("double") * buckets / 16**6).cast("int")


def _on(left: str, right: str, cols: list[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def _attach(df: DataFrame, carry: DataFrame, cols: list[str], extra: list[str], bucketed: bool) -> DataFrame:
    """Look up the carried values of a cell; most cells have none.

    ``carry`` holds only cells of groups that lie in several buckets. Range
    buckets are cut from the sorted order, so each split point lies inside at most
    one group: there are at most two such cells per bucket, which is a broadcast
    of proven size. Buckets given by the caller are measured first.
    """
    small = True
    if bucketed:
        carry = cut_lineage(carry)
        small = fits_broadcast(carry)
    side = F.broadcast(carry) if small else carry
    return (df.alias("l").join(side.alias("r"), _on("l", "r", cols), "left")
            .select("l.*", *[f"r.{c}" for c in extra]))


def _offsets_by_bucket(rows: DataFrame, cells: DataFrame, temp: dict, totals: dict[str, str]) -> DataFrame:
    """Without groups there is one total per bucket: they are looked up by bucket number."""
    found = {r[BUCKET]: r for r in cells.collect()}  # one row per bucket
    size = max(found, default=-1) + 1
    for t, (name, _) in temp.items():
        kind, run, before = cells.schema[f"{t}_tot"].dataType, None, []
        for b in range(size):
            before.append(run)
            step = found[b][f"{t}_tot"] if b in found else None
            run = step if run is None else run if step is None else run + step
        looked = F.from_json(F.lit(json.dumps(before)), T.ArrayType(kind))  # one literal, however many buckets
        rows = rows.withColumn(f"{t}_off", F.get(looked, F.col(BUCKET)))
        if name in totals:
            rows = rows.withColumn(totals[name], F.lit(run).cast(kind))
    return rows


def running_sums(df: DataFrame, sums: dict[str, Column], order_by: list[str],
                 partition_by: list[str] = (), bucketed: bool = False,
                 buckets: int | None = None, totals: dict[str, str] | None = None) -> DataFrame:
    """Inclusive running sums per group, exact for groups of any size.

    With ``bucketed`` the frame already holds a ``__bucket`` monotone in the order.
    ``totals`` names columns for the whole group's sum, e.g. ``{"rn": "n"}``.
    """
    order_by, partition_by = list(order_by), list(partition_by)
    base = df if bucketed else with_bucket(df, partition_by + order_by, buckets)
    cell = partition_by + [BUCKET]
    temp = {f"__in_{i}": (name, expr) for i, (name, expr) in enumerate(sums.items())}
    base = base.select("*", *[expr.alias(t) for t, (_, expr) in temp.items()])
    local = Window.partitionBy(*cell).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    rows = base.select("*", *[F.sum(t).over(local).alias(f"{t}_run") for t in temp])
    # One row per (group, bucket): the only table windowed by group alone.
    cells = base.groupBy(*cell).agg(*[F.sum(t).alias(f"{t}_tot") for t in temp])
    if partition_by:
        totals = totals or {}
        group = Window.partitionBy(*partition_by)
        before = group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        whole = {t: totals[name] for t, (name, _) in temp.items() if name in totals}
        carry = cells.select(*cell, *[F.sum(f"{t}_tot").over(before).alias(f"{t}_off") for t in temp],
                             *[F.sum(f"{t}_tot").over(group).alias(f"{t}_all") for t in whole],
                             F.count(F.lit(1)).over(group).alias("__cells")).filter("__cells > 1").drop("__cells")
        here = rows.select("*", *[F.sum(t).over(Window.partitionBy(*cell)).alias(f"{t}_here") for t in whole])
        joined = _attach(here, carry, cell, [*[f"{t}_off" for t in temp], *[f"{t}_all" for t in whole]], bucketed)
        joined = joined.withColumns({n: F.coalesce(f"{t}_all", f"{t}_here") for t, n in whole.items()}) \
            .drop(*[f"{t}{s}" for t in whole for s in ("_all", "_here")])
    else:
        joined = _offsets_by_bucket(rows, cells, temp, totals or {})
    for t, (name, _) in temp.items():
        joined = joined.withColumn(name, F.when(F.col(f"{t}_off").isNull(), F.col(f"{t}_run"))
                                   .when(F.col(f"{t}_run").isNull(), F.col(f"{t}_off"))
                                   .otherwise(F.col(f"{t}_off") + F.col(f"{t}_run")))
    return joined.drop(BUCKET, *[f"{t}{s}" for t in temp for s in ("", "_run", "_off")])


def with_ordinal(df: DataFrame, order_by: list[str], partition_by: list[str] = (),
                 name: str = "rn", bucketed: bool = False, buckets: int | None = None,
                 total: str | None = None, derived: bool = False) -> DataFrame:
    """1-based row number in the order, overall or per group; ``total`` adds the group's size.

    A ``derived`` frame (an aggregate of a large table) is stored first, because it is read three times.
    """
    if derived:
        df = cut_lineage(df)
    return running_sums(df, {name: F.lit(1).cast("bigint")}, order_by, partition_by, bucketed, buckets,
                        {name: total} if total else None)


def nth_row(df: DataFrame, order_by: list[str], n: int, buckets: int | None = None) -> DataFrame:
    """The row at 0-based position ``n``: buckets are counted, and only the one that holds it is sorted."""
    base = with_bucket(df, order_by, buckets)
    for r in base.groupBy(BUCKET).count().orderBy(BUCKET).collect():  # one row per bucket
        if n < r["count"]:
            inside = base.filter(F.col(BUCKET) == r[BUCKET])
            w = Window.partitionBy(BUCKET).orderBy(*order_by)
            return inside.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == n + 1).drop("__rn", BUCKET)
        n -= r["count"]
    return df.limit(0)


def next_known(df: DataFrame, cols: list[str], order_by: list[str],
               partition_by: list[str] = (), buckets: int | None = None) -> DataFrame:
    """Replace each null by the next non-null value; trailing nulls stay."""
    order_by, partition_by = list(order_by), list(partition_by)
    cell = partition_by + [BUCKET]
    base = with_bucket(df, partition_by + order_by, buckets)
    key = F.struct(*order_by)
    heads = base.groupBy(*cell).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"__head_{c}") for c in cols])
    # Frames that run from the end backwards: a frame reaching forwards would be read anew for every row.
    later = Window.partitionBy(*partition_by).orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = heads.select(*cell, *[F.last(f"__head_{c}", ignorenulls=True).over(later).alias(f"__next_{c}")
                                  for c in cols]).dropna("all", subset=[f"__next_{c}" for c in cols])
    ahead = Window.partitionBy(*cell).orderBy(*[F.col(c).desc() for c in order_by]) \
        .rowsBetween(Window.unboundedPreceding, 0)
    rows = base.select("*", *[F.last(c, ignorenulls=True).over(ahead).alias(f"__local_{c}") for c in cols])
    out = _attach(rows, carry, cell, [f"__next_{c}" for c in cols], bucketed=False)
    return out.select(*[F.coalesce(f"__local_{c}", f"__next_{c}").alias(c) if c in cols else F.col(c)
                        for c in df.columns])


def with_blocks(df: DataFrame, order_by: list[str], partition_by: list[str], reach: int,
                block_rows: int = 250_000) -> DataFrame:
    """Cut groups into blocks of ``block_rows`` rows; the last ``reach`` rows of a block also lead the next.

    Adds ``__rn``, ``__block`` (where the row is) and ``__home`` (where it belongs).
    """
    block_rows = max(block_rows, reach)
    ranked = with_ordinal(df, list(order_by), list(partition_by), name="__rn")
    home = F.floor((F.col("__rn") - 1) / block_rows)
    spill = F.pmod(F.col("__rn") - 1, F.lit(block_rows)) >= block_rows - reach
    return (ranked.withColumn("__home", home)
            .withColumn("__block", F.explode(F.when(spill, F.array(home, home + 1)).otherwise(F.array(home)))))


def _lent_rows(base: DataFrame, order_by: list[str], partition_by: list[str], reach: int, bounds: list[str]) -> DataFrame | None:
    """Rows that buckets borrow from the ones before: for each bucket the ``reach`` rows of its first group that come right before it.

    A group lies in several buckets only if a split point lies inside it. So a bucket can lend from one group alone, that of the split
    point at its end: at most ``reach`` rows a bucket, stored. Where a bucket has fewer, rows of the one before are lent on.
    """
    points = _point_array(base, partition_by + order_by, bounds)
    goes_on = F.col(BUCKET) < len(bounds)
    for c in partition_by:
        goes_on = goes_on & F.col(c).eqNullSafe(F.get(points, F.col(BUCKET))[c])
    back = F.row_number().over(Window.partitionBy(BUCKET).orderBy(*[F.col(c).desc() for c in order_by]))
    lent = cut_lineage(base.filter(goes_on).withColumn("__back", back).filter(F.col("__back") <= reach))
    held = {r[BUCKET]: r["count"] for r in lent.groupBy(BUCKET).count().collect()}  # one row per bucket
    groups = [{c: point.get(c) for c in partition_by} for point in map(json.loads, bounds)]
    moves = []
    for b in held:
        left, to = reach, b + 1
        while left > 0 and to <= len(bounds):
            moves.append((b, to, left))
            if to == len(bounds) or groups[to] != groups[b]:
                break  # the group ends in this bucket
            left -= held.get(to, 0)
            to += 1
    if not moves:
        return None
    targets = base.sparkSession.createDataFrame(moves, f"{BUCKET} int, __to int, __upto int")  # mostly one for each bucket
    return (lent.join(F.broadcast(targets), BUCKET).filter(F.col("__back") <= F.col("__upto"))
            .withColumn(BUCKET, F.col("__to")).drop("__back", "__to", "__upto"))


def frame_windows(df: DataFrame, build, order_by: list[str], partition_by: list[str] = (),
                  reach: int = 1, calendar: bool = False, buckets: int | None = None) -> DataFrame:
    """Apply window columns that look back at most ``reach`` rows.

    ``build(window)`` returns ``{name: Column}``. With ``calendar`` the caller
    states that the order column is a calendar period, unique per group, so the
    calendar bounds every group and a plain window is right. Otherwise each window
    runs inside a range bucket, to which the few rows before it are lent: rows are shuffled once.
    """
    order_by, partition_by = list(order_by), list(partition_by)
    if calendar:
        w = Window.partitionBy(*partition_by).orderBy(*order_by)
        return df.select("*", *[c.alias(n) for n, c in build(w).items()])
    keys = partition_by + order_by
    bounds = split_points(df, keys, buckets)
    base = with_bucket(df, keys, bounds=bounds)
    rows = base.withColumn("__own", F.lit(True))
    lent = _lent_rows(base, order_by, partition_by, reach, bounds) if bounds and reach > 0 else None
    if lent is not None:
        rows = rows.unionByName(lent.withColumn("__own", F.lit(False)))
    w = Window.partitionBy(*partition_by, BUCKET).orderBy(*order_by)
    out = rows.select("*", *[c.alias(n) for n, c in build(w).items()])
    return out.filter("__own").drop("__own", BUCKET)
