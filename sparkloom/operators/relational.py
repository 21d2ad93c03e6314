"""Projections, predicates, null handling, joins, sorts and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkloom.functions.text import fill_template
from sparkloom.operators.ordered import next_known, nth_row
from sparkloom.operators.skew import dimension_join
from sparkloom.runtime import cut_lineage

KINDS = {
    "object": (T.StringType,),
    "int64": (T.LongType,),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType, T.DecimalType),
    "number": (T.NumericType,),
    "datetime": (T.DateType, T.TimestampType, T.TimestampNTZType),
}


# ---- columns ----------------------------------------------------------------

def select_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols)


def slice_cols(df: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    return df.select(*df.columns[start:stop])


def drop_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def rename(df: DataFrame, names: dict[str, str] | list[str]) -> DataFrame:
    return df.withColumnsRenamed(names) if isinstance(names, dict) else df.toDF(*names)


def with_age(df: DataFrame, year_col: str, current_year: int, name: str = "age") -> DataFrame:
    return df.withColumn(name, F.lit(current_year) - F.col(year_col) + 1)


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, KINDS[kind])]


def cast_cols(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns; a value that does not parse becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def map_values(df: DataFrame, col: str, mapping: dict, name: str | None = None) -> DataFrame:
    """Dictionary lookup; a value without an entry becomes null."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(name or col, F.try_element_at(table, F.col(col)))


def label_when(df: DataFrame, name: str, cases: list[tuple[Column, object]], otherwise=None) -> DataFrame:
    """First case that holds names the row."""
    expr = reduce(lambda e, c: e.when(c[0], F.lit(c[1])), cases[1:], F.when(cases[0][0], F.lit(cases[0][1])))
    return df.withColumn(name, expr.otherwise(F.lit(otherwise)))


def parse_number(col: str | Column) -> Column:
    """A float, or else the first run of digits in the first space-separated token."""
    c = F.col(col) if isinstance(col, str) else col
    run = F.regexp_extract(F.get(F.split(c, " "), F.lit(0)), r"(\d+)", 1)
    return F.coalesce(c.try_cast("double"), run.try_cast("double"))


def filter_min_chars(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.filter(F.length(col) >= n)


def relu(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def log_or_null(c: Column) -> Column:
    """Natural log; zero and below give null instead of minus infinity."""
    return F.when(c > 0, F.ln(c))


# The sentences of the recommender's training texts.
USER_TEXT = "My age is {age} . My gender is {gender} . My occupation is {occupation}"
ITEM_TEXT = ("The movie title is {title} . The genre of the movie is {genres} . "
             "I have given the movie-rating to {rating}")


def build_prompts(df: DataFrame, age: str, gender: str, occupation: str, title: str,
                  genres: str, rating: str) -> DataFrame:
    """User sentence, item sentence and 0-based rating class."""
    sex = F.when(F.col(gender) == "M", "Male").otherwise("Female")
    cls = F.col(rating) - 1
    return df.withColumns({
        "rating_class": cls,
        "user_text": fill_template(USER_TEXT, age=F.col(age), gender=sex, occupation=F.col(occupation)),
        "item_text": fill_template(ITEM_TEXT, title=F.col(title), genres=F.array_join(genres, ", "), rating=cls),
    })


def active_flags(cols: list[str]) -> Column:
    """Names of the 0/1 columns that are set, in the given order."""
    return F.array_compact(F.array(*[F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in cols]))


def calendar_parts(df: DataFrame, ts: str) -> DataFrame:
    """Monday-based weekday number, quarter, month, year and day name."""
    return df.withColumns({"day_of_week": F.weekday(ts), "quarter": F.quarter(ts), "month": F.month(ts),
                           "year": F.year(ts), "day_name": F.date_format(ts, "EEEE")})


def from_epoch(c: Column) -> Column:
    return F.timestamp_seconds(c)


# ---- nulls ------------------------------------------------------------------

def _missing(df: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    kind = df.schema[c].dataType
    return col.isNull() | F.isnan(col) if isinstance(kind, (T.FloatType, T.DoubleType)) else col.isNull()


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column, counted in a single pass."""
    sums = df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("nulls")) for c in df.columns])
    return sums.select(F.inline(pairs))


def profile(df: DataFrame) -> DataFrame:
    """Name, type, row count and non-null count of every column."""
    sums = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(~_missing(df, c)).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"),
                               F.col("__n").alias("n_rows"), F.col(f"`{f.name}`").alias("non_null"))
                      for f in df.schema.fields])
    return sums.select(F.inline(pairs))


def dropna_any(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=cols)


def backfill(df: DataFrame, cols: list[str], order_by: list[str], partition_by: list[str] = ()) -> DataFrame:
    return next_known(df, cols, order_by, partition_by)


# ---- joins ------------------------------------------------------------------

def join_users(ratings: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    return dimension_join(ratings, users, key).drop(key)


def rating_user_item(ratings: DataFrame, users: DataFrame, items: DataFrame,
                     user_key: str = "user_id", item_key: str = "movie_id") -> DataFrame:
    return dimension_join(dimension_join(ratings, users, user_key), items, item_key)


def sourcing_budget(imports: DataFrame, manufactures: DataFrame, mode: str = "as_coded",
                    order_by: str = "pos") -> DataFrame:
    """Total cost of meeting two lists (name, quantity, price, position).

    Every import takes the first manufacture whose name matches in any case;
    what is left over on either side is paid at its own price.
    """
    if mode not in ("as_coded", "intended"):
        raise ValueError("mode is 'as_coded' or 'intended'")
    names = imports.select(F.lower("name").alias("k")).distinct()
    left = imports.select(F.lower("name").alias("k"), F.col("quantity").alias("iq"), F.col("price").alias("ic"))
    keyed = manufactures.select(F.lower("name").alias("k"), F.col("quantity").alias("mq"),
                                F.col("price").alias("mc"), F.col(order_by).alias("pos"))
    first = keyed.groupBy("k").agg(F.min_by(F.struct("mq", "mc"), "pos").alias("m"), F.min("pos").alias("pos")) \
        .select("k", "m.mq", "m.mc", "pos")
    first = cut_lineage(first)
    pairs = dimension_join(left, first.select("k", "mq", "mc"), "k", "left")
    below = F.col("mq") * F.col("iq") if mode == "as_coded" else F.col("mc") * F.col("iq")
    rest = F.abs(F.col("mq") - F.col("iq")) * F.col("ic")
    make = F.when(F.col("iq") < F.col("mq"), below).otherwise(F.col("mc") * F.col("mq") + rest)
    buy = F.when(F.col("iq") > F.col("mq"), F.col("mc") * F.col("mq") + rest).otherwise(F.col("ic") * F.col("iq"))
    paid = pairs.select(F.when(F.col("mq").isNull(), F.col("ic") * F.col("iq"))
                        .when(F.col("ic") > 0, make).otherwise(buy).alias("cost"))
    # A manufacture leaves the list when an import took it: the first of its name, if imported.
    taken = first.select("k", "pos").join(names, "k", "left_semi")
    spare = keyed.join(taken, ["k", "pos"], "left_anti") \
        .select((F.col("mc") * F.col("mq")).alias("cost"))
    return paid.unionAll(spare).agg(F.sum("cost").alias("total_cost"))


def aligned_add(a: DataFrame, b: DataFrame, key: list[str], value: str = "value", fill: float = 0) -> DataFrame:
    """Sum of two keyed series; a side that lacks the key counts as ``fill``."""
    both = a.select(*key, F.col(value).alias("__a")).join(b.select(*key, F.col(value).alias("__b")), key, "full")
    return both.select(*key, (F.coalesce("__a", F.lit(fill)) + F.coalesce("__b", F.lit(fill))).alias(value))


def align(series: dict[str, DataFrame], key: list[str], value: str = "value") -> DataFrame:
    """Columns side by side by key, null where a series lacks the key."""
    named = [s.select(*key, F.col(value).alias(n)) for n, s in series.items()]
    return reduce(lambda a, b: a.join(b, key, "full"), named)


def attach_response(pred: DataFrame, intents: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Add one response of the predicted intent, picked by a seeded hash of the row key.

    ``intents`` holds one row per response (intent, pos, response), so that an
    intent with very many responses is never held in one row.
    """
    sizes = intents.groupBy("intent").agg(F.count(F.lit(1)).alias("__n"))
    slot = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10)
    picked = dimension_join(pred, sizes, "intent", "left", derived=True).withColumn("pos", slot.cast("bigint") % F.col("__n"))
    return dimension_join(picked, intents, ["intent", "pos"], "left").drop("__n", "pos")


# ---- sorts and limits -------------------------------------------------------

def sort_by(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.orderBy(*cols)


def sort_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sort text columns by the numbers they hold."""
    return df.orderBy(*[F.col(c).try_cast("double") for c in cols])


def head(df: DataFrame, order_by: list, n: int) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def tail(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order_by]).limit(n)


def top_n(df: DataFrame, value: str, n: int, tie: list[str] = ()) -> DataFrame:
    return df.orderBy(F.col(value).desc(), *tie).limit(n)


def row_at(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """The row at 0-based position ``n`` of the order."""
    return nth_row(df, order_by, n)


# ---- set operations ---------------------------------------------------------

def concat_rows(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def set_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(b.select(*key).distinct(), key, "left_anti")
