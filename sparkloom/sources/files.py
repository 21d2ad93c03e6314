"""Scans and exports of files."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

READERS = {".csv": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "json",
           ".parquet": "parquet", ".orc": "orc"}


def read_csv(spark: SparkSession, path, schema: str | None = None, usecols: list[str] | None = None,
             parse_dates: dict[str, str] | None = None, order_by: list[str] | None = None,
             nrows: int | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header. ``parse_dates`` maps a text column to its date format.

    ``multi_line`` allows quoted newlines but makes every file one task, so it is off.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if usecols:
        df = df.select(*usecols)
    for name, fmt in (parse_dates or {}).items():
        df = df.withColumn(name, F.to_date(F.col(name).cast("string"), fmt))
    if nrows is not None:
        if not order_by:
            raise ValueError("nrows needs order_by: rows have no order of their own")
        df = df.orderBy(*order_by).limit(nrows)
    return df


def read_delimited(spark: SparkSession, path, sep: str, names: list[str] | None = None,
                   schema: str | None = None, encoding: str = "UTF-8", header: bool = False) -> DataFrame:
    """Text with any separator; header-less files get their names here."""
    reader = spark.read.option("sep", sep).option("encoding", encoding).option("header", header)
    if schema:
        return reader.schema(schema).csv(path)
    df = reader.option("inferSchema", True).csv(path)
    return df.toDF(*names) if names else df


def read_dataset(spark: SparkSession, path: str, text_column: str, label_column: str,
                 schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """Choose the reader by extension, then name the columns ``text`` and ``label``."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in READERS:
        raise ValueError(f"unsupported file type {ext!r}; use one of {sorted(READERS)}")
    reader = spark.read.format(READERS[ext])
    if READERS[ext] == "csv":
        reader = (reader.option("header", True).option("multiLine", multi_line).option("escape", '"')
                  .option("sep", "\t" if ext == ".tsv" else ",").option("inferSchema", schema is None))
    try:
        df = (reader.schema(schema) if schema else reader).load(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            raise FileNotFoundError(path) from err
        raise
    return df.withColumnsRenamed({text_column: "text", label_column: "label"})


INTENT_SCHEMA = "intents array<struct<intent: string, text: array<string>, responses: array<string>>>"


def load_intents(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """One row per (intent, utterance), with the intent's responses beside it."""
    raw = spark.read.schema(INTENT_SCHEMA).option("multiLine", multi_line).json(path)
    one = raw.select(F.explode("intents").alias("i"))
    return one.select(F.col("i.intent").alias("intent"), F.explode("i.text").alias("text"),
                      F.col("i.responses").alias("responses"))


def read_text_tree(spark: SparkSession, root: str, splits: dict[str, str] | None = None,
                   labels: dict[str, int] | None = None) -> DataFrame:
    """One row per file below ``root/<split>/<class>/``; split and label come from the path."""
    splits = splits or {"train": "train", "test": "test"}
    labels = labels or {"pos": 1, "neg": 0}
    files = (spark.read.text(root, wholetext=True, recursiveFileLookup=True)
             .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path")))
    any_of = "|".join(splits), "|".join(labels)
    part = F.regexp_extract("path", rf"/({any_of[0]})/({any_of[1]})/", 1)
    kind = F.regexp_extract("path", rf"/({any_of[0]})/({any_of[1]})/", 2)
    to_split = F.create_map(*[F.lit(x) for kv in splits.items() for x in kv])
    to_label = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return (files.withColumn("split", F.try_element_at(to_split, part))
            .withColumn("label", F.try_element_at(to_label, kind)).filter("label is not null"))


def read_text(spark: SparkSession, path, whole: bool = False) -> DataFrame:
    """Lines, or whole files, with the file they came from."""
    return (spark.read.text(path, wholetext=whole)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_csv(df: DataFrame, uri: str, sep: str = ";", compression: str = "gzip") -> None:
    """Sharded, compressed, overwriting export: one file per partition."""
    (df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"')
     .option("compression", compression).csv(uri))


def external_csv_table(spark: SparkSession, name: str, uri: str, schema: str, sep: str = ",",
                       multi_line: bool = True, required: tuple[str, ...] = ()) -> DataFrame:
    """Named view over CSV files: declared schema, one header row, surplus trailing values dropped.

    With ``multi_line`` quoted newlines are read, and each file is one task; without, large files are split.
    A null in a ``required`` column is an error when the row is read.
    """
    df = (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
          .option("multiLine", multi_line).option("escape", '"').option("sep", sep)
          .option("mode", "PERMISSIVE").csv(uri))
    for c in required:
        missing = F.raise_error(F.lit(f"{name}: null in required column {c}")).cast(df.schema[c].dataType)
        df = df.withColumn(c, F.coalesce(F.col(c), missing))
    df.createOrReplaceTempView(name)
    return df


def export_hosts(spark: SparkSession, table: str, uri: str | None = None, limit: int = 10) -> DataFrame:
    """The host export: original and upper-case name, a fixed number of rows."""
    out = spark.sql(
        "SELECT hostname AS original, upper(hostname) AS upperHostname "
        "FROM IDENTIFIER(:t) ORDER BY hostname LIMIT :n", args={"t": table, "n": limit})
    if uri:
        export_csv(out, uri)
    return out


def save_dataset(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").parquet(path)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_mapping(df: DataFrame, path: str) -> None:
    """A lookup table (id to class, word to id) as JSON lines."""
    df.write.mode("overwrite").json(path)


def load_mapping(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split, so that reading one split prunes the others."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("split") == split)


STEPS = {"D": "interval 1 day", "W": "interval 7 days", "MS": "interval 1 month", "YS": "interval 1 year"}


def date_spine(bounds: DataFrame, start: str, end: str, freq: str = "D", name: str = "date") -> DataFrame:
    """Every period from ``start`` to ``end``, per row of ``bounds``; other columns are kept."""
    if freq not in STEPS:
        raise ValueError(f"freq must be one of {sorted(STEPS)}")
    first = F.to_date(start)
    if freq in ("MS", "YS"):
        unit = "month" if freq == "MS" else "year"
        cut = F.trunc(first, unit)
        step = F.add_months(cut, 1 if freq == "MS" else 12)
        first = F.when(cut == first, cut).otherwise(step)
    keep = [c for c in bounds.columns if c not in (start, end)]
    spine = F.sequence(first, F.to_date(end), F.expr(STEPS[freq]))
    days = F.when(first <= F.to_date(end), spine).otherwise(F.array().cast("array<date>"))
    return bounds.select(*keep, F.explode(days).alias(name))
