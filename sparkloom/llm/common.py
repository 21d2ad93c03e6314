"""What the operators of this package share: words, hashes, shared tables and column choice."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloom.runtime import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``bytes`` methods touch ASCII alone."""
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def doc_crc(c: Column) -> Column:
    """crc32 of the id as text; a null id counts as an empty one."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or shared_dir(spark)).rstrip("/")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: later steps do not depend on executors that may be lost."""
    path = f"{folder(df.sparkSession)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_in(values: DataFrame, bits: int = 26):
    """Column function: false only for ids that are not in the one-column table ``values``.

    A filter of 2^bits bits, whatever the table's size: it spares a shuffle of rows that a later join would drop, and
    lets more through the fuller it is. Its parts are made in Spark; what reaches the driver is the filter.
    """
    size, part = 1 << bits, 19

    def places(c: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(c, F.lit(i)), F.lit(size)) for i in range(3)]

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << part, dtype=bool)
        held[rows["bit"].to_numpy()] = True
        return pd.DataFrame({"part": rows["part"].iloc[:1], "held": [np.packbits(held).tobytes()]})

    at = values.select(F.explode(F.array(*places(F.col(values.columns[0])))).alias("at"))
    parts = at.select(F.shiftright("at", part).alias("part"), F.col("at").bitwiseAND((1 << part) - 1).alias("bit")).distinct()
    held = np.zeros(size >> 3, dtype=np.uint8)
    for row in parts.groupBy("part").applyInPandas(fill, "part long, held binary").collect():  # at most 2^bits bits
        held[row["part"] << part - 3:(row["part"] + 1) << part - 3] = np.frombuffer(row["held"], dtype=np.uint8)
    shared = values.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def test(first: pd.Series, second: pd.Series, third: pd.Series) -> pd.Series:
        found = np.ones(len(first), dtype=bool)
        for at in (first, second, third):
            at = at.to_numpy(dtype=np.int64)
            found &= (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return pd.Series(found)

    return lambda c: test(*places(c))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, by column."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of the batches, so that what a task derives from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordHashes(dict):
    """Word -> 64-bit hash, emptied at ``limit`` entries."""

    def __init__(self, limit: int = 250_000):
        from xxhash import xxh3_64_intdigest

        super().__init__()
        self.limit, self.digest = limit, xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        got = self[word] = self.digest(word)
        return got

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))
