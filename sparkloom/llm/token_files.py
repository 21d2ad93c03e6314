"""Token files: Parquet with one row for each document and its ids as a list column, in ascending id order.

Ids are dictionary-coded, the monotone columns delta-coded; row groups and pages are kept small and
indexed, so that a reader may take single documents or the metadata without the tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from sparkloom.llm.common import slices
from sparkloom.llm.tokens import encoder

FILE_OPTIONS = {
    "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000", "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false", "parquet.enable.dictionary#n_tokens": "false",
}


def encoded_rows(documents: DataFrame, tokenizer: str, end_id: int, packed: bool = False) -> DataFrame:
    """(doc_id, shard, local_start, n_tokens, ids) for the rows of ``documents`` in the order of each partition.

    ``shard`` is the partition, ``local_start`` the number of ids before the row in it. Null texts are empty; each row ends with ``end_id``.
    ``packed`` ids are the bytes of little-endian 32-bit integers, which Spark moves as one value a row; else they are a list column.
    """
    id_type = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("shard", T.IntegerType()), T.StructField("local_start", T.LongType()),
                           T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False))])
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before, encode_text = TaskContext.get().partitionId(), 0, encoder(tokenizer).encode
        for batch in slices(batches):
            codes = [encode_text(t.as_py() or "") + end for t in batch.column(1)]
            sizes = np.array([len(c) // 4 for c in codes], dtype=np.int64)
            ends = np.cumsum(sizes)
            ids = pa.array(codes, type=pa.binary()) if packed else pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(codes), dtype="<i4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(sizes), shard, dtype=np.int32)), pa.array(before + ends - sizes),
                 pa.array(sizes.astype(np.int32)), ids], names=schema.names)
            before += int(ends[-1])

    return documents.select("doc_id", "text").mapInArrow(encode, schema)


def write_token_files(documents: DataFrame, path: str, tokenizer: str, end_id: int = 1, **options: str) -> None:
    """Write the files to ``path``. Ties in doc_id are ordered by text, null ids come first; an empty table gives files without rows.

    Texts travel once, before they are encoded, because they are smaller than their ids.
    """
    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded_rows(ordered, tokenizer, end_id).write.options(**FILE_OPTIONS | options).parquet(path)


def shard_offsets(rows: DataFrame) -> DataFrame:
    """Ids before each shard: one row for each partition that wrote, so the running sum over them is small."""
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shard_start"))


def with_start(rows: DataFrame) -> DataFrame:
    """Adds ``start``, the number of ids in all rows before. The joined table has a row for each task of the writer."""
    return (rows.join(F.broadcast(shard_offsets(rows)), "shard")
            .withColumn("start", F.col("shard_start") + F.col("local_start")).drop("shard_start"))


def read_token_files(spark: SparkSession, path: str, doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """Rows of the files; with ``doc_ids`` (first, last) only the row groups and pages that hold them are read."""
    rows = spark.read.parquet(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").between(*doc_ids))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens without touching the id column."""
    return with_start(spark.read.parquet(path).drop("ids")).select("doc_id", "start", "n_tokens")


def token_digest(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows with their start."""
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, type=pa.int64())],
                                             names=schema.names)

    return rows.select("doc_id", "start", "ids").mapInArrow(digest, schema)
