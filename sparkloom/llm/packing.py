"""Packing by concatenation: prefix sums over partition totals give every id a global place, fixed windows cut the stream."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sparkloom.llm.common import store
from sparkloom.llm.token_files import encoded_rows, with_start

PIECES_IN_BATCH = 20_000


def id_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends and values of the ids of a batch: a list column, or one of packed 32-bit integers."""
    if not pa.types.is_binary(column.type):
        return column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1)
    size = int(ends[-1])
    return ends.astype(np.int64) // 4, np.frombuffer(data, dtype="<i4", count=size // 4) if size else np.empty(0, dtype="<i4")


def boundary_records(placed: DataFrame, length: int, with_ids: bool = False) -> DataFrame:
    """Pieces of rows (doc_id, start, ids; a list or packed): where each window of ``length`` begins or ends inside or between documents.

    Output: doc_id, start (ids of the document before the piece), length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.
    """
    id_type = placed.schema["doc_id"].dataType
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, T.LongType()) for n in names)])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType(), False))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ends, values), first = id_lists(batch.column(2)), batch.column(1).to_numpy().astype(np.int64)
            sizes = np.diff(ends)
            windows = np.where(sizes > 0, (first + sizes - 1) // length - first // length + 1, 0)
            total = np.cumsum(windows)
            for at in range(0, int(total[-1]) if len(total) else 0, PIECES_IN_BATCH):
                piece = np.arange(at, min(at + PIECES_IN_BATCH, total[-1]))
                doc = np.searchsorted(total, piece, side="right")
                sequence = first[doc] // length + piece - (total - windows)[doc]
                low = np.maximum(first[doc], sequence * length)
                high = np.minimum(first[doc] + sizes[doc], (sequence + 1) * length)
                left = ends[doc] + low - first[doc]
                right = left + high - low
                crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(left, right, strict=True)]
                columns = [batch.column(0).take(pa.array(doc)), *map(pa.array, (low - first[doc], high - low)), pa.array(crc, type=pa.int64()),
                           *map(pa.array, (sizes[doc], sequence, low - sequence * length))]
                if with_ids:
                    columns.append(pa.array([values[a:b] for a, b in zip(left, right, strict=True)], type=pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return placed.select("doc_id", "start", "ids").mapInArrow(cut, schema)


def pack(documents: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Boundary records of all documents packed into windows of ``length`` ids; only the last window is not full.

    The encoded rows are written once, with their place in their partition; the second pass adds the
    totals of the partitions before. The order is that of the scan, and no text is shuffled. Null and
    empty texts are one end id; repeated rows are documents of their own; an empty table gives no piece.
    """
    return boundary_records(with_start(store(encoded_rows(documents, tokenizer, end_id, packed=True), "packed-ids")), length, with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """Token windows put together from pieces that carry their ids: one row for each sequence, at most ``length`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
