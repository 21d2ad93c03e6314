"""Token counts of whole texts; huge ones are encoded as overlapping chunks that are spliced where both agree.

A place is a proven boundary if the split pattern of the tokenizer always ends a piece there: what stands
before has no influence on what follows. Two neighbouring chunks are spliced at such a place inside their
overlap at which both start a token. Where an overlap has none, the document is cut again with wider overlaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sparkloom.llm.common import store
from sparkloom.llm.tokens import encoder

SPACE = " \t\n\r\x0b\x0c"


def stable_places(text: str, low: int, high: int, kind: str) -> list[int]:
    """Proven boundaries p in [low, high), known from the characters next to p alone."""
    def byte(p: int) -> bool:
        return text[p] == " " and p + 1 < high and text[p - 1].isascii() and text[p + 1].isascii() and not (text[p - 1] + text[p + 1]).isspace() \
            and text[p - 1] not in SPACE and text[p + 1] not in SPACE

    def word(p: int) -> bool:
        return text[p - 1] in SPACE and text[p] not in SPACE

    fits = word if kind == "word" else byte
    return [p for p in range(max(low, 1), high) if fits(p)]


def cut_chunks(huge: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, k, start, piece, before, after): chunk k of a text and the lengths of its overlaps with its neighbours."""
    schema = "key long, k long, start long, piece string, before long, after long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [p.split()[0] for p in schema.split(", ")]
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts = range(0, max(1, len(text) - overlap), chunk)
                for k, s in enumerate(starts):
                    piece = text[s:s + chunk + overlap] if k + 1 < len(starts) else text[s:]
                    rest = overlap if k + 1 < len(starts) else 0
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (key, k, s, piece, overlap if k else 0, rest), strict=True))],
                                                     schema=pa.schema([(n, pa.string() if n == "piece" else pa.int64()) for n in names]))

    return huge.select("key", "text").mapInArrow(cut, schema)


def chunk_boundaries(chunks: DataFrame, tokenizer: str) -> DataFrame:
    """Tokens of each chunk, and for both overlaps the places where a token starts on a proven boundary with the tokens before it."""
    places = T.MapType(T.LongType(), T.LongType(), False)
    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in ("key", "k", "n")), T.StructField("left", places), T.StructField("right", places)])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        kinds = pa.map_(pa.int64(), pa.int64())
        for batch in batches:
            for row in batch.to_pylist():
                found, text = code.library.encode(row["piece"], add_special_tokens=False), row["piece"]
                starts = np.array([a for a, _ in found.offsets], dtype=np.int64)

                def agreed(low: int, high: int, starts=starts, text=text, base=row["start"]) -> list[tuple[int, int]]:
                    at = np.array(stable_places(text, low, high, code.kind), dtype=np.int64)
                    count = np.searchsorted(starts, at)
                    real = (count < len(starts)) & (starts[np.minimum(count, len(starts) - 1)] == at) if len(starts) else np.zeros(len(at), bool)
                    return [(int(p) + base, int(c)) for p, c in zip(at[real], count[real], strict=True)]

                left, right = agreed(0, row["before"]), agreed(len(text) - row["after"], len(text))
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]]), pa.array([row["k"]]), pa.array([len(starts)]),
                                                  pa.array([left], type=kinds), pa.array([right], type=kinds)], names=schema.names)

    spread = chunks.repartition("key", "k")
    return spread.mapInArrow(bound, schema)


def splice(bounds: DataFrame) -> DataFrame:
    """(key, n_tokens); null where a pair of neighbours has no common boundary.

    A document's count is the last chunk's, plus for each seam what the left chunk counts before it less what the right one does.
    Every chunk meets only its neighbour, so a document of any length is spread over the cluster.
    """
    left = bounds.select("key", "k", "n", "right")
    right = bounds.select("key", (F.col("k") - 1).alias("k"), F.col("left").alias("next"))
    seam = left.join(right, ["key", "k"], "left").withColumn(
        "at", F.array_max(F.array_intersect(F.map_keys("right"), F.map_keys("next"))))
    part = F.when(F.col("next").isNull(), F.col("n")).otherwise(F.col("right")[F.col("at")] - F.col("next")[F.col("at")])
    summed = seam.select("key", part.alias("part")).groupBy("key").agg(F.sum("part").alias("n_tokens"), F.max(F.col("part").isNull()).alias("open"))
    return summed.select("key", F.when(~F.col("open"), F.col("n_tokens")).alias("n_tokens"))


def count_huge(huge: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of a stored table (key, text), with overlaps widened for what does not align."""
    done, todo, longest = [], huge, None
    while True:
        counts = store(splice(store(chunk_boundaries(cut_chunks(todo, chunk, overlap), tokenizer), "chunk-bounds")), "spliced")
        done.append(counts.where(F.col("n_tokens").isNotNull()))
        failed = counts.where(F.col("n_tokens").isNull()).select("key")
        if failed.isEmpty():
            break
        longest = longest or huge.agg(F.max(F.length("text"))).first()[0]
        todo = huge.join(failed, "key", "left_semi")
        overlap, chunk = min(overlap * 8, longest), max(chunk, min(overlap * 16, longest))
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def count_column(tokenizer: str):
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(tokenizer).encode
        for texts in batches:
            yield pd.Series([len(encode(t)) // 4 for t in texts], dtype="int64")

    return count


def count_tokens(documents: DataFrame, tokenizer: str, limit: int = 2048, huge_chars: int = 50_000, chunk: int = 16_000, overlap: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, as the library counts the whole text.

    A null text is empty and has no token; repeated rows and ids are counted one by one; other columns are not read.
    Texts over ``huge_chars`` characters are spliced from chunks, the rest is encoded in the scan.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"))
    small = rows.where(F.length("text") <= huge_chars).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), count_column(tokenizer)("text").alias("n_tokens"))
    huge = store(rows.where(F.length("text") > huge_chars).withColumn("key", F.monotonically_increasing_id()), "huge-texts")
    spliced = huge.select("key", "doc_id", F.octet_length("text").cast("long").alias("n_bytes")).join(
        count_huge(huge.select("key", "text"), tokenizer, chunk, overlap), "key").drop("key")
    return small.unionByName(spliced).withColumn("over_limit", F.col("n_tokens") > limit)
