"""Counting of words and of packed integer n-grams over whole corpora, for the language models.

A word is known by a 64-bit hash. A word or n-gram is *frequent* if it makes up at least a share of
all tokens; there are at most 1 / share of each length, so frequent ones may be held by every worker
at any corpus size, while all others stay in distributed tables. What is held decides on the way to a
number alone: what counts as known is a minimum count that is the same for all corpora.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from xxhash import xxh3_64_intdigest

from sparkloom.llm.common import mix, slices, store

END = b" "  # no word holds a space
NOT_YET = -2
FLUSH_WORDS, FLUSH_KEYS, KEYS_IN_BUCKET = 100_000, 500_000, 1_000_000


def word_hash(word: bytes, seed: int = 0) -> int:
    return xxh3_64_intdigest(word, seed)


def count_words(texts: DataFrame, tokens_of: Callable[[dict], Iterator[tuple[int, list[bytes]]]], label: str) -> DataFrame:
    """Stored (seed, h, n): how often each token occurs. ``tokens_of`` turns a batch into pairs of a hash seed and a token list."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for seed, found in counts.items():
                if found:
                    hashes = np.fromiter((word_hash(w, seed) for w in found), dtype=np.uint64, count=len(found))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), seed, dtype=np.int64)), pa.array(hashes.view(np.int64)),
                                                      pa.array(list(found.values()), type=pa.int64())], names=["seed", "h", "n"])
            counts.clear()

        for batch in batches:
            for seed, tokens in tokens_of(batch):
                counts.setdefault(seed, Counter()).update(tokens)
                if sum(map(len, counts.values())) > FLUSH_WORDS:
                    yield from flush()
        yield from flush()

    return store(texts.mapInArrow(count, "seed long, h long, n long").groupBy("seed", "h").agg(F.sum("n").alias("n")), label)


def planes(values: np.ndarray) -> bytes:
    """Byte planes: the many zero bytes stand together and are compressed away on their way."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def count_keys(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], n_tokens: int, label: str, least: int = 1) -> DataFrame:
    """Stored (key, n) of integer keys that occur ``least`` times; each task sorts and sums its keys, and sends one block to each bucket.

    Buckets are ranges of a hash of the key, about ``KEYS_IN_BUCKET`` keys each: a hot key comes once from each block.
    """
    buckets = max(256, math.ceil(n_tokens / KEYS_IN_BUCKET))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            bucket = mix(keys.view(np.uint64)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            names, first = np.unique(bucket[order], return_index=True)
            keys, counts = keys[order], counts[order].astype(np.uint32)
            cuts = [*first, len(keys)]
            pieces = [(planes(np.diff(keys[a:b], prepend=0)), planes(counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array([p[0] for p in pieces], type=pa.binary()),
                                              pa.array([p[1] for p in pieces], type=pa.binary())], names=["bucket", "keys", "counts"])

        for batch in slices(batches):
            held.append(keys_of(batch))
            if sum(map(len, held)) > FLUSH_KEYS:
                yield from flush()
        if sum(map(len, held)):
            yield from flush()

    def merge(block: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.cumsum(from_planes(k, np.int64)) for k in block["keys"]])
        counts = np.concatenate([from_planes(c, np.uint32) for c in block["counts"]])
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        n = np.add.reduceat(counts[order].astype(np.int64), first)
        return pd.DataFrame({"key": keys[n >= least], "n": n[n >= least]})

    sent = rows.mapInArrow(blocks, "bucket long, keys binary, counts binary")
    return store(sent.groupBy("bucket").applyInPandas(merge, "key long, n long"), label)


def least_count(share: float, n_tokens: int, min_count: int) -> int:
    """Occurrences that at most 1 / share words or n-grams can have: a bound for what is held, never for what is known."""
    return max(min_count, math.ceil(share * n_tokens))


def held_least(counts: DataFrame, share: float, n_tokens: int, min_count: int) -> int:
    """The smallest number from ``min_count`` on that at most 1 / share rows of ``counts`` (n) reach."""
    least, room = least_count(share, n_tokens, min_count), int(1 / share)
    sizes = dict(counts.where(F.col("n") >= min_count).groupBy(F.least("n", F.lit(least)).alias("at")).count().collect())  # at most ``least`` rows
    room -= sizes.get(least, 0)
    while least > min_count and sizes.get(least - 1, 0) <= room:
        least -= 1
        room -= sizes.get(least, 0)
    return least


def frequent(counts: DataFrame, key: str, least: int, more: str = "n") -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their counts of at least ``least``: at most tokens / least of them."""
    got = counts.where(F.col("n") >= least).select(key, more).toPandas()
    keys, n = got[key].to_numpy(dtype=np.int64), got[more].to_numpy(dtype=np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def held_columns(table: DataFrame, label: str) -> list[np.ndarray]:
    """Columns (longs or doubles, null is NaN) of a table whose size is bounded, in no order.

    They come as bytes, some partitions at a time, so that the driver holds them once, and little beside them.
    """
    kinds = [np.float64 if f.dataType == T.DoubleType() else np.int64 for f in table.schema]
    names = ["size", *table.columns]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(k) for c, k in zip(batch.columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), *(pa.array([c.tobytes()], type=pa.binary()) for c in columns)], names=names)

    packed = store(table.mapInArrow(pack, ", ".join(["size long", *(f"`{c}` binary" for c in table.columns)])), label)
    size = packed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    out, at = [np.empty(size, dtype=k) for k in kinds], 0
    for row in packed.coalesce(16).toLocalIterator():
        for column, kind, data in zip(out, kinds, row[1:], strict=True):
            column[at:at + row["size"]] = np.frombuffer(data, dtype=kind)
        at += row["size"]
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def bit_places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(keys.view(np.uint64))
    return (x >> np.uint64(64 - bits)).astype(np.int64), (x & np.uint64((1 << bits) - 1)).astype(np.int64)


def key_filter(keys: DataFrame, bits: int = 27) -> np.ndarray:
    """Filter of 2^bits bits, whatever the size of the column ``key``: all its keys pass, and of others more, the fuller it is."""
    part = 19

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(bit_places(batch.column(0).to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> part), pa.array(at & ((1 << part) - 1))], names=["part", "bit"])

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << part, dtype=bool)
        held[rows["bit"].to_numpy()] = True
        return pd.DataFrame({"part": rows["part"].iloc[:1], "held": [np.packbits(held).tobytes()]})

    held = np.zeros(1 << bits >> 3, dtype=np.uint8)
    parts = keys.select("key").mapInArrow(places, "part long, bit long").distinct()
    for row in parts.groupBy("part").applyInPandas(fill, "part long, held binary").collect():  # at most 2^bits bits
        held[row["part"] << part - 3:(row["part"] + 1) << part - 3] = np.frombuffer(row["held"], dtype=np.uint8)
    return held


def maybe(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that are not in the filter."""
    out = np.ones(len(keys), dtype=bool)
    for at in bit_places(keys, len(held).bit_length() + 2):
        out &= (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


class WordPlaces(dict):
    """Word -> place of its hash in a sorted array, or -1; emptied at ``limit`` entries.

    Words that are not known yet are noted on the way, and looked up together.
    """

    def __init__(self, hashes: np.ndarray, seed: int = 0, limit: int = 250_000):
        super().__init__()
        self.hashes, self.seed, self.limit, self.new = hashes, seed, limit, []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        return NOT_YET

    def of(self, tokens: list[bytes]) -> np.ndarray:
        if len(self) >= self.limit:
            self.clear()
        out = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if self.new:
            new = list(dict.fromkeys(self.new))
            hashes = np.fromiter((word_hash(w, self.seed) for w in new), dtype=np.uint64, count=len(new))
            self.update(zip(new, find(self.hashes, hashes.view(np.int64)).tolist(), strict=True))
            out[out == NOT_YET] = [self[w] for w in self.new]
            self.new.clear()
        return out
