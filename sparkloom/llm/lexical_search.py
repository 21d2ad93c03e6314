"""Ranked lexical search without a document index: the items' terms go out as one automaton, the texts are scanned.

A term is guarded by a blank on either side, and every character that belongs to no term becomes a blank, so an
Aho-Corasick pass over a whole text yields the term frequencies and nothing else. The automaton's outputs are term
numbers; a small sparse table maps them to items.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.llm.common import ascii_lower, slices, store

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: By byte: letters lower-cased, digits and all of UTF-8 beyond ASCII as they are, the rest a blank.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 2000
MERGE_AT = 1 << 18
RESULT = "item bigint, doc_id bigint, score bigint"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def guarded(term: str) -> str:
    """A term as the automaton meets it: a character for each byte."""
    return f" {term.encode().decode('latin-1')} "


def scanned(data: bytes | None) -> tuple[str, int]:
    """The text in the automaton's alphabet, and the number of its terms."""
    plain = b" " + (data or b"").translate(BYTES) + b" "
    inside = np.frombuffer(plain, dtype=np.uint8) != 32
    return plain.decode("latin-1"), int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.empty(0, dtype=np.int32)))


def term_counts(documents: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """Stored (doc_id, n, terms, tfs) of every document with a term of its own: its length, and how often it holds which shared terms."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, term in enumerate(shared.value[0]):
            automaton.add_word(guarded(term), number)
        automaton.make_automaton()
        find, number_of = automaton.iter if len(automaton) else lambda text: (), itemgetter(1)
        for batch in slices(batches):
            rows, sizes, terms, counts = [], [], [], []
            for row, value in enumerate(batch.column(1)):
                text, size = scanned(value.as_py())
                if size:
                    found = Counter(map(number_of, find(text)))
                    rows.append(row)
                    sizes.append(size)
                    terms.append(np.fromiter(found.keys(), dtype=np.int32, count=len(found)))
                    counts.append(np.fromiter(found.values(), dtype=np.int32, count=len(found)))
            ids = batch.column(0).take(pa.array(rows, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, type=pa.int64()), lists(terms), lists(counts)], names=["doc_id", "n", "terms", "tfs"])

    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return store(texts.mapInArrow(scan, "doc_id bigint, n bigint, terms array<int>, tfs array<int>"), "term-counts")


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each value, value)."""
    ends = column.offsets.to_numpy()
    return np.repeat(np.arange(len(column)), np.diff(ends)), column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]


def document_frequencies(counted: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term; a task adds up its own before anything is sent, at most ``n_terms`` rows come back."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            total += np.bincount(flat(batch.column(0))[1], minlength=n_terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "df"])

    out = np.zeros(n_terms, dtype=np.int64)
    rows = counted.select("terms").mapInArrow(add_up, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out[rows["term"].to_numpy()] = rows["df"].to_numpy()
    return out


class Best:
    """The k best (score, smaller id) of each item among the entries added so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, dtype=np.int64)
        self.kept = tuple(np.empty(0, dtype=np.int64) for _ in range(4))
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.n_waiting = 0

    def add(self, item: np.ndarray, score: np.ndarray, missing: np.ndarray, doc: np.ndarray) -> None:
        self.waiting.append((item, score, missing, doc))
        self.n_waiting += len(item)
        if self.n_waiting >= MERGE_AT:
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        item, score, missing, doc = (np.concatenate(c) for c in zip(self.kept, *self.waiting, strict=True))
        order = np.lexsort((doc, missing, -score, item))
        item, score, missing, doc = item[order], score[order], missing[order], doc[order]
        starts = np.concatenate([[True], item[1:] != item[:-1]]) if len(item) else np.empty(0, dtype=bool)
        place = np.arange(len(item)) - np.maximum.accumulate(np.where(starts, np.arange(len(item)), 0))
        first, last = place < self.k, place == self.k - 1
        self.least[item[last]] = score[last]
        self.kept, self.waiting, self.n_waiting = (item[first], score[first], missing[first], doc[first]), [], 0
        return self.kept


def ranked_documents(counted: DataFrame, shared, weights, k: int, totals: tuple[int, int], exact_floats: bool) -> DataFrame:
    """(item, doc_id, score): the k best of each task for each item."""
    n_docs, all_terms = totals

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, starts, items, n_items = shared.value
        weight, per_term = weights.value, np.diff(starts)
        best = Best(n_items, k)
        for batch in slices(batches, max(1, (1 << 20) // n_items)):
            row, term = flat(batch.column(2))
            tf = flat(batch.column(3))[1].astype(np.int64)
            m = 50 + 50 * batch.column(1).to_numpy() * n_docs // all_terms
            part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
            wide = per_term[term]
            item = items[np.repeat(starts[term] - np.concatenate([[0], np.cumsum(wide)[:-1]]), wide) + np.arange(wide.sum())] if len(term) else term
            cell, part = np.repeat(row, wide) * n_items + item, np.repeat(part, wide)
            if exact_floats:
                scores = np.bincount(cell, weights=part, minlength=batch.num_rows * n_items).astype(np.int64)
            else:
                scores = np.zeros(batch.num_rows * n_items, dtype=np.int64)
                np.add.at(scores, cell, part)
            doc, item = np.nonzero(scores.reshape(-1, n_items) >= best.least)
            ids = batch.column(0)
            best.add(item, scores.reshape(-1, n_items)[doc, item], ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)[doc],
                     ids.fill_null(0).to_numpy()[doc])
        item, scores, missing, doc = best.merge()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=missing.astype(bool)), pa.array(scores)], names=["item", "doc_id", "score"])

    return counted.mapInArrow(score, RESULT)


def search(documents: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents with the largest scores above 0, ties to the smaller id.

    Terms are runs of letters, digits and everything beyond ASCII, with A-Z lower-cased; whole texts are read. Null and empty texts
    have no term and no rank. Every row is a document of its own, also where ids repeat; a null id comes after all others. Rows with
    one item_id are one item with the terms of all; an item without a term, and an empty table on either side, gives no row. Other
    columns are not read. Items go out in blocks of about ``block_bytes`` of terms, each of which scans the texts once; an item
    whose own terms take over 16 times that is an error. Every task keeps k rows for each item of the block.
    """
    spark = documents.sparkSession
    terms = store(items.select(F.col(item_col).alias("item_id"), F.explode(F.array_distinct(terms_of(F.col(item_text_col)))).alias("term")).distinct(),
                  "item-terms")
    sizes = terms.groupBy("item_id").agg(F.sum(F.octet_length("term") + 16).alias("size"))
    n_items, total, largest = sizes.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    out_schema = f"item_id {terms.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint"
    if not n_items:
        return spark.createDataFrame([], out_schema)
    if largest > 16 * block_bytes:
        raise ValueError(f"the terms of one item take {largest} bytes; workers hold at most {16 * block_bytes}")
    blocks = max(-(-total // block_bytes), -(-n_items // block_items))
    found, totals = [], None
    for block in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "term").toArrow()  # about block_bytes
        if not rows.num_rows:
            continue
        names, item_of = np.unique(rows["term"].to_numpy(zero_copy_only=False), return_inverse=True)
        ids = rows["item_id"].combine_chunks().dictionary_encode("encode")
        order = np.argsort(item_of, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(item_of, minlength=len(names)))])
        shared = spark.sparkContext.broadcast(
            (names.tolist(), starts, ids.indices.to_numpy()[order].astype(np.int64), len(ids.dictionary)))
        counted = term_counts(documents, shared, id_col, text_col)
        if totals is None:
            totals = tuple(int(x or 0) for x in counted.agg(F.count("*"), F.sum("n")).first())
        if not totals[0]:
            break
        df = document_frequencies(counted, len(names))
        weight = np.array([math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
        per_item = np.bincount(shared.value[2], weights=weight[np.repeat(np.arange(len(names)), np.diff(starts))])
        exact_floats = float(per_item.max()) * 1_000_000 < 2 ** 53
        best = ranked_documents(counted, shared, spark.sparkContext.broadcast(weight), k, totals, exact_floats)
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
        known = spark.createDataFrame([(i, v) for i, v in enumerate(ids.dictionary.to_pylist())], f"item bigint, {out_schema.split(',')[0]}")
        ranked = ranked.join(F.broadcast(known), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found.append(ranked if blocks == 1 else store(ranked, "ranked"))
    if not found:
        return spark.createDataFrame([], out_schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def search_sql(k: int = 50) -> str:
    """The same ranking as DuckDB SQL over ``documents`` and ``benchmark``."""
    def lower(c: str) -> str:
        return f"translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    words = r"'[0-9a-z\x{80}-\x{10FFFF}]+'"
    return f"""
        with docs as (select row_number() over () as r, doc_id, regexp_extract_all({lower('text')}, {words}) as terms from documents),
             size as (select r, doc_id, len(terms) as n from docs where len(terms) > 0),
             total as (select count(*) as docs, cast(sum(n) as bigint) as terms from size),
             asked as (select distinct item_id, unnest(regexp_extract_all({lower('text')}, {words})) as term from benchmark),
             tf as (select r, term, count(*) as tf from (select r, unnest(terms) as term from docs) where term in (select term from asked) group by all),
             weight as (select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w
                        from tf, total group by term, docs),
             scored as (select item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * docs) // total.terms))))) as bigint) as score
                        from asked join tf using (term) join weight using (term) join size using (r), total group by all),
             ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id, r) as rank from scored where score > 0)
        select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= {k}"""
