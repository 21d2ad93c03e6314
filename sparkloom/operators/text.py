"""Vocabularies, encoding, TF-IDF, summaries and next-word suggestion."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.functions import text as tx
from sparkloom.functions.stem import porter
from sparkloom.operators.ordered import with_ordinal
from sparkloom.operators.skew import dimension_join, fits_broadcast
from sparkloom.runtime import cut_lineage


DOCUMENTS_AT_ONCE = 128
WORDS_AT_ONCE = 1 << 18


# ---- words of a corpus ------------------------------------------------------

def word_counts(df: DataFrame, tokens: str) -> DataFrame:
    """Occurrences of every word; counted before the shuffle, so a hot word is no burden."""
    return df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def per_document(fn: Callable, returns: str):
    """Column function that applies ``fn`` to one array column; a document stays one row, so no text is moved. Null is empty.

    Few documents at a time are Python objects, whatever the size of a batch.
    """
    kind = to_arrow_type(T.DataType.fromDDL(returns))

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arrays in batches:
            parts = [pa.array([fn([] if a is None else a) for a in arrays.slice(at, DOCUMENTS_AT_ONCE).to_pandas()], type=kind)
                     for at in range(0, len(arrays), DOCUMENTS_AT_ONCE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    return run


def held_rows(table: DataFrame, cols: list[str], max_rows: int = 500_000, max_bytes: int = 256) -> pa.Table | None:
    """The table's rows, if every worker can hold them; None if it has more rows, or one with longer texts. The table is evaluated once."""
    fields = table.select(*cols).schema.fields
    size = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) for f in fields if isinstance(f.dataType, T.StringType)), F.lit(0))
    rows = table.select(*(F.when(size <= max_bytes, F.col(f.name)).alias(f.name) for f in fields), (size > max_bytes).alias("__long")) \
        .limit(max_rows + 1).toArrow()
    return None if rows.num_rows > max_rows or pc.any(rows["__long"]).as_py() else rows.drop_columns(["__long"])


def small_lookup(table: DataFrame, key: str, value: str, max_rows: int = 500_000, max_bytes: int = 256) -> Callable[[], dict] | None:
    """A dictionary that every worker can hold, or None if the table is larger.

    Null keys and values are no entries. Of several values of a key the smallest counts, as in ``joined_lookup``.
    """
    rows = held_rows(table, [key, value], max_rows, max_bytes)
    if rows is None:
        return None
    held: dict = {}
    for k, v in zip(rows[0].to_pylist(), rows[1].to_pylist(), strict=True):
        if k is not None and v is not None and (k not in held or v < held[k]):
            held[k] = v
    shared = table.sparkSession.sparkContext.broadcast(held)
    return lambda: shared.value


def coded(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row ends, place of each element among the distinct ones, distinct elements) of an Arrow list column; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    codes = column.flatten().dictionary_encode("encode")
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), codes.indices.to_numpy(zero_copy_only=False), codes.dictionary


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole rows of every batch with about ``WORDS_AT_ONCE`` elements of its last column at a time, so that what is made of them
    does not grow with a batch; a row with more is a slice by itself or ends one."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        before = (np.cumsum(sizes, dtype=np.int64) - sizes) // WORDS_AT_ONCE
        starts = np.flatnonzero(np.diff(before, prepend=-1)).tolist()
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)


def element_wise(df: DataFrame, key: list[str], array: str | Column, change: Callable[[list], pa.Array], name: str, element: T.DataType,
                 keep_nulls: bool = False) -> DataFrame:
    """(*key, name): every array element replaced by what ``change`` gives for the distinct ones of a slice; nulls it gives are left out or kept.

    A row stays one row, and a word that occurs often costs one lookup for each slice.
    """
    schema = T.StructType([*df.select(*key).schema.fields, T.StructField(name, T.ArrayType(element))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ends, codes, distinct = coded(batch.column(batch.num_columns - 1))
            new = change(distinct.to_pylist())
            kept = new.is_valid().to_numpy(zero_copy_only=False)[codes] | keep_nulls if len(codes) else np.empty(0, dtype=bool)
            ends = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)[ends]
            lists = pa.ListArray.from_arrays(pa.array(ends), new.take(pa.array(codes[kept], type=pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=schema.names)

    return df.select(*key, F.col(array) if isinstance(array, str) else array).mapInArrow(run, schema)


def joined_lookup(df: DataFrame, key: list[str], array: str, table: DataFrame, on: str, value: str, item: Callable[[Column, Column], Column],
                  name: str, keep_nulls: bool = False) -> DataFrame:
    """(*key, name): array elements looked up in a table that is too large to hold, by a join.

    ``item(element, value)`` is the new element, null to leave it out (or to keep a null); ``value`` is null without an entry, and of several entries the
    smallest. Rows are numbered first, so equal keys stay apart, and no name of ``df`` or the table meets another.
    """
    numbered = df.select(F.struct(*key).alias("__key"), F.col(array).alias("__a"), F.monotonically_increasing_id().alias("__row"))
    flat = numbered.select("__key", "__row", F.posexplode_outer("__a").alias("__pos", "__w"))
    entries = table.groupBy(F.col(on).alias("__w")).agg(F.min(value).alias("__v"))
    known = dimension_join(flat, entries, "__w", "left")
    new = item(F.col("__w"), F.col("__v"))
    place = F.when(F.col("__pos").isNotNull() & (F.lit(keep_nulls) | new.isNotNull()), F.struct("__pos", new.alias("new")))
    packed = known.groupBy("__row").agg(F.first("__key").alias("__key"), F.array_sort(F.collect_list(place)).alias("__s"))
    return packed.select("__key.*", F.transform("__s", lambda x: x["new"]).alias(name))


def norm_freq(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """Word counts of every document divided by its largest count, counted where the document is."""
    def counted(words):
        counts = Counter(w for w in words if w is not None)
        top = max(counts.values(), default=1)
        return [(w, c, c / top) for w, c in counts.items()]

    return df.select(key, F.inline(per_document(counted, "array<struct<word string, cnt bigint, freq double>>")(tokens)))


def distinct_tokens(df: DataFrame, tokens: str) -> DataFrame:
    return distinct_words(df, tokens, "token").orderBy("token")


def distinct_words(df: DataFrame, tokens: str | Column, name: str = "word") -> DataFrame:
    """Distinct elements of an array column; those of a row are made distinct before they are taken apart."""
    return df.select(F.explode(F.array_distinct(tokens)).alias(name)).distinct()


def first_seen(df: DataFrame, tokens: str, order_by: list[str]) -> DataFrame:
    """Words with count and the place of their first occurrence: the row, and the number of
    other words that come before it there."""
    # Every occurrence is sent for the count, every distinct word of a row for the place; a row's
    # place is unique per word, so plain minima find it.
    every = F.transform(tokens, lambda t: F.struct(t.alias("word"), F.lit(1).alias("o"), F.lit(None).cast("int").alias("pos")))
    once = F.transform(F.array_distinct(tokens), lambda t, i: F.struct(t.alias("word"), F.lit(0).alias("o"), i.alias("pos")))
    flat = df.select(*order_by, F.inline(F.concat(every, once)))
    row = F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)
    at = F.when(F.col("pos").isNotNull(), row)
    found = flat.groupBy("word").agg(F.sum("o").alias("cnt"), F.min(at).alias("p"), F.min_by("pos", at).alias("first_pos"))
    first = [F.col("p" if len(order_by) == 1 else f"p.{c}").alias(f"first_{c}") for c in order_by]
    return found.select("word", "cnt", *first, "first_pos")


def most_common(df: DataFrame, tokens: str, order_by: list[str], n: int | None = None) -> DataFrame:
    """Words by falling count, ties by first occurrence, with their 1-based rank."""
    seen = first_seen(df, tokens, order_by).withColumn("__neg", -F.col("cnt"))
    keys = ["__neg", *[f"first_{c}" for c in [*order_by, "pos"]]]
    if n is not None:
        seen = seen.orderBy(*keys).limit(n)
    return with_ordinal(seen, keys, name="rank", derived=True).select("word", "cnt", "rank")


# ---- vocabularies -----------------------------------------------------------

def frequency_vocab(df: DataFrame, tokens: str, order_by: list[str], num_words: int) -> DataFrame:
    """Ids 1..V by frequency, ``<UNK>`` = V + 1; 0 is left for padding."""
    top = cut_lineage(most_common(df, tokens, order_by, num_words).select("word", F.col("rank").alias("id")))
    unk = top.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select(F.lit("<UNK>").alias("word"), "id")
    return top.unionByName(unk)


def first_seen_vocab(df: DataFrame, tokens: str, order_by: list[str]) -> DataFrame:
    """``<PAD>`` = 0, ``<UNK>`` = 1, words from 3 on in order of first appearance."""
    seen = first_seen(df, tokens, order_by)
    ids = with_ordinal(seen, [f"first_{c}" for c in [*order_by, "pos"]], name="id", derived=True)
    # Names and numbers of the special tokens.
    fixed = df.sparkSession.createDataFrame([("<PAD>", 0), ("<UNK>", 1)], "word string, id bigint")
    return ids.select("word", (F.col("id") + 2).alias("id")).unionByName(fixed)


SPECIALS = ("[PAD]", "[SEP]", "[CLS]", "[UNK]")  # fixed values


def set_vocab(df: DataFrame, tokens: str, specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """Distinct words and special tokens, 0-based ids in sorted order."""
    extra = df.sparkSession.createDataFrame([(s,) for s in specials], "word string")
    all_words = distinct_words(df, tokens).unionByName(extra).distinct()
    return with_ordinal(all_words, ["word"], name="id", derived=True).withColumn("id", F.col("id") - 1)


def char_vocab(df: DataFrame, text: str) -> DataFrame:
    """Sorted distinct characters with 0-based ids."""
    chars = distinct_words(df, tx.characters(text))
    return with_ordinal(chars, ["word"], name="id", derived=True).withColumn("id", F.col("id") - 1)


def encode_tokens(df: DataFrame, key: list[str], tokens: str, vocab: DataFrame, unk: int | None = None,
                  name: str = "ids") -> DataFrame:
    """Token arrays to id arrays; a word without an id gets ``unk`` (or is left out when unk is None); null gives an empty array.

    With a vocabulary that workers can hold, a document stays one row. With a larger one its words are joined; the answer is the same.
    """
    ids = small_lookup(vocab, "word", "id")
    if ids is not None:
        return element_wise(df, key, tokens, lambda words: pa.array([ids().get(w, unk) for w in words], type=pa.int64()), name, T.LongType())
    none = F.lit(unk).cast("bigint")
    return joined_lookup(df, key, tokens, vocab, "word", "id", lambda word, i: F.coalesce(i.cast("bigint"), none), name)


def decode_tokens(df: DataFrame, key: list[str], ids: str, vocab: DataFrame, pad: int = 0, unknown: str = "<CLS>",
                  name: str = "tokens") -> DataFrame:
    """Id arrays to words: padding and nulls are dropped, an id without a word gives ``unknown``."""
    words = small_lookup(vocab, "id", "word")
    if words is not None:
        def decode(found: list) -> pa.Array:
            return pa.array([None if i is None or i == pad else words().get(i, unknown) for i in found], type=pa.string())

        return element_wise(df, key, ids, decode, name, T.StringType())
    return joined_lookup(df, key, ids, vocab, "id", "word", lambda i, word: F.when(i != pad, F.coalesce(word, F.lit(unknown))), name)


def roundtrip(df: DataFrame, key: list[str], tokens: str, vocab: DataFrame) -> DataFrame:
    """Known words stay, all others become ``<UNK>``."""
    unk = vocab.filter(F.col("word") == "<UNK>").select("id").first()[0]
    ids = encode_tokens(df, key, tokens, vocab, unk)
    return decode_tokens(ids, key, "ids", vocab, pad=0, unknown="<UNK>")


def encode_plus(df: DataFrame, key: list[str], tokens: str, vocab: DataFrame, max_length: int, cls: int, sep: int,
                unk: int, pair: str | None = None) -> DataFrame:
    """ids with special tokens, attention mask and segment ids, all ``max_length`` long."""
    first = encode_tokens(df, key, tokens, vocab, unk, "a")
    mark = lambda i: F.array(F.lit(i).cast("bigint"))
    if pair is None:
        body = F.concat(mark(cls), F.slice("a", 1, max_length - 2), mark(sep))
        segment = F.transform(body, lambda _: F.lit(0).cast("bigint"))
        both = first
    else:
        both = first.join(encode_tokens(df, key, pair, vocab, unk, "b"), key)
        # Cut the longer side first, as a longest-first truncation ends up doing.
        room = max_length - 3
        na, nb = F.size("a"), F.size("b")
        half = F.lit(room) / 2
        ka = F.when(na + nb <= room, na).when(nb <= F.floor(half), room - nb).otherwise(F.least(na, F.ceil(half)))
        kb = F.least(nb, room - ka)
        left = F.concat(mark(cls), F.slice("a", F.lit(1), ka.cast("int")), mark(sep))
        right = F.concat(F.slice("b", F.lit(1), kb.cast("int")), mark(sep))
        body = F.concat(left, right)
        segment = F.concat(F.transform(left, lambda _: F.lit(0).cast("bigint")),
                           F.transform(right, lambda _: F.lit(1).cast("bigint")))
    ones = F.transform(body, lambda _: F.lit(1).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    return both.select(*key, tx.pad_truncate(body, max_length, value=zero).alias("input_ids"),
                       tx.pad_truncate(ones, max_length, value=zero).alias("attention_mask"),
                       tx.pad_truncate(segment, max_length, value=zero).alias("token_type_ids"))


# ---- words to base forms ----------------------------------------------------

def replace_words(df: DataFrame, key: list[str], tokens: str, mapping: DataFrame, name: str = "tokens") -> DataFrame:
    """Replace words by a (word, base) lookup; words without an entry stay, and so do nulls; a null array gives an empty one.

    A lookup that workers can hold is applied in place. A larger one is joined with the words, with the same answer.
    """
    mapping = cut_lineage(mapping.select("word", "base"))
    bases = small_lookup(mapping, "word", "base")
    if bases is not None:
        return element_wise(df, key, tokens, lambda words: pa.array([bases().get(w, w) for w in words], type=pa.string()), name,
                            T.StringType(), keep_nulls=True)
    return joined_lookup(df, key, tokens, mapping, "word", "base", lambda word, base: F.coalesce(base, word), name, keep_nulls=True)


def stem_vocab(df: DataFrame, tokens: str) -> DataFrame:
    """Every distinct word once, with its stem."""
    return distinct_words(df, tokens).withColumn("base", porter(F.col("word")))


def stem(df: DataFrame, key: list[str], tokens: str) -> DataFrame:
    return replace_words(df, key, tokens, stem_vocab(df, tokens))


def lemmatize(df: DataFrame, key: list[str], tokens: str, lemma_table: DataFrame, pos: str = "n") -> DataFrame:
    """Lemma lookup in a (form, pos, lemma) table; identity where the form is absent."""
    forms = lemma_table.filter(F.col("pos") == pos).groupBy("form").agg(F.min("lemma").alias("base"))
    return replace_words(df, key, tokens, forms.withColumnRenamed("form", "word"))


def remove_stop_words(df: DataFrame, key: list[str], tokens: str, stop: DataFrame | list[str]) -> DataFrame:
    """Drop stop words and null tokens, keeping order and repeats; a null array stays null.

    ``stop`` is a list or a one-column table ``word``; a large table is joined, with the same answer.
    """
    if not isinstance(stop, list):
        if fits_broadcast(stop, 5_000):
            stop = [r[0] for r in stop.select("word").distinct().collect()]
        else:
            flat = df.select(*key, F.col(tokens).isNull().alias("__none"), F.posexplode_outer(tokens).alias("pos", "word"))
            hit = dimension_join(flat, stop.select("word").distinct().withColumn("__s", F.lit(True)), "word", "left")
            item = F.when(F.col("__s").isNull() & F.col("word").isNotNull(), F.struct("pos", "word"))
            packed = hit.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("__l"), F.first("__none").alias("__none"))
            return packed.select(*key, F.when(~F.col("__none"), F.transform("__l", lambda s: s["word"])).alias(tokens))
    kept = F.filter(tx.drop_words(F.col(tokens), [w for w in stop if w is not None]), lambda t: t.isNotNull())
    return df.withColumn(tokens, kept).select(*key, tokens)


def clean_text(df: DataFrame, key: list[str], col: str, stop_words: list[str], c_type: str = "lemma",
               lemma_table: DataFrame | None = None) -> DataFrame:
    """Lower-case, then URLs, tags, punctuation, emoji, base forms, stop words: in this order."""
    bare = tx.strip_emoji(tx.strip_punct(tx.strip_html(tx.strip_urls(tx.to_lower(col)))))
    split = df.select(*key, F.filter(tx.word_pieces(bare), lambda t: t != "").alias("tokens"))
    if c_type == "stem":
        split = stem(split, key, "tokens")
    elif c_type == "lemma" and lemma_table is not None:
        split = lemmatize(split, key, "tokens", lemma_table)
    kept = tx.drop_words(tx.alphabetic(F.col("tokens")), stop_words)
    return split.select(*key, F.array_join(kept, " ").alias(col))


# ---- TF-IDF and summaries ---------------------------------------------------

def tfidf_vocab(df: DataFrame, key: str, tokens: str, min_df: int, max_df: float, max_features: int | None) -> DataFrame:
    """(term, idf): smooth idf of the terms within the document-frequency bounds."""
    n = df.count()
    # A document sends each of its terms once for df and every occurrence for the total; both are
    # summed before the shuffle, so (term, document) pairs never travel.
    marks = F.concat(F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("o"))),
                     F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("o"))))
    stats = df.select(F.inline(marks)).groupBy("term").agg(F.sum("d").alias("df"), F.sum("o").alias("total"))
    kept = stats.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n))
    if max_features is not None:
        kept = kept.orderBy(F.col("total").desc(), "term").limit(max_features)
    return kept.select("term", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))


def tfidf(df: DataFrame, key: str, tokens: str, min_df: int = 2, max_df: float = 0.6, max_features: int | None = 2000,
          vocab: DataFrame | None = None) -> DataFrame:
    """L2-normalised TF-IDF weights in long form (key, term, weight)."""
    vocab = vocab if vocab is not None else cut_lineage(tfidf_vocab(df, key, tokens, min_df, max_df, max_features))
    idf = small_lookup(vocab, "term", "idf")
    if idf is not None:
        schema = T.StructType([df.schema[key], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_slices(batches):
                ends, codes, terms = coded(batch.column(1))
                known = np.array([idf().get(w, np.nan) for w in terms.to_pylist()], dtype=np.float64)
                row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
                held = ~np.isnan(known[codes]) if len(codes) else np.empty(0, dtype=bool)
                cell, count = np.unique(row[held] * max(len(known), 1) + codes[held], return_counts=True)
                row, term = np.divmod(cell, max(len(known), 1))
                weight = count * known[term] if len(term) else np.empty(0)
                weight = weight / np.sqrt(np.bincount(row, weight * weight, batch.num_rows))[row]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), terms.take(pa.array(term)), pa.array(weight)], names=schema.names)

        return df.select(key, tokens).mapInArrow(weigh, schema)
    # A vocabulary too large to hold: its words are joined, those outside it are dropped before anything is counted.
    known = dimension_join(df.select(key, F.explode(tokens).alias("term")), vocab, "term")
    raw = known.groupBy(key, "term", "idf").agg(F.count(F.lit(1)).alias("tf")) \
        .select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / length).alias("weight"))


def top_fraction(df: DataFrame, group: str, score: str, frac: float, tie: str) -> DataFrame:
    """The best ``int(frac * n)`` rows of every group with their rank; groups must be document-sized."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(F.col(score).desc(), tie))) \
        .withColumn("__n", F.count(F.lit(1)).over(w))
    return ranked.filter(F.col("rank") <= F.floor(F.col("__n") * F.lit(frac))).drop("__n")


def best_sentences(frac: float) -> Callable:
    """Places of the best sentences, given as lists of their words, by falling score: the sum over a sentence's words
    of their count in the document divided by the largest one. Sentences without words have no score; ties go to the earlier."""
    def choose(sentences):
        sentences = [[] if s is None else list(s) for s in sentences]
        counts = Counter(w for s in sentences for w in s)
        top = max(counts.values(), default=1)
        scored = [(-round(sum(counts[w] / top for w in s), 9), i) for i, s in enumerate(sentences) if s]
        return [i for _, i in sorted(scored)[:int(frac * len(scored))]]

    return choose


def summarize(df: DataFrame, key: str, col: str, frac: float = 0.30) -> DataFrame:
    """Extractive summary: the best sentences in order of score, joined by a space. A document stays one row."""
    docs = df.select(key, F.coalesce(tx.split_sentences(col), F.array().cast("array<string>")).alias("__s"))
    words = F.transform("__s", lambda s: tx.alphabetic(tx.words(s)))
    order = docs.select(key, "__s", per_document(best_sentences(frac), "array<int>")(words).alias("__o"))
    pick = F.array_join(F.transform("__o", lambda i: F.get(F.col("__s"), i)), " ")
    return order.select(key, pick.alias("summary"), F.size("__o").alias("sentences"))


# ---- next-word suggestion ---------------------------------------------------

def fit_ngrams(df: DataFrame, tokens: str, n: int, k: int = 3) -> DataFrame:
    """The k most frequent next words of every context of 1..n words, with counts and rank."""
    orders = []
    for size in range(1, n + 1):
        pairs = df.select(F.explode(tx.ngram_pairs(tokens, size)).alias("g"))
        orders.append(pairs.select(F.lit(size).alias("size"), F.array_join("g.context", " ").alias("context"),
                                   F.col("g.target").alias("next")))
    flat = reduce(lambda a, b: a.unionByName(b), orders)
    counts = flat.groupBy("size", "context", "next").agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy("size", "context").orderBy(F.col("cnt").desc(), "next")
    # Rank limits apply before the shuffle, so a context of a very frequent word stays small.
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def suggest(df: DataFrame, key: list[str], tokens: str, model: DataFrame, n: int, steps: int = 1) -> DataFrame:
    """Extend every row by its best next word, ``steps`` times, backing off to shorter contexts."""
    best = model.filter("rank = 1").select("size", "context", "next")
    out = df.select(*key, F.col(tokens).alias("__t"), F.array().cast("array<string>").alias("suggested"))
    for step in range(steps):
        if step % 5 == 4:
            out = cut_lineage(out)  # long extensions keep a short plan
        for size in range(n, 0, -1):
            ctx = F.when(F.size("__t") >= size, F.array_join(F.slice("__t", F.size("__t") - (size - 1), F.lit(size)), " "))
            side = best.filter(F.col("size") == size).select(F.col("context").alias("__c"), F.col("next").alias(f"__n{size}"))
            out = dimension_join(out.withColumn("__c", ctx), side, "__c", "left", probe=True).drop("__c")
        nxt = F.coalesce(*[F.col(f"__n{s}") for s in range(n, 0, -1)])
        grown = [F.when(nxt.isNotNull(), F.concat(c, F.array(nxt))).otherwise(F.col(c)).alias(c) for c in ("__t", "suggested")]
        out = out.select(*key, *grown)
    return out.select(*key, "suggested")
