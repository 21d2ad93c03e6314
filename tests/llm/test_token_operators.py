import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import packing, token_counts, token_files, tokens
from sparkloom.llm.common import folder
from sparkloom.llm.tokens import TextEncoder, tokenizer_path

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
LIBRARY = {n: Tokenizer.from_file(tokenizer_path(n)) for n in NAMES}
ENCODER = {n: TextEncoder(tokenizer_path(n), memo_words=50) for n in NAMES}
PARTS = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "  ", "\n\n", " \n", "don't", "'LL", "İ", "e\u0301", *" \n\t\r\x1c\x85\xa0\u3000aAbz't09.!-é中ſ😀_|"])


def ids(name, text):
    return LIBRARY[name].encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, dtype="<u4").tobytes())


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_memo_gives_the_ids_of_the_library(name, text):
    assert ENCODER[name].encode(text) == np.array(ids(name, text), dtype="<u4").tobytes()


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", NAMES)
def test_counts_equal_the_library_whole_and_spliced(spark, odd_rows, name):
    random.seed(3)
    more = [(100, "x" * 3000, "en", "s"), (101, " ".join(random.choice(["ab", "c.", "don't", "\n", "éé"]) for _ in range(2000)), "en", "s"),
            (102, " " * 900 + "a" + " " * 700, "en", "s"), (103, "<|endoftext|> " * 200, "en", "s")]
    docs = odd_rows.select("doc_id", "text", "lang", "source").unionAll(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    want = sorted((i is not None, i or 0, len((t or "").encode()), len(ids(name, t)), len(ids(name, t)) > 2048) for i, t in rows_of(docs))
    for settings_ in ({}, {"huge_chars": 300, "chunk": 150, "overlap": 9}):
        got = token_counts.count_tokens(docs, tokenizer_path(name), **settings_).collect()
        assert sorted((r[0] is not None, r[0] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want


def test_counts_of_an_empty_table(no_rows):
    assert token_counts.count_tokens(no_rows, tokenizer_path(NAMES[0])).count() == 0


def test_token_files_round_trip(spark, odd_rows, tmp_path):
    path, name = str(tmp_path / "tokens"), NAMES[0]
    token_files.write_token_files(odd_rows, path, tokenizer_path(name))
    rows = token_files.with_start(token_files.read_token_files(spark, path))
    want = sorted(rows_of(odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = sorted(rows.collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["ids"]) for r in got] == [(i, [*ids(name, t), 1]) for i, t in want]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    digest = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in token_files.token_digest(rows).collect()}
    assert digest == {(r["doc_id"], r["start"]): (len(r["ids"]), crc(r["ids"])) for r in got}
    assert sorted(r["start"] for r in token_files.read_metadata(spark, path).collect()) == [r["start"] for r in got]


def test_token_files_are_read_selectively(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.range(3000).selectExpr("id as doc_id", "concat('word ', id) as text")
    path = str(tmp_path / "tokens")
    token_files.write_token_files(docs, path, tokenizer_path(NAMES[0]))
    part = token_files.read_token_files(spark, path, (100, 120))
    assert part.count() == 21
    plan = part.select("doc_id", "ids")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan
    assert "ids" not in token_files.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    file = next((tmp_path / "tokens").glob("part-*"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
    assert "RLE_DICTIONARY" in columns["ids"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_column_index and columns["ids"].has_offset_index


def test_token_files_of_an_empty_table(spark, no_rows, tmp_path):
    token_files.write_token_files(no_rows, str(tmp_path / "t"), tokenizer_path(NAMES[0]))
    assert token_files.with_start(token_files.read_token_files(spark, str(tmp_path / "t"))).count() == 0


@pytest.mark.parametrize("length", [7, 2048])
def test_packing_is_gapless_and_whole(spark, odd_rows, no_rows, length):
    name = NAMES[1]
    pieces = packing.pack(odd_rows, tokenizer_path(name), length=length, with_ids=True)
    got = sorted(pieces.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    stream = [x for r in got for x in r["ids"]]
    total = sum(len(ids(name, t)) + 1 for _, t in rows_of(odd_rows))
    assert len(stream) == total
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == crc(r["ids"]) and r["offset"] + r["length"] <= length
    place = 0
    for r in got:
        assert (r["sequence_id"], r["offset"]) == divmod(place, length)
        place += r["length"]
    whole, texts = [], sorted(ids(name, t) + [1] for _, t in rows_of(odd_rows))
    for r in got:
        if r["start"] == 0:
            whole.append([])
        assert r["start"] == len(whole[-1]) and r["doc_tokens"] >= r["start"] + r["length"]
        whole[-1] += r["ids"]
    assert sorted(whole) == texts
    windows = {r["sequence_id"]: r["ids"] for r in packing.sequences(pieces).collect()}
    assert [x for s in sorted(windows) for x in windows[s]] == stream
    assert packing.pack(no_rows, tokenizer_path(name)).count() == 0


def test_packed_ids_are_read_like_lists(spark, odd_rows):
    rows = token_files.encoded_rows(odd_rows, tokenizer_path(NAMES[1]), 1, packed=True).select("ids").toArrow().column(0).combine_chunks()
    lists = token_files.encoded_rows(odd_rows, tokenizer_path(NAMES[1]), 1).select("ids").toArrow().column(0).combine_chunks()
    for packed, plain in [(rows, lists), (rows.slice(2, 3), lists.slice(2, 3)), (rows.slice(0, 0), lists.slice(0, 0))]:
        ends, values = packing.id_lists(packed)
        assert [values[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == plain.to_pylist()


@pytest.mark.parametrize("text", ["", "a b\nc", "a  b", "a \nb", "a\tb", "a\t b", "a\x85b", "a b\u2003c", "\u00e9 b", "\u00a0", "\u3000x", "\u20ac 5"])
def test_places_of_white_space_are_told_from_bytes(text):
    data = text.encode()
    assert tokens.spaces_meet(data) == bool(tokens.SPACE_RUN.search(data))
    assert tokens.has_wide_space(text, data) == bool(tokens.WIDE_SPACE.search(text))


def test_scratch_is_the_shared_folder(spark):
    assert folder(spark)
