"""Cleaning against Python's re, vocabularies, encoding, TF-IDF, summaries, suggestion."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.functions.stem import porter
from sparkloom.operators import text as ops

EDGE = ["", "...", "<b>tag</b> x", "a <i\nb> c", "a <i\rb> c", "see https://a.b/c?d now", "www.x.y z", "hi 😀 there ⌚ 你好 한글",
        "Éa-béç, naïve 12 a_b", "two  spaces\t\tand\nline ", "Dr. Who? Yes! No.  End", "it's (50%) #1", "single", None]
STRIP = [(tx.strip_html, lambda s: re.sub("<.*?>", "", s)),
         (tx.strip_urls, lambda s: re.sub(r"https?://\S+|www\.\S+", "", s)),
         (tx.strip_punct, lambda s: s.translate(str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))),
         (tx.strip_emoji, lambda s: re.sub("[\U0001F600-\U0001F64F\U0001F300-\U0001F5FF\U0001F680-\U0001F6FF\U0001F1E0-\U0001F1FF"
                                           "\U00002702-\U000027B0\U000024C2-\U0001F251]+", "", s)),
         (tx.space_punct, lambda s: re.sub(r"[^a-zA-Z.,!?]+", " ", re.sub(r"([.,!?])", r" \1 ", s))),
         (tx.normalize_string, lambda s: re.sub(r"\s+", " ", re.sub(r"[^a-zA-Z.!?]+", " ", re.sub(r"([.!?])", r" \1", s))).strip()),
         (tx.squeeze_spaces, lambda s: " ".join(s.split())),
         (tx.word_split, lambda s: " ".join(re.split(r"\W+", s))),
         (lambda c: tx.word_split(c, True), lambda s: " ".join(w for w in re.split(r"\W+", s.lower()) if w.isalpha())),
         (tx.drop_chars, lambda s: re.sub("[!@#$%^&*()']", "", s))]


@pytest.mark.parametrize("ours,python", STRIP)
def test_cleaning_equals_python_re(spark, ours, python):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(EDGE)], "i int, s string")
    got = [r.o for r in df.select("i", ours(F.col("s")).alias("o")).orderBy("i").collect()]
    assert got == [None if s is None else python(s) for s in EDGE]


def test_sentences(spark):
    got = spark.createDataFrame([(EDGE[10],)], "s string").select(tx.split_sentences("s").alias("o")).first().o
    assert got == ["Dr.", "Who?", "Yes!", "No.", "End"]


def test_porter_cases(spark):
    cases = ("caresses:caress flies:fli dies:die agreed:agre owned:own sized:size meeting:meet stating:state itemization:item "
             "sensational:sensat traditional:tradit reference:refer plotted:plot running:run happy:happi sky:sky enjoy:enjoy "
             "relational:relat conditional:condit rational:ration radicalli:radic vietnamization:vietnam operator:oper "
             "hopefulness:hope sensibiliti:sensibl triplicate:triplic electrical:electr goodness:good adjustment:adjust "
             "adoption:adopt effective:effect rate:rate cease:ceas controll:control fizzed:fizz hopping:hop falling:fall "
             "failing:fail filing:file using:use feed:feed as:as lying:lie")
    rows = [tuple(c.split(":")) for c in cases.split()]
    df = spark.createDataFrame(rows, "w string, e string")
    assert df.filter(porter(F.col("w")) != F.col("e")).collect() == []


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "", "the the the end of the cat"]
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "doc int, tokens array<string>").cache()


def python_tokens(corpus):
    return [r.tokens for r in corpus.orderBy("doc").collect()]


def test_frequency_vocab(corpus):
    flat = [w for t in python_tokens(corpus) for w in t]
    exp = {w: i + 1 for i, (w, _) in enumerate(Counter(flat).most_common(4))}
    got = {r.word: r.id for r in ops.frequency_vocab(corpus, "tokens", ["doc"], 4).collect()}
    assert got == {**exp, "<UNK>": 5}


def test_first_seen_set_and_char_vocab(corpus):
    seen = []
    for t in python_tokens(corpus):
        seen += [w for w in t if w not in seen]
        seen = list(dict.fromkeys(seen))
    got = {r.word: r.id for r in ops.first_seen_vocab(corpus, "tokens", ["doc"]).collect()}
    assert got == {"<PAD>": 0, "<UNK>": 1, **{w: i + 3 for i, w in enumerate(seen)}}
    exp = sorted({*seen, "[PAD]", "[SEP]", "[CLS]", "[UNK]"})
    assert {r.word: r.id for r in ops.set_vocab(corpus, "tokens").collect()} == {w: i for i, w in enumerate(exp)}


def test_encode_decode_identity_and_unknown(corpus, spark):
    vocab = ops.first_seen_vocab(corpus, "tokens", ["doc"])
    ids = ops.encode_tokens(corpus, ["doc"], "tokens", vocab, unk=1)
    back = ops.decode_tokens(ids, ["doc"], "ids", vocab)
    assert [r.tokens for r in back.orderBy("doc").collect()] == python_tokens(corpus)
    other = spark.createDataFrame([(0, ["cat", "zebra"]), (1, None)], "doc int, tokens array<string>")
    small = ops.frequency_vocab(corpus, "tokens", ["doc"], 100)
    out = {r.doc: r.tokens for r in ops.roundtrip(other, ["doc"], "tokens", small).collect()}
    assert out == {0: ["cat", "<UNK>"], 1: []}


def test_encode_plus_and_padding(corpus):
    vocab = ops.frequency_vocab(corpus, "tokens", ["doc"], 100)
    row = ops.encode_plus(corpus.filter("doc = 0"), ["doc"], "tokens", vocab, 6, 101, 102, 99).first()
    assert row.input_ids[0] == 101 and row.input_ids[5] == 102 and row.attention_mask == [1] * 6
    short = ops.encode_plus(corpus.filter("doc = 3"), ["doc"], "tokens", vocab, 6, 101, 102, 99).first()
    assert short.input_ids == [101, 102, 0, 0, 0, 0] and short.attention_mask == [1, 1, 0, 0, 0, 0]
    both = corpus.filter("doc = 1").withColumn("b", F.array(F.lit("cat"), F.lit("end")))
    pair = ops.encode_plus(both, ["doc"], "tokens", vocab, 12, 101, 102, 99, pair="b").first()
    assert pair.token_type_ids == [0] * 5 + [1] * 3 + [0] * 4
    got = corpus.filter("doc = 1").select(tx.pad_truncate("tokens", 5, "pre", "P"), tx.pad_truncate("tokens", 2, value="P")).first()
    assert got[0] == ["P", "P", "the", "dog", "sat"] and got[1] == ["the", "dog"]


def test_windows_of_tokens(spark):
    df = spark.createDataFrame([(list("abcde"),), (["a"],), ([],)], "t array<string>")
    grams = [[(g.context, g.target) for g in r.g] for r in df.select(tx.ngram_pairs("t", 2).alias("g")).collect()]
    assert grams == [[(["a", "b"], "c"), (["b", "c"], "d"), (["c", "d"], "e")], [], []]
    wins = [[(w.start, w.x, w.y) for w in r.w] for r in df.select(tx.token_windows("t", 4).alias("w")).collect()]
    assert wins == [[(0, ["a", "b", "c"], "d"), (1, ["b", "c", "d"], "e")], [], []]
    sh = df.select(tx.shifted_windows("t", 4).alias("w")).first().w
    assert [(w.start, w.x, w.y) for w in sh] == [(0, list("abcd"), list("bcde"))]


def test_prefix_sequences(spark):
    ids = list(range(3, 12))
    got = spark.createDataFrame([(ids,)], "a array<bigint>").select(tx.prefix_sequences("a", 6, 3).alias("p")).first().p
    exp = []
    for i in range(1, len(ids)):
        full = ids[:i + 3][:6]
        full = [0] * (6 - len(full)) + full
        exp.append((full[:-1], full[-1]))
    assert [(p.x, p.y) for p in got] == exp


def test_tfidf_by_hand(corpus):
    docs = python_tokens(corpus)
    n, df = len(docs), Counter(w for t in docs for w in set(t))
    vocab = {w: math.log((1 + n) / (1 + d)) + 1 for w, d in df.items() if 2 <= d <= 0.6 * n}
    exp = {}
    for i, t in enumerate(docs):
        raw = {w: c * vocab[w] for w, c in Counter(t).items() if w in vocab}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        exp.update({(i, w): v / norm for w, v in raw.items()})
    got = {(r.doc, r.term): r.weight for r in ops.tfidf(corpus, "doc", "tokens", 2, 0.6).collect()}
    assert got.keys() == exp.keys() and all(got[k] == pytest.approx(exp[k]) for k in exp)


def test_summary_by_hand(spark):
    text = "The cat sat. A dog ran off! The cat and the dog sat. 42 17. Nothing. Cats purr. The end."
    words = [w for w in re.split(r"\W+", text.lower()) if w.isalpha()]
    freq = Counter(words)
    top = max(freq.values())
    sents = re.split(r"(?<=[.!?])\s+", text)
    score = {s: sum(freq[w] / top for w in re.split(r"\W+", s.lower()) if w.isalpha()) for s in sents}
    score = {s: v for s, v in score.items() if v}
    best = sorted(score, key=lambda s: -score[s])[:int(0.3 * len(score))]
    df = spark.createDataFrame([(1, text), (2, ""), (3, "One. Two.")], "id int, t string")
    got = {r.id: r.summary for r in ops.summarize(df, "id", "t").collect()}
    assert got == {1: " ".join(best), 2: "", 3: ""}


def test_stop_words_by_list_and_by_table(corpus, spark, monkeypatch):
    stops = spark.createDataFrame([("the",), ("a",)], "word string")
    exp = [[w for w in t if w not in ("the", "a")] for t in python_tokens(corpus)]
    for check in (lambda *a, **k: True, lambda *a, **k: False):
        monkeypatch.setattr(ops, "fits_broadcast", check)
        got = ops.remove_stop_words(corpus, ["doc"], "tokens", stops).orderBy("doc").collect()
        assert [r.tokens for r in got] == exp
        odd = spark.createDataFrame([(1, None), (2, ["b", None, "a"]), (3, [])], "doc int, tokens array<string>")
        assert [r.tokens for r in ops.remove_stop_words(odd, ["doc"], "tokens", stops).orderBy("doc").collect()] == [None, ["b"], []]


def test_suggest_backs_off(corpus, spark):
    model = ops.fit_ngrams(corpus, "tokens", 2)
    ask = spark.createDataFrame([(0, ["sat", "on"]), (1, ["zzz", "cat"]), (2, ["zzz"]), (3, [])], "doc int, tokens array<string>")
    got = {r.doc: r.suggested for r in ops.suggest(ask, ["doc"], "tokens", model, 2, steps=2).collect()}
    assert got[0] == ["the", "mat"] and len(got[1]) == 2 and got[2] == [] and got[3] == []


def test_lemma_lookup_and_cleaning(spark):
    lemmas = spark.createDataFrame([("cats", "n", "cat"), ("ran", "v", "run")], "form string, pos string, lemma string")
    df = spark.createDataFrame([(1, "The CATS ran! <b>www.x.y</b> 😀 12 cats2"), (2, None)], "id int, t string")
    out = {r.id: r.t for r in ops.clean_text(df, ["id"], "t", ["the"], "lemma", lemmas).collect()}
    assert out[1] == "cat ran" and not out[2]
    stemmed = {r.id: r.t for r in ops.clean_text(df, ["id"], "t", ["the"], "stem").collect()}
    assert stemmed[1] == "cat ran"


def both_paths(monkeypatch, make):
    """The rows of a query with a held lookup and with a joined one."""
    held = sorted(map(repr, make().collect()))
    monkeypatch.setattr(ops, "small_lookup", lambda *a, **k: None)
    return held, sorted(map(repr, make().collect()))


ODD = [(1, "x", ["b", "a", None, "zz", "a"]), (1, "x", ["a"]), (2, "y", []), (2, None, None), (None, "z", [None, "b"])]


@pytest.mark.parametrize("case", ["encode", "drop", "decode", "replace", "roundtrip", "plus"])
def test_large_lookups_answer_like_held_ones(spark, monkeypatch, case):
    """Keys named like the vocabulary's columns, repeated keys and rows, nulls, repeated entries."""
    df = spark.createDataFrame(ODD, "id bigint, word string, tokens array<string>")
    vocab = spark.createDataFrame([("a", 4), ("b", 9), ("b", 5), (None, 6), ("c", None), ("<UNK>", 8)], "word string, id bigint")
    keys = ["id", "word"]
    make = {
        "encode": lambda: ops.encode_tokens(df, keys, "tokens", vocab, 8),
        "drop": lambda: ops.encode_tokens(df, keys, "tokens", vocab),
        "decode": lambda: ops.decode_tokens(df.select(*keys, F.expr("transform(tokens, t -> case t when 'a' then 4L when 'b' then 5L when 'zz' then 0L end)")
                                                      .alias("ids")), keys, "ids", vocab),
        "replace": lambda: ops.replace_words(df, keys, "tokens", spark.createDataFrame([("a", "A2"), ("a", "A1"), ("b", None)], "word string, base string")),
        "roundtrip": lambda: ops.roundtrip(df, keys, "tokens", vocab),
        "plus": lambda: ops.encode_plus(df, keys, "tokens", vocab, 6, 101, 102, 8),
    }[case]
    held, joined = both_paths(monkeypatch, make)
    assert held == joined and len(held) == len(ODD)
    expected = {"encode": "[5, 4, 8, 8, 4]", "drop": "[5, 4, 4]", "decode": "['b', 'a', 'a']", "replace": "['b', 'A1', None, 'zz', 'A1']",
                "roundtrip": "['b', 'a', '<UNK>', '<UNK>', 'a']", "plus": "[101, 5, 4, 8, 8, 102]"}[case]
    assert sum(expected in row for row in held) == 1


def test_lookup_sizes(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "word string, id bigint")
    assert ops.small_lookup(table, "word", "id")() == {"a": 1, "b": 2}
    assert ops.small_lookup(table, "word", "id", max_rows=1) is None
    assert ops.small_lookup(spark.createDataFrame([("a" * 300, 1)], "word string, id bigint"), "word", "id") is None


def test_few_documents_of_a_batch_are_objects_at_once(spark, monkeypatch):
    monkeypatch.setattr(ops, "DOCUMENTS_AT_ONCE", 2)
    rows = [(i, [f"w{i}", "a", None, "a"] if i % 3 else None) for i in range(7)]
    df = spark.createDataFrame(rows, "k long, t array<string>").coalesce(1)
    got = sorted(tuple(r) for r in ops.norm_freq(df, "k", "t").collect())
    assert got == sorted(x for i in range(7) if i % 3 for x in [(i, f"w{i}", 1, 0.5), (i, "a", 2, 1.0)])
    plan = ops.norm_freq(df, "k", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and plan.count("pythonUDF") and ops.per_document(len, "int").evalType != 204


def test_few_words_of_a_batch_are_looked_up_at_once(spark, monkeypatch):
    monkeypatch.setattr(ops, "WORDS_AT_ONCE", 3)
    lists = [["a", "b"], None, ["c"], [], ["a", None, "x", "b", "c", "a", "b"], ["b"], None, ["c", "c"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.string()))], names=["k", "t"])
    slices = list(ops.in_slices(iter([batch, batch.slice(0, 0)])))
    assert len(slices) > 2 and sum((s["k"].to_pylist() for s in slices), []) == list(range(8))
    assert sum((s["t"].to_pylist() for s in slices), []) == lists
    df = spark.createDataFrame(list(enumerate(lists)), "k long, t array<string>").coalesce(1)
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, id bigint")
    ids = [[{"a": 1, "b": 2, "c": 3}.get(w, 9) for w in t or []] for t in lists]
    assert [r.ids for r in ops.encode_tokens(df, ["k"], "t", vocab, 9).orderBy("k").collect()] == ids
    weights = ops.tfidf(df, "k", "t", vocab=spark.createDataFrame([("a", 1.0), ("c", 2.0)], "term string, idf double")).collect()
    assert {(r.k, r.term): round(r.weight, 6) for r in weights} == {(0, "a"): 1.0, (2, "c"): 1.0, (4, "a"): 0.707107, (4, "c"): 0.707107, (7, "c"): 1.0}


def test_trigrams_are_counted_as_one_string(spark, tmp_path):
    from sparkloom.plans.text import w07

    texts = ["a b c a b c", "A b", "", None, "x_1 y2 zé, a b c!"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = w07(spark, str(tmp_path))
    assert "hashpartitioning(g#" in out._jdf.queryExecution().toString()
    got = {(r["context"], r["target"]): r["n"] for r in out.collect()}
    assert got == {("a b", "c"): 3, ("b c", "a"): 1, ("c a", "b"): 1, ("x_1 y2", "zé"): 1, ("y2 zé", "a"): 1, ("zé a", "b"): 1}
