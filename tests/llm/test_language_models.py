import inspect
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import kneser_ney, ngrams, suffix_tree
from sparkloom.llm.common import WordHashes
from tests.llm.conftest import plain_words

END = b" "


def tokens(text):
    return [*plain_words(text, lower=True), END]


def plain_tree(texts, depth, least, strength, price):
    """The same tree from dictionaries of n-grams."""
    grams = [Counter() for _ in range(depth + 1)]
    for t in texts:
        tk = tokens(t)
        for d in range(depth + 1):
            grams[d].update(tuple(tk[i:i + d + 1]) for i in range(len(tk) - d))
    n, v = sum(grams[0].values()), len(grams[0])
    kept_grams = [{g: c for g, c in level.items() if c >= least} for level in grams]
    contexts = {}

    def base(w):
        return (grams[0][(w,)] + 1) / (n + v + 1)

    def prob(context, w):
        for at in range(len(context) + 1):
            s = context[at:]
            if not s:
                return base(w)
            if s in contexts:
                total, stored, left = contexts[s]
                return (stored.get(w, 0) + left * prob(s[1:], w)) / (total + strength)
        raise AssertionError

    for d in range(1, depth + 1):
        level = defaultdict(dict)
        for g, c in kept_grams[d].items():
            level[g[:-1]][g[-1]] = c
        new = {}
        for s, stored in level.items():
            total = kept_grams[d - 1][s]
            left = total - sum(stored.values()) + strength
            gain = (total - sum(stored.values())) * math.log(left / (total + strength))
            gain += sum(c * math.log((c + left * prob(s[1:], w)) / (total + strength) / prob(s[1:], w)) for w, c in stored.items())
            if gain >= price * (1 + len(stored)):
                new[s] = total, stored, left
        contexts.update(new)
    return n, v, grams[0], contexts, prob


CORPUS = ["a b c a b c a b d", "a b c. A B C", "x y z x y z x y", "", "q", "a b c x y z " * 5, "B c a", "only once here", "x y w x y w"]


def test_scores_equal_a_plain_tree(spark):
    rows = [(i, CORPUS[i % len(CORPUS)] + (" t%d" % (i % 5) if i % 3 == 0 else "")) for i in range(60)] + [(60, None), (61, "unseen b c"), (62, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    n, v, unigrams, contexts, prob = plain_tree(train, 3, 3, 2.0, 0.7)
    assert {len(s) for s in contexts} >= {1, 2}
    got = {r["doc_id"]: r for r in suffix_tree.score_documents(docs, min_count=3, strength=2.0, price=0.7).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        tk, r = tokens(t), got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tk), sum(unigrams[(w,)] > 0 for w in tk), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((unigrams[(w,)] + 1) / (n + v + 1)) for w in tk))
        want = 0.0
        for j, w in enumerate(tk):
            want += math.log10(prob(tuple(tk[max(0, j - 3):j]), w))
        assert r["score"] == pytest.approx(want), (i, t)
    for s in list(contexts)[:8]:  # a distribution: all known symbols and the unknown one
        assert sum(prob(s, g[0]) for g in unigrams) + prob(s, b"never seen") == pytest.approx(1)


def test_what_workers_hold_does_not_change_the_tree(spark):
    rows = [(i, CORPUS[i % len(CORPUS)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    contexts, prob = plain_tree(train, 3, 3, 2.0, 0.7)[3:]
    assert contexts
    for share in (0.1, 1.0):  # some words are held, or none
        got = {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(docs, share=share, min_count=3, strength=2.0, price=0.7).collect()}
        for i, t in rows:
            tk = tokens(t)
            assert got[i] == pytest.approx(sum(math.log10(prob(tuple(tk[max(0, j - 3):j]), w)) for j, w in enumerate(tk))), (share, i, t)


def test_suffix_tree_edges(spark, odd_rows, no_rows):
    assert len(suffix_tree.score_documents(odd_rows).collect()) == odd_rows.count()
    assert suffix_tree.score_documents(no_rows).count() == 0
    nothing = suffix_tree.score_documents(spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string"))
    assert {(r["score"], r["train_tokens"]) for r in nothing.collect()} == {(0.0, 0)}


def test_tree_beats_the_word_distribution_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = suffix_tree.score_documents(docs).where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum() and (got["score"] > got["base_score"]).mean() > 0.7


def plain_stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for j, z in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[z] > 1 for k in (j, j + 1, j + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@pytest.mark.parametrize("text", [None, "", " \n ", "a b c a b c", "a a a a", "a b a b a", "x\nx\n x\n\nx", "#é | <z>\x85　y $%&*", "a b c d", "a b c " * 200])
def test_text_stats(text):
    assert kneser_ney.text_stats(text, plain_words(text), WordHashes()) == plain_stats(text)


def test_quality_rules_against_plain_statistics(spark, odd_rows, no_rows):
    rows = kneser_ney.judge_documents(odd_rows).collect()
    texts = sorted((plain_stats(r["text"]) for r in odd_rows.collect()))
    assert sorted(tuple(r[c] for c in kneser_ney.STATS) for r in rows) == texts
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    assert kneser_ney.judge_documents(no_rows).count() == 0
    assert kneser_ney.keep_fluent(odd_rows).columns == odd_rows.columns


def test_kneser_ney_is_a_distribution_and_equals_plain_counts(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abcdefgh"), 30, p=[.3, .2, .15, .1, .1, .08, .05, .02])) for _ in range(80)]
    docs = spark.createDataFrame([(t, "en") for t in texts] + [("p q r " * 9, "de")] * 60 + [(None, "en"), ("a", None)], "text string, lang string")
    model = kneser_ney.fit(docs, 2.0 ** -20, 1, 50, 1e-4)
    assert set(model.languages) == {"en", "de"}
    seed = model.languages["en"]
    place = {w: int(ngrams.find(model.words, np.array([ngrams.word_hash(w, seed)], dtype=np.uint64).view(np.int64))[0])
             for w in [*(c.encode() for c in "abcdefgh"), kneser_ney.START, END, kneser_ney.UNKNOWN]}
    assert min(place.values()) >= 0
    pairs, lefts = Counter(), Counter()
    for t in texts:
        tk = [kneser_ney.START, *t.encode().split(), END]
        pairs.update(zip(tk[:-1], tk[1:], strict=True))
    lefts.update(b for _, b in pairs)
    n1, n2, n3, n4 = (sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4))
    d = kneser_ney.discounts(n1, n2, n3, n4)
    c1, c2, c3, c4 = (sum(c == k for c in lefts.values()) for k in (1, 2, 3, 4))
    dl = kneser_ney.discounts(c1, c2, c3, c4)
    mass, vocabulary = sum(lefts.values()), len(place) - 1
    kept = {w: max(lefts[w] - dl[min(lefts[w], 3) - 1], 0) / mass if lefts[w] else 0 for w in place}
    low = {w: kept[w] + (1 - sum(kept.values())) / vocabulary for w in place if w != kneser_ney.START}
    assert sum(low.values()) == pytest.approx(1)
    for v in [b"a", b"h", kneser_ney.START]:
        total = sum(c for (x, _), c in pairs.items() if x == v)
        share = {w: max(pairs[v, w] - d[min(pairs[v, w], 3) - 1], 0) / total if pairs[v, w] else 0 for w in low}
        for w in low:
            want = share[w] + max(1 - sum(share.values()), 1e-9) * low[w]
            got = -model.log_perplexities(np.array([place[v], place[w]]))[0]
            assert math.exp(got) == pytest.approx(want)


def test_perplexity_bands_reject_odd_text_of_a_language(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(200)]
    weights = 1 / np.arange(1, 201)
    rows = [(i, " ".join(rng.choice(vocabulary, 80, p=weights / weights.sum())), "en") for i in range(300)]
    rows += [(1000, " ".join(f"w{199 - i % 60}" for i in range(70)), "en"), (1001, " ".join(f"zz{i}" for i in range(80)), "xx")]
    got = {r["doc_id"]: r for r in kneser_ney.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[1000]["kept"] and not got[1000]["base_failed"]
    assert got[1001]["kept"] and got[1001]["log_perplexity"] is None
    assert sum(got[i]["kept"] for i in range(300)) >= 299


def test_text_of_unknown_words_is_no_common_text(spark):
    rng = np.random.default_rng(3)
    weights = 1 / np.arange(1, 201)
    rows = [(i, " ".join([*rng.choice([f"w{j}" for j in range(200)], 80, p=weights / weights.sum()), f"rare{i}"]), "en") for i in range(300)]
    rows += [(1000 + i, " ".join(f"zz{i}x{j}" for j in range(80)), "en") for i in range(5)]
    got = {r["doc_id"]: r for r in kneser_ney.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert min(got[1000 + i]["log_perplexity"] for i in range(5)) > max(got[i]["log_perplexity"] for i in range(300))
    assert not any(got[1000 + i]["kept"] for i in range(5)) and sum(got[i]["kept"] for i in range(300)) >= 299


def test_a_language_keeps_its_model_in_a_larger_corpus(spark):
    settings = {k: v.default for k, v in inspect.signature(kneser_ney.judge).parameters.items() if k in ("min_documents", "language_share")}
    for n in (1_000, 700_000):
        docs = spark.range(n).selectExpr("if(id < 55, 'xx', 'en') as lang")
        assert set(kneser_ney.known_languages(docs, settings["min_documents"], settings["language_share"])) == {"en", "xx"}


def test_count_keys_sums_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "FLUSH_KEYS", 10)
    rows = spark.range(0, 5000, 1, 3).selectExpr("id % 97 * 4294967296 + id % 3 as k")
    got = {r["key"]: r["n"] for r in ngrams.count_keys(rows, lambda b: b.column(0).to_numpy(), 5000, "t").collect()}
    assert got == {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}


def test_held_columns_come_whole(spark):
    rows = [(i * 7919 - 2 ** 40, None if i % 3 == 0 else i / 7) for i in range(5000)]
    table = spark.createDataFrame(rows, "key long, hit double").repartition(40)
    keys, hits = ngrams.held_columns(table, "t")
    order = np.argsort(keys)
    assert keys[order].tolist() == [k for k, _ in rows]
    assert [None if np.isnan(h) else h for h in hits[order].tolist()] == [h for _, h in rows]
    assert [len(c) for c in ngrams.held_columns(table.where("key is null"), "t")] == [0, 0]


def test_filters_of_a_level_are_let_go(spark, monkeypatch):
    from pyspark.core.broadcast import Broadcast

    made, gone = [], []
    start, end = type(spark.sparkContext).broadcast, Broadcast.destroy
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: made.append(start(self, value)) or made[-1])
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: gone.append(id(self)) or end(self, *a))
    texts = [(i, " ".join(["one two three four five", "six seven eight"][i % 2:] * 3)) for i in range(60)]
    scored = suffix_tree.score_documents(spark.createDataFrame(texts, "doc_id long, text string"))
    assert scored.count() == 60
    assert len(made) - len(gone) <= 3  # word hashes, the held and the other n-grams


def test_rare_keys_are_not_stored(spark):
    rows = spark.createDataFrame([(x,) for x in [5] * 9 + [6] * 8 + [7] * 7], "v long").repartition(3)
    got = ngrams.count_keys(rows, lambda b: b.column(0).to_numpy(), 24, "t", least=8)
    assert sorted(map(tuple, got.collect())) == [(5, 9), (6, 8)]


def test_what_workers_hold_does_not_change_perplexities(spark):
    rng = np.random.default_rng(4)
    weights = 1 / np.arange(1, 121)
    rows = [(i, " ".join([*rng.choice([f"{lang}word{j}" for j in range(120)], 60, p=weights / weights.sum()), f"once{i}"]), lang) for i, lang in enumerate(["en", "de"] * 80)]
    rows += [(1000, "", "en"), (1001, None, "de"), (1002, "w1 w2", "xx"), (1003, "enword1 w2 enword1", "en"), (1003, "enword1 w2 enword1", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)

    def judged(share):
        return sorted((r["doc_id"], r["kept"], r["log_perplexity"] or 0, r["log_low_perplexity"] or 0) for r in kneser_ney.judge_documents(docs, share=share).collect())

    held = judged(2.0 ** -20)  # all words and bigrams
    assert len(held) == len(rows) and len({p for _, _, p, _ in held}) > 150
    for share in (1 / 100, 1 / 20, 1 / 2):  # some words and bigrams, or hardly any
        for got, want in zip(judged(share), held, strict=True):
            assert got[:2] == want[:2] and got[2:] == pytest.approx(want[2:])
    assert sorted(r["doc_id"] for r in kneser_ney.keep_fluent(docs, share=1 / 20).collect()) == [i for i, kept, *_ in held if kept]


def test_a_word_stays_known_in_a_larger_corpus(spark):
    few = [("aa bb " * 3, "en")] * 3  # nine of two hundred thousand: a share of 1 / 20 would need ten thousand
    docs = spark.createDataFrame([("x y z " * 20, "en")] * 3300 + few, "text string, lang string")
    model = kneser_ney.fit(docs, 1 / 20, 4, 50, 0.0)
    seed = model.languages["en"]
    known = {int(ngrams.find(model.words, np.array([ngrams.word_hash(w, seed)], dtype=np.uint64).view(np.int64))[0]) >= 0 for w in (b"aa", b"bb")}
    assert known == {True} and model.rest is None
    assert (model.price == 0).all()  # no word is unknown


def test_held_least_leaves_no_room_unused(spark):
    counts = spark.createDataFrame([(k,) for k in [1, 1, 4, 4, 5, 6, 6, 9, 500]], "n long")
    assert [ngrams.held_least(counts, 1 / most, 536, 4) for most in (1, 2, 4, 5, 7, 100)] == [10, 7, 6, 5, 4, 4]


def test_the_pipeline_keeps_the_same_texts_whatever_is_held(spark, monkeypatch):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    weights = 1 / np.arange(1, 101)
    rows = [(i, " ".join([*rng.choice([f"plain{j}" for j in range(100)], 70, p=weights / weights.sum()), f"once{i}"]), "en", "src0") for i in range(120)]
    rows += [(1000 + i, " ".join(f"odd{i}x{j}" for j in range(80)), "en", "src0") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    want = sorted(map(tuple, corpus_pipeline.quality_rules(spark, docs, "").collect()))
    assert sum(r[0] < 1000 for r in want) >= 119 and not {r[0] for r in want} & {1000, 1001, 1002}
    monkeypatch.setattr(kneser_ney, "HELD_WORDS", 2.0 ** -16)  # sixteen words
    monkeypatch.setattr(kneser_ney, "HELD_PAIRS", 2.0 ** -15)
    assert sorted(map(tuple, corpus_pipeline.quality_rules(spark, docs, "").collect())) == want
