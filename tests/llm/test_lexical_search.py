import math
import re
from collections import Counter

import pytest

from sparkloom.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, k):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n_docs, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, c in tf:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if missing else i, -s) for r, (s, missing, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, k=50, parts=3, **options):
    d = spark.createDataFrame([(i, t, 1.0, 2, 3) for i, t in docs], "doc_id long, text string, score double, item_id int, n int")
    q = spark.createDataFrame([(i, t, 5, "x") for i, t in items], "item_id long, text string, rank int, term string")
    got = lexical_search.search(d.repartition(parts), q, k, **options).collect()
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=repr)


DOCS = [(1, "The cat sat on the mat."), (2, "the CAT; the cat-cat_cat 'the'"), (3, None), (4, ""), (5, "Été ÉTÉ über ÜBER straße"), (6, " .,;\n"),
        (7, "a b a b a  a\ta"), (8, "catalogue the a1 b2 2b"), (9, "x" * 200_000 + " cat " + "word " * 50_000), (10, "The cat sat on the mat."),
        (10, "The cat sat on the mat."), (None, "the mat"), (12, "emoji 😀cat 😀 dog\x00cat\x7fcat")]
ITEMS = [(1, "cat mat"), (2, "CAT the the"), (3, "été Über ü 😀"), (4, None), (5, ""), (6, "a b"), (7, "no such term zzz"), (7, "dog"), (8, "cat mat"), (None, "word 2b")]


@pytest.mark.parametrize("options", [{}, {"block_items": 2}, {"block_bytes": 40, "k": 2}])
def test_ranks_equal_brute_force(spark, options):
    k = options.pop("k", 50)
    assert run(spark, DOCS, ITEMS, k, **options) == plain(DOCS, ITEMS, k)


def test_many_documents_few_ranks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "MERGE_AT", 16)  # the best lists are merged many times
    docs = [(i, " ".join(f"w{(i * j) % 23}" for j in range(i % 37 + 1))) for i in range(900)]
    items = [(i, " ".join(f"W{i + j}" for j in range(6))) for i in range(20)]
    assert run(spark, docs, items, 7) == plain(docs, items, 7)


def test_integers_where_floats_would_not_do(spark):
    d = spark.createDataFrame([(i, t) for i, t in DOCS if t], "doc_id long, text string")
    shared = spark.sparkContext.broadcast((["cat", "the"], lexical_search.np.array([0, 1, 2]), lexical_search.np.array([0, 0]), 1))
    counted = lexical_search.term_counts(d, shared, "doc_id", "text")
    weights = spark.sparkContext.broadcast(lexical_search.np.array([700, 300]))
    both = [sorted(map(tuple, lexical_search.ranked_documents(counted, shared, weights, 50, (11, 60_000), exact).collect()), key=repr) for exact in (True, False)]
    assert both[0] == both[1] and both[0]


def test_edges(spark):
    assert run(spark, [], ITEMS) == [] and run(spark, DOCS, []) == [] and run(spark, [(1, "")], ITEMS) == []
    with pytest.raises(ValueError, match="one item"):
        run(spark, DOCS, [(1, "y" * 5000)], block_bytes=64)
