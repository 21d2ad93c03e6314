import random
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import near_dedup
from sparkloom.llm.components import components
from sparkloom.llm.setsketch import Sketcher, merge
from tests.llm.conftest import plain_words


def plain_components(rows, size, percent=80):
    sets, parent = {}, {}
    for k, (i, text) in enumerate(rows):
        w = plain_words(text, lower=True)
        sets[k] = {tuple(w[j:j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
        parent[k] = k

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and rows[a][0] is not None and rows[b][0] is not None:
                common = len(sets[a] & sets[b])
                if sets[a] and sets[b] and (rows[a][0] == rows[b][0] or 100 * common >= percent * len(sets[a] | sets[b])):
                    parent[find(b)] = find(a)
    groups = defaultdict(list)
    for k in sets:
        groups[find(k)].append(k)
    least = {k: min((rows[x][0] for x in g if rows[x][0] is not None), default=None) for g in groups.values() for k in g}
    return {(i, len(sets[k])): least[k] for k, (i, _) in enumerate(rows)}


def variants(seed, words, copies, edits):
    rng = random.Random(seed)
    base = [f"s{seed}w{rng.randrange(500)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def check(spark, rows, size):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.link_documents(docs, size=size).collect()
    want = plain_components(rows, size)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"], r["n_shingles"]], r
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("block", [512, 7])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    texts = [t for s in range(4) for t in variants(s, 90, 45, 4)] + variants(9, 6, 6, 1) + ["a b c", "A b C", "a b c d", "x", "X x", "", None]
    order = list(range(len(texts)))
    random.Random(5).shuffle(order)
    check(spark, [(10 * k + 3, texts[i]) for k, i in enumerate(order)], 4)


def test_nulls_repeated_ids_and_long_texts(spark, odd_rows, no_rows):
    rows = [(r["doc_id"], r["text"]) for r in odd_rows.collect()] + [(20, "w " * 40_000), (20, "a different text with this id"), (21, "a different text with this id")]
    check(spark, rows, 5)
    assert near_dedup.link_documents(no_rows).count() == 0
    kept = near_dedup.keep_one(odd_rows)
    assert kept.columns == odd_rows.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 3, None, 5, 6, 7, 9], key=str)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    sketcher = Sketcher()
    x = rng.integers(0, 2 ** 63, 4000).astype(np.uint64)
    a, b = x[:3000], x[1000:]
    assert (merge(sketcher.registers(a), sketcher.registers(b)) == sketcher.registers(x)).all()
    errors = []
    for _ in range(40):
        x = rng.integers(0, 2 ** 63, 1200).astype(np.uint64)
        a, b = x[:1000], x[200:]
        likely = sketcher.similarity(sketcher.registers(a)[None], sketcher.registers(b)[None], np.array([1000]), np.array([1000]))
        errors.append(likely[0] - 800 / 1200)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 400)] + [(1, 2), (2, 3), (3, 1), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 7 for i in range(300, 400)}, 2: 1, 3: 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefilter_lets_every_wanted_id_through(spark):
    from pyspark.sql import functions as F

    from sparkloom.llm.common import maybe_in

    wanted = spark.range(0, 3000, 3).selectExpr("id as v")
    likely = maybe_in(wanted)
    passed = {r["id"] for r in spark.range(30_000).where(likely(F.col("id"))).collect()}
    assert passed >= set(range(0, 3000, 3)) and len(passed) < 1100
    assert spark.range(100).where(maybe_in(wanted.limit(0))(F.col("id"))).count() == 0


def test_labels_are_joined_over_rounds(spark):
    from sparkloom.llm.near_dedup import relabel

    links = lambda rows: spark.createDataFrame(rows, "a long, b long")
    first = relabel(None, links([(5, 6), (6, 7), (20, 21)]))
    second = relabel(first, links([(7, 21), (1, 20), (30, 31)]))
    third = relabel(second, links([]))
    assert {r["c"]: r["label"] for r in third.collect()} == {5: 1, 6: 1, 7: 1, 20: 1, 21: 1, 31: 30}
