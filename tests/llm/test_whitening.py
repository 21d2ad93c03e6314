from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__
from sparkloom.llm import feast, whitening

SCHEMA = "vec_id long, embedding array<double>, n int, component string, v double"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 1, "x", 0.5) for i, x in rows], SCHEMA).repartition(3)


def check(got, rows, k=4, scale=256):
    """Against exact sums, numpy's eigenvalues, and the covariance of what came out."""
    held = [(i, [int(np.floor(scale * float(c))) for c in x]) for i, x in rows]
    fit = sorted({tuple(x) for _, x in held})
    n, d = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
    v = centred.T @ centred / n
    e = np.sort(np.linalg.eigvalsh(v))[::-1][:k]
    assert len(got) == len(held) * min(k, d) and {r["n"] for r in got} == {n}
    dev = {(i, tuple(x)): sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in held}
    assert sorted(r["deviation"] for r in got) == sorted(y for i, x in held for y in [dev[i, tuple(x)]] * min(k, d))
    explained = {r["component"]: r["explained"] for r in got}
    for j in range(min(k, d)):
        assert explained[j + 1] == pytest.approx(e[j] / np.trace(v), rel=1e-6)
    assert {r["identity_error"] for r in got}.pop() <= 1e-9
    by_id = defaultdict(dict)
    for r in got:
        by_id[r["vec_id"]][r["component"]] = r["whitened"]
    first = {}
    for i, x in held:
        first.setdefault(tuple(x), i)
    w = np.array([[by_id[first[x]][j + 1] for j in range(min(k, d))] for x in fit])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(min(k, d))).max() < 1e-6 and np.abs(w.mean(0)).max() < 1e-6
    # each column lies in the span that an eigenvector would give: (x - mean) u / root(e) with V u = e u
    u = np.linalg.lstsq(centred, w * np.sqrt(e), rcond=None)[0]
    assert np.abs(v @ u - u * e).max() <= 1e-8 * e[0]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(__spark_entry__.queries()["op13_feast_whitening"](spark, sf).collect(), rows)


def test_copies_large_means_and_unequal_scales(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)) * [2e3, 30, 10, 5, 2, 1] + [1e9, -1e7, 0, 3, 5, 0]
    rows = list(enumerate(base.tolist()))
    rows += [(1000 + i, base[0].tolist()) for i in range(300)]  # a hot vector counts once
    bad = [(2000, None), (2001, [1.0] * 5 + [None]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, [1.0]), (2005, [])]
    check(whitening.whiten(frame(spark, rows + bad)).collect(), rows)


def test_few_dimensions_and_no_variance(spark):
    rows = [(1, [0.5, 1.0]), (2, [2.0, -1.0]), (2, [2.0, -1.0]), (None, [4.0, 4.0]), (5, [-0.0, -0.001])]
    check(whitening.whiten(frame(spark, rows)).collect(), rows)
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and {tuple(r[c] for c in ("n", "deviation", "whitened", "explained", "identity_error")) for r in one} == {(1, 0, None, None, None)}
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert {r["component"]: (r["whitened"] is None, round(r["explained"], 9)) for r in line} == {1: (False, 1.0), 2: (True, 0.0), 3: (True, 0.0)}
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, [(1, None)])).count() == 0
    far = whitening.whiten(frame(spark, [(1, [1e15, 0.0]), (2, [-1e15, 1.0])])).collect()
    assert {r["deviation"] for r in far} == {None}


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))
    a = (q * np.asarray(values)) @ q.T
    return (a + a.T) / 2


SPECTRA = {
    "even": np.linspace(0, 1, 40), "one value": np.ones(30), "cluster at the cut": np.r_[2, 1 + 1e-12 * np.arange(8), np.zeros(20)],
    "graded": 10.0 ** -np.arange(30), "negative": np.linspace(-3, -1, 20), "rank one": np.r_[1, np.zeros(30)], "single": np.array([4.0]),
}


@pytest.mark.parametrize("name", SPECTRA)
@pytest.mark.parametrize("k", [1, 4, 12])
def test_leading_pairs(name, k):
    a = symmetric(SPECTRA[name])
    k = min(k, len(a))
    values, vectors = feast.leading_pairs(a, k)
    scale = np.abs(a).max()
    assert np.abs(values - np.sort(np.linalg.eigvalsh(a))[::-1][:k]).max() < 1e-13 * len(a) * scale
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12 and np.abs(a @ vectors - vectors * values).max() < 1e-12 * len(a) * scale


def test_inertia_counts_and_widened_blocks(monkeypatch):
    a = symmetric(np.r_[np.linspace(0, 1, 30), 5, 6, 7])
    form = feast.tridiagonal(a)
    assert [feast.count_above(form, s) for s in (-1, 0.5, 4, 5.5, 8)] == [33, 18, 3, 2, 0]
    assert sum(c for *_, c in feast.intervals(form, -1, 8, 5)) >= 5
    values, _ = feast.interval_pairs(a, 4.0, 8.0, 3, nodes=4)
    assert np.allclose(np.sort(values), [5, 6, 7])
    with pytest.raises(ArithmeticError):  # a count that the matrix does not have is not passed over
        feast.interval_pairs(a, 4.0, 8.0, 4, rounds=2)
