"""Graph and state-machine jobs by brute force; models on data with known answers."""

import itertools

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from sparkloom.operators import graph as gr, models as mdl
from sparkloom.operators.features import assemble_xy
from sparkloom.operators.metrics import classification_metrics
from sparkloom.runtime import scratch_path

GRAPHS = {
    "diamond": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")],
    "loop": [("a", "a"), ("a", "b")],
    "two": [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")],
    "bridge": [("a", "b"), ("b", "a"), ("b", "m"), ("m", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "end")],
    "empty": [],
    "rings": [*[(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)], ("r3", "t1"), ("t1", "t2"), ("t2", "u0"), *[(f"u{i}", f"u{(i + 1) % 5}") for i in range(5)],
              ("u2", "u0"), ("s", "s"), ("p", "q"), ("q", "p")],
    "random": [(f"v{a:02}", f"v{b:02}") for a, b in np.random.default_rng(4).integers(0, 40, (60, 2)).tolist()],
}


def reach(edges):
    r = set(edges)
    while True:
        more = {(a, d) for a, b in r for c, d in edges if b == c} | r
        if more == r:
            return r
        r = more


@pytest.mark.parametrize("name", GRAPHS)
def test_cycles(spark, name):
    edges = GRAPHS[name]
    df = spark.createDataFrame(edges, "src string, dst string")
    r = reach(edges)
    on = {v for v, w in r if v == w}
    comp = {v: min(w for w in on if w == v or ((v, w) in r and (w, v) in r)) for v in on}
    assert {x.vertex: x.component for x in gr.find_cycles(df).collect()} == comp
    assert gr.has_cycle(df).first()[0] == bool(on)


def test_a_long_chain_and_a_long_ring_take_few_rounds(spark):
    n = 5000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    ring = spark.range(n).select((F.col("id") + 2 * n).alias("src"), ((F.col("id") + 1) % n + 2 * n).alias("dst"))
    chord = spark.createDataFrame([(n // 2, 2 * n + 7), (2 * n + 9, 2 * n + 4)], "src bigint, dst bigint")
    cut = []
    plain, gr._stored = gr._stored, lambda df: cut.append(1) or plain(df)
    try:
        found = gr.find_cycles(chain.union(ring).union(chord)).agg(F.count("*"), F.countDistinct("component"), F.min("component")).first()
    finally:
        gr._stored = plain
    assert tuple(found) == (n, 1, 2 * n)
    assert len(cut) <= 40  # stored steps


@pytest.mark.parametrize("name,src,dst", [("diamond", "a", "d"), ("two", "a", "d"), ("bridge", "a", "end"), ("two", "d", "a"), ("loop", "a", "b")])
def test_all_paths(spark, name, src, dst):
    edges = GRAPHS[name]
    vertices = {v for e in edges for v in e}
    for hops in (2, 6):
        exp = set()
        for n in range(0, hops):
            for mid in itertools.permutations(vertices - {src, dst}, n):
                p = (src, *mid, dst)
                if all(e in edges for e in zip(p, p[1:])):
                    exp.add(p)
        got = gr.all_paths(spark.createDataFrame(edges, "src string, dst string"), src, dst, hops)
        assert {tuple(r.path) for r in got.collect()} == exp


@pytest.mark.parametrize("block", [5, 1000])
def test_state_machine_in_blocks(spark, block):
    rng = np.random.default_rng(4)
    moves = {(gr.START, 1): "a", ("a", 0): "b", ("b", 1): "b", ("b", 0): gr.START}
    rows = [("hot" if i % 4 else f"k{i % 3}", i, int(rng.integers(0, 3))) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, x int")
    table = spark.createDataFrame([(s, x, n) for (s, x), n in moves.items()], "state string, input int, next string")
    out = gr.detect_sequence(df, ["k"], ["t"], "x", table, block_rows=block)
    got = {(r.k, r.t): (r.state, r.matched, r.overlap) for r in out.collect()}
    state, exp = {}, {}
    for k, t, x in rows:
        now = state.get(k, gr.START)
        nxt = moves.get((now, x))
        exp[k, t] = (nxt or now, nxt is not None, nxt == now)
        state[k] = nxt or now
    assert got == exp
    total = gr.sequence_summary(out, ["k"], ["t"]).collect()
    assert {r.k: r.state for r in total} == state


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = 2.0 + x @ np.array([3.0, -1.0, 0.0]) + 0.01 * rng.normal(size=400)
    rows = [(i, *[float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double").cache(), x, y


def test_linear_models(linear):
    df, x, y = linear
    ols = mdl.fit_ols(df, ["a", "b", "c"], "y")
    assert np.allclose(ols.coefficients.toArray(), [3, -1, 0], atol=0.01) and ols.intercept == pytest.approx(2, abs=0.01)
    ridge = mdl.fit_elastic_net(df, ["a", "b", "c"], "y", 0.5, 0.0)
    xc, yc = x - x.mean(0), y - y.mean()
    exact = np.linalg.solve(xc.T @ xc / 400 + 0.5 * np.eye(3), xc.T @ yc / 400)
    assert np.allclose(ridge.coefficients.toArray(), exact, atol=1e-3)
    both = mdl.fit_elastic_net(df, ["a", "b", "c"], "y", 0.5, 0.4).coefficients.toArray()
    grad = xc.T @ (xc @ both - yc) / 400 + 0.5 * 0.6 * both  # zero up to the sign penalty
    assert np.allclose(np.abs(grad[:2]), 0.5 * 0.4, atol=1e-3) and abs(grad[2]) <= 0.2 + 1e-3
    lasso = mdl.fit_elastic_net(df, ["a", "b", "c"], "y", 0.5, 1.0)
    assert lasso.coefficients[2] == 0.0


def test_importance_and_search(linear):
    df, _, _ = linear
    top = mdl.feature_importance(df, ["a", "b", "c"], "y", top=2, trees=10).collect()
    assert [r.feature for r in top] == ["a", "b"]
    tree = DecisionTreeRegressor(seed=1)
    xy = assemble_xy(df, ["a", "b", "c"], "y", ["id"])
    best, draws = mdl.random_search(tree, {tree.maxDepth: [1, 6], tree.minInstancesPerNode: [1, 2, 3]}, RegressionEvaluator(metricName="mse"),
                                    xy, "id", n_iter=4, folds=3)
    assert draws.count() == 4 == draws.select("params").distinct().count() and best.getMaxDepth() == 6
    assert "6" in mdl.best_of(draws, "metric").first().params
    _, draws = mdl.random_search(tree, {tree.maxDepth: [1, 6]}, RegressionEvaluator(metricName="mse"), xy, "id", n_iter=4, folds=2)
    assert draws.count() == 2  # each setting is drawn once


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(6)
    rows = [(float(c), *[float(v) for v in rng.normal(size=2) * 0.3 + 3 * np.array([c, c % 2])]) for c in range(3) for _ in range(60)]
    df = spark.createDataFrame(rows, "label double, a double, b double")
    return assemble_xy(df, ["a", "b"], "label").cache()


def test_classifiers(blobs):
    from pyspark.ml.feature import MinMaxScaler
    pos = MinMaxScaler(inputCol="features", outputCol="f").fit(blobs).transform(blobs).select(F.col("f").alias("features"), "label")
    fits = [mdl.fit_rf_classifier(blobs, 10, 5), mdl.fit_boosted_trees(blobs, 3, 3, 3), mdl.fit_mlp(blobs, [2, 6, 3], 100), mdl.fit_logistic(blobs)]
    for m in fits:
        assert classification_metrics(m.transform(blobs), "label", "prediction").first().accuracy > 0.9
    assert mdl.fit_naive_bayes(pos).transform(pos).filter("prediction is null").count() == 0


def test_class_scores_as_columns_and_fits_at_once(spark, blobs, monkeypatch):
    m = mdl.fit_boosted_trees(blobs, 3, 2, 3)
    new, old = mdl.predict_classes(m, blobs), m.transform(blobs)
    assert new.columns == [*blobs.columns, "prediction"]
    both = [sorted(tuple(map(str, r)) for r in d.select("features", "label", "prediction").collect()) for d in (new, old)]
    assert both[0] == both[1]
    assert [mdl.fits_at_once(blobs, rows=n) for n in (100, 400, 10_000)] == [1, 2, 4]
    seen = []
    real = mdl.OneVsRest
    monkeypatch.setattr(mdl, "fits_at_once", lambda kept: 1)
    monkeypatch.setattr(mdl, "OneVsRest", lambda **named: seen.append(named["parallelism"]) or real(**named))
    mdl.fit_boosted_trees(blobs, 3, 1, 1)  # a large table is fitted class by class
    assert seen == [1]


def test_text_classifier_and_multilabel(spark, blobs):
    rows = [(["good", "fine"], "pos")] * 20 + [(["bad", "poor"], "neg")] * 20
    df = spark.createDataFrame(rows, "tokens array<string>, target string")
    m = mdl.fit_text_classifier(df, "tokens", "target", 256)
    assert classification_metrics(m.transform(df), "label", "prediction").first().accuracy == 1.0
    two = blobs.withColumns({"x": (F.col("label") > 1).cast("double"), "y": (F.col("label") > 0).cast("double")})
    out = mdl.predict_multilabel(two, mdl.fit_multilabel(two, "features", ["x", "y"]))
    assert out.filter("x != pred_x or y != pred_y").count() < 9


def test_save_load_predicts_the_same(spark, blobs):
    path = scratch_path(spark, "model")
    calls = []
    fit = lambda: calls.append(1) or mdl.fit_logistic(blobs)
    a = mdl.load_or_fit(path, LogisticRegressionModel.load, fit)
    b = mdl.load_or_fit(path, LogisticRegressionModel.load, fit)
    assert len(calls) == 1 and a.coefficientMatrix == b.coefficientMatrix


def test_mixed_regressor(spark):
    rows = [("x" if i % 2 else "y", float(i % 10), float((i % 2) * 5 + i % 10)) for i in range(200)]
    m, xy = mdl.fit_mixed_regressor(spark.createDataFrame(rows, "c string, n double, t double"), ["c"], ["n"], "t", rounds=10, depth=4)
    assert m.transform(xy).select(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0] < 0.5


def test_recommender(spark):
    rng = np.random.default_rng(8)
    u, v = rng.random((20, 2)) + 0.5, rng.random((15, 2)) + 0.5
    far = 1 << 40  # ids beyond 32 bits
    rows = [(far + i, far + j, float(np.clip(np.round(u[i] @ v[j] * 1.2), 1, 5))) for i in range(20) for j in range(15)]
    r = spark.createDataFrame(rows, "user_id bigint, movie_id bigint, rating double").cache()
    model = mdl.fit_als(r, rank=3, reg=0.01)
    pred = mdl.predict_ratings(model, r)
    assert pred.count() == len(rows)
    mean = r.agg(F.avg("rating")).first()[0]
    rmse, base = pred.select(F.sqrt(F.avg((F.col("rating") - F.col("prediction")) ** 2)), F.sqrt(F.avg((F.col("rating") - mean) ** 2))).first()
    assert rmse < 0.7 * base and pred.filter("rating_class not between 0 and 4").count() == 0
    ours = {(x.user_id, x.rank): x.score for x in mdl.recommend(model, 3).collect()}
    fu = {x.user_id: np.array(x.features) for x in model.user_factors.collect()}
    fi = {x.movie_id: np.array(x.features) for x in model.item_factors.collect()}
    assert len(fu) == 20 and len(fi) == 15
    ref = {(i, k + 1): s for i, f in fu.items() for k, s in enumerate(sorted((f @ g for g in fi.values()), reverse=True)[:3])}
    assert ours.keys() == ref.keys() and all(ours[k] == pytest.approx(ref[k], abs=1e-4) for k in ref)

    # New users: the ratings of trained ones under other ids must give the same factors; one with few, one with none that count.
    again = r.filter("rating is not null").withColumn("user_id", F.col("user_id") + 1000)
    some = spark.createDataFrame([(7, far, 5.0), (7, far + 3, 1.0), (8, 5, 4.0), (9, None, 3.0), (far, far + 2, 1.0)], r.schema)
    wider = mdl.fold_in(model, again.unionByName(some).repartition(3))
    new = {x.user_id: np.array(x.features) for x in wider.user_factors.collect()}
    assert new.keys() == fu.keys() | {i + 1000 for i in fu} | {7} and np.allclose(new[far], fu[far])
    assert all(np.allclose(new[i + 1000], fu[i], atol=1e-4) for i in fu)
    m = np.stack([fi[far], fi[far + 3]])
    assert np.allclose(new[7], np.linalg.solve(m.T @ m + 0.01 * 2 * np.eye(3), m.T @ [5.0, 1.0]), atol=1e-4)
    items = mdl.fold_in(model, r.withColumn("movie_id", F.col("movie_id") - 7), items=True)
    assert items.item_factors.count() == 15 + 7

    asked = spark.createDataFrame([(7, far), (8, far), (far, 5), (8, 5), (None, None)], "user_id bigint, movie_id bigint")
    got = {(x.user_id, x.movie_id): x.prediction for x in mdl.predict_ratings(wider, asked).collect()}
    by_item, by_user = r.filter(F.col("movie_id") == far).agg(F.avg("rating")).first()[0], r.filter(F.col("user_id") == far).agg(F.avg("rating")).first()[0]
    assert got == {(7, far): pytest.approx(new[7] @ fi[far], abs=1e-4), (8, far): pytest.approx(by_item), (far, 5): pytest.approx(by_user),
                   (8, 5): pytest.approx(mean), (None, None): pytest.approx(mean)}


def test_recommender_reads_ratings_once_and_joins_each_side_once(spark):
    rows = [(u, i, float((u * i) % 5 + 1)) for u in range(12) for i in range(8)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    schema = "user_id bigint, movie_id bigint, rating double"
    model = mdl.fit_als(spark.createDataFrame([*rows, (None, 1, 2.0)], schema).mapInPandas(counted, schema), rank=3, iterations=2)
    assert read.value == len(rows) + 1
    asked = spark.createDataFrame([(3, 4), (3, 4), (99, 4), (3, 99), (None, 4), (99, 99)], "user_id bigint, movie_id bigint")
    pred = mdl.predict_ratings(model, asked)
    assert pred._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2
    fu = {x.user_id: np.array(x.features) for x in model.user_factors.collect()}
    fi = {x.movie_id: np.array(x.features) for x in model.item_factors.collect()}
    of_item, of_user = np.mean([r for _, i, r in rows if i == 4]), np.mean([r for u, _, r in rows if u == 3])
    want = [fu[3] @ fi[4]] * 2 + [of_item, of_user, of_item, np.mean([r for *_, r in rows])]
    assert sorted(x.prediction for x in pred.collect()) == pytest.approx(sorted(want), abs=1e-4)


def test_batches(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "i int, v array<double>")
    out = mdl.map_batches(df.select("i"), lambda p: p.assign(j=p["i"] * 2), "i int, j int")
    assert sorted(r.j for r in out.collect()) == list(range(0, 20, 2))

    def load():
        return lambda x: x.sum(axis=1)
    assert sorted(r.score for r in mdl.score_batches(df, "v", load, width=2, batch_size=3).collect()) == [float(i + 1) for i in range(10)]
