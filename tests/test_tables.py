"""Relational, statistics, sampling, metrics and file operators on small frames with edge rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import quantile, aggregates as agg, features as feat, metrics as met, relational as rel, sampling as smp
from sparkloom.runtime import scratch_path
from sparkloom.sources import files


def test_sourcing_budget_worked_example(spark):
    imports = spark.createDataFrame([(0, "Metals", 200, 3000), (1, "Fertilizers", 50, 2000), (2, "Computers", 100, 1000)],
                                    "pos int, name string, quantity bigint, price bigint")
    made = spark.createDataFrame([(0, "METALS", 100, 2000), (1, "fertilizers", 20, 1500)],
                                 "pos int, name string, quantity bigint, price bigint")
    for mode in ("as_coded", "intended"):
        assert rel.sourcing_budget(imports, made, mode).first()[0] == 690_000
    more = made.unionAll(spark.createDataFrame([(2, "Metals", 7, 11), (3, "Steel", 2, 5)], made.schema))
    assert rel.sourcing_budget(imports, more).first()[0] == 690_000 + 77 + 10
    with pytest.raises(ValueError):
        rel.sourcing_budget(imports, made, "other")


def test_parse_number(spark):
    cases = {"1200": 1200.0, "2100 - 2850": 2100.0, "34.46Sq. Meter": 34.0, "abc": None, "": None, "1e3": 1000.0, "x9 8": 9.0}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "c string")
    got = {r.c: r.n for r in df.withColumn("n", rel.parse_number("c")).collect()}
    assert got == {**cases, None: None}


def test_nulls_and_nan(spark):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, None, None), (None, 1.0, "c")], "i int, d double, s string")
    assert {r.column_name: r.nulls for r in rel.null_counts(df).collect()} == {"i": 1, "d": 2, "s": 1}
    assert {r.column_name: r.non_null for r in rel.profile(df).collect()} == {"i": 2, "d": 1, "s": 2}
    assert rel.dropna_any(df).count() == 0


def test_small_columns(spark):
    df = spark.createDataFrame([(2015, "Petrol", 1, 0), (2020, "LPG", 0, 0)], "Year int, Fuel string, a int, b int")
    assert [r.age for r in rel.with_age(df, "Year", 2021).collect()] == [7, 2]
    assert [r.Fuel for r in rel.map_values(df, "Fuel", {"Petrol": 1}).collect()] == [1, None]
    assert [r.f for r in df.select(rel.active_flags(["a", "b"]).alias("f")).collect()] == [["a"], []]
    assert rel.slice_cols(df, 1).columns == ["Fuel", "a", "b"] and rel.columns_of_type(df, "object") == ["Fuel"]
    assert df.select(F.bround(F.lit(2.5)), rel.sigmoid(F.lit(0.0)), rel.relu(F.lit(-1.0))).first()[:] == (2.0, 0.5, 0.0)


def test_aligned_series(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, value double")
    b = spark.createDataFrame([(2, 10.0), (3, 30.0)], "k int, value double")
    assert {r.k: r.value for r in rel.aligned_add(a, b, ["k"], fill=0.0).collect()} == {1: 1.0, 2: 12.0, 3: 30.0}
    assert {r.k: (r.x, r.y) for r in rel.align({"x": a, "y": b}, ["k"]).collect()} == {1: (1.0, None), 2: (2.0, 10.0), 3: (None, 30.0)}


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.full(400, 5.0), rng.normal(size=777), [9.0]])
    df = spark.createDataFrame([(float(v), float(i)) for i, v in enumerate(x)] + [(None, None)], "x double, y double")
    got = {(r.column_name, r.p): r.value for r in agg.quantiles(df, ["x", "y"], [0.0, 0.05, 0.5, 0.95, 1.0]).collect()}
    for p in (0.0, 0.05, 0.5, 0.95, 1.0):
        assert got["x", p] == pytest.approx(np.quantile(x, p)) and got["y", p] == pytest.approx(np.quantile(np.arange(len(x)), p))
    d = agg.describe_table(df, ["x"]).first()
    assert d["count"] == len(x) and d["std"] == pytest.approx(x.std(ddof=1)) and d["q50"] == pytest.approx(np.median(x))
    lo, hi = np.quantile(x, [0.05, 0.95])
    assert agg.trim_quantiles(df, "x").count() == ((x > lo) & (x < hi)).sum()
    one = agg.describe_table(df.limit(1), ["x"]).first()
    assert one["q25"] == one["q75"] == one["min"]


@pytest.mark.parametrize("limit,margin,k", [(1_000_000, 0.005, 2000), (40, 0.02, 200), (5, 0.0, 8)])
def test_quantiles_whatever_the_sketch_says(spark, monkeypatch, limit, margin, k):
    """Narrowed brackets, missed ranks, heavy and equal values, both infinities, NaN after all numbers."""
    monkeypatch.setattr(quantile, "LIMIT", limit)
    monkeypatch.setattr(quantile, "MARGIN", margin)
    monkeypatch.setattr(quantile, "SKETCH_K", k)
    rng = np.random.default_rng(8)
    x = np.concatenate([np.full(900, 1.5), np.full(600, 1.6), rng.normal(size=1500), [-np.inf, np.inf, -0.0, 0.0]])
    y = np.concatenate([rng.integers(0, 4, len(x) - 400).astype(float), np.full(400, np.nan)])
    rng.shuffle(x)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y)] + [(None, None, None)], "x double, y double, `z.z` double").repartition(5)
    probs = [0.0, 0.001, 0.25, 0.3, 0.5, 0.77, 0.86, 0.999, 1.0]
    got = quantile.quantile_values(df, ["x", "y", "z.z"], probs)
    for name, values in (("x", np.sort(x)), ("y", np.sort(y))):
        for p in probs:
            at = (len(values) - 1) * p
            a, b = values[int(np.floor(at))], values[int(np.ceil(at))]
            want = a if np.floor(at) == np.ceil(at) else a + (b - a) * (at - np.floor(at))
            assert got[name, p] == pytest.approx(want, nan_ok=True, abs=1e-12), (name, p)
    assert {got["z.z", p] for p in probs} == {None}
    assert agg.describe_table(df, ["z.z"]).first()["q50"] is None


def test_quantiles_send_no_values(spark):
    """What the passes shuffle is counts and values inside the brackets, not the column."""
    df = spark.range(200_000).select(F.rand(3).alias("x"), F.rand(4).alias("y"))
    span = quantile.Span("x", None, None, 0, 200_000)
    brackets = quantile._brackets(quantile._sketched(df, [span])[0], {span: {100_000}})
    rows = quantile._zones(df, brackets, keep=True)[0]
    assert len(rows) < 200_000 * 4 * quantile.MARGIN and sum(n for *_, n in rows) == 200_000


def test_histogram_matches_numpy(spark):
    x = [0.0, 0.1, 0.5, 1.0, 2.0, 2.0, 3.999, 4.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = {r.bin: r.n for r in agg.histogram(df, "x", 4).collect()}
    assert [got.get(i, 0) for i in range(4)] == list(np.histogram(x, 4)[0])
    assert agg.histogram(df.filter("x = 2"), "x", 4).first()["n"] == 2


def test_rare_and_frequent(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [("c",)], "s string")
    assert {r.s: r["count"] for r in agg.value_counts(agg.collapse_rare(df, "s", 2), "s").collect()} == {"a": 5, "OTHER": 3}
    rare = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "s string")
    assert sorted((r.s for r in agg.collapse_rare(rare, "s", 1).collect()), key=str) == [None, "OTHER", "a", "a"]
    assert {r.s for r in agg.filter_frequent(df, "s", 1).collect()} == {"a", "b"}


def test_resample_fills_gaps(spark):
    df = spark.sql("select * from values ('a', date'2020-01-15', 2.0), ('a', date'2020-01-20', 3.0), ('a', date'2020-04-01', 1.0), "
                   "('b', date'2019-12-31', 7.0) as t(k, d, v)")
    got = [(r.k, str(r.period), r.value) for r in agg.resample(df, "d", "M", F.sum("v"), ["k"]).orderBy("k", "period").collect()]
    assert got == [("a", "2020-01-31", 5.0), ("a", "2020-02-29", 0.0), ("a", "2020-03-31", 0.0), ("a", "2020-04-30", 1.0),
                   ("b", "2019-12-31", 7.0)]
    assert agg.resample(df, "d", "Y", F.sum("v"), ["k"]).count() == 2
    assert agg.resample(df, "d", "D", F.sum("v"), ["k"]).count() == 79


def test_date_spine(spark):
    b = spark.sql("select date'2020-01-15' as a, date'2020-03-01' as b")
    assert [str(r.date) for r in files.date_spine(b, "a", "b", "MS").collect()] == ["2020-02-01", "2020-03-01"]
    assert files.date_spine(b, "a", "b", "D").count() == 47
    assert files.date_spine(spark.sql("select date'2020-03-02' as a, date'2020-03-01' as b"), "a", "b", "D").count() == 0


# ---- metrics ----------------------------------------------------------------

def test_classification_metrics(spark):
    y, p = [0, 0, 1, 1, 2, 2, 2], [0, 1, 1, 1, 0, 0, 1]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p int")
    rep = {r["class"]: r for r in met.class_report(df, "y", "p").collect()}
    assert rep[2]["precision"] == 0.0 and rep[2]["recall"] == 0.0 and rep[2]["f1"] == 0.0 and rep[1]["precision"] == 0.5
    m = met.classification_metrics(df, "y", "p").first()
    assert m["accuracy"] == pytest.approx(3 / 7) == m["micro_f1"] and m["macro_recall"] == pytest.approx((0.5 + 1 + 0) / 3)
    c = {(r.actual, r.predicted): r.n for r in met.confusion_matrix(df, "y", "p").collect()}
    assert len(c) == 9 and c[2, 2] == 0 and c[2, 0] == 2
    assert met.confusion_counts(df, "y", "p").count() == 5
    with pytest.raises(ValueError, match="classes"):
        met.confusion_matrix(df, "y", "p", max_classes=2)
    nulls = spark.createDataFrame([(None, 0), (1, 0), (1, 1)], "y int, p int")
    n = {(r.actual, r.predicted): r.n for r in met.confusion_matrix(nulls, "y", "p").collect()}
    assert n[None, 0] == 1 and n[1, 0] == 1 and sum(n.values()) == 3 and len(n) == 9


def test_regression_metrics(spark):
    df = spark.createDataFrame([(3.0, 2.0), (5.0, 5.0), (7.0, 9.0), (None, 1.0)], "y double, p double")
    m = met.regression_metrics(df, "y", "p").first()
    assert (m["n"], m["mse"], m["mae"]) == (3, pytest.approx(5 / 3), pytest.approx(1.0)) and m["r2"] == pytest.approx(1 - 5 / 8)
    assert met.signed_sum_error(df.dropna(), "y", "p").first()[0] == pytest.approx(1 / 3**0.5)


def test_auroc_with_ties(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 3, 200), np.round(rng.random((200, 3)), 1)
    df = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, s)], "y int, s array<double>")
    got = {r["class"]: r.auroc for r in met.auroc_ovr(df, "s", "y").collect()}
    for c in range(3):
        pos, neg = s[y == c, c], s[y != c, c]
        wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
        assert got[c] == pytest.approx(wins / len(pos) / len(neg))


# ---- splits -----------------------------------------------------------------

@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame([(i, "hot" if i % 3 else f"c{i % 5}") for i in range(600)], "id bigint, c string").cache()


def test_folds_are_balanced_and_reproducible(classes):
    a = smp.stratified_kfold(classes, "c", 5, "id", 1)
    for r in a.groupBy("c").pivot("kfold").count().collect():
        counts = list(r.asDict().values())[1:]
        assert max(counts) - min(counts) <= 1
    again = smp.stratified_kfold(classes.repartition(7), "c", 5, "id", 1)
    assert sorted(a.select("id", "kfold").collect()) == sorted(again.select("id", "kfold").collect())
    assert a.exceptAll(smp.stratified_kfold(classes, "c", 5, "id", 2)).count() > 0
    train, valid = smp.fold_split(a, 0)
    assert train.count() + valid.count() == 600 and train.join(valid, "id").count() == 0


def test_splits_cover_and_do_not_overlap(classes):
    s = smp.stratified_split(classes, "c", 0.2, "id", 3).groupBy("c").pivot("split").count().collect()
    assert all(r.test == int((r.test + r.train) * 0.2 + 0.5) for r in s)
    b = {r.split: r["count"] for r in smp.band_split(classes, {"a": 100, "b": 50}, "id", 1).groupBy("split").count().collect()}
    assert b == {"a": 100, "b": 500}
    c = smp.band_split(classes, {"a": 700, "b": 1, "c": 1}, "id", 1).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in c} == {"a": 600}
    u = {r.split: r["count"] for r in smp.random_split(classes, {"a": 1, "b": 1, "c": 2}, "id", 1).groupBy("split").count().collect()}
    assert sum(u.values()) == 600 and abs(u["c"] - 300) < 60
    f = {r.fold: r["count"] for r in smp.block_kfold(classes.limit(598), ["id"], 5).groupBy("fold").count().collect()}
    assert sorted(f.values()) == [119, 119, 120, 120, 120] and f[1] == 120
    h = smp.head_tail_split(classes, ["id"], ratio=0.8).filter("split = 'train'")
    assert h.count() == 480 and h.agg(F.max("id")).first()[0] == 479
    assert smp.head_tail_split(classes, ["id"], tail=12).filter("split = 'test'").count() == 12
    assert smp.sample_n(classes, 10, "id", 1).count() == 10


@pytest.mark.parametrize("heavy", [250_000, 50])
def test_ordinals_of_many_and_of_heavy_groups(spark, monkeypatch, heavy):
    """Two heavy groups, one of them null, beside many small ones; only the heavy ones are cut into ranges."""
    monkeypatch.setattr(smp, "HEAVY_ROWS", heavy)
    group = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("g"), F.col("id")))
    df = spark.range(1500).select("id", group.alias("c"))
    assert smp._heavy_groups(df, ["c"]).count() == (2 if heavy == 50 else 0)
    got = smp.hash_ordinal(df, "id", 5, ["c"], name="rn", total="n").toPandas()
    got["d"] = [hashlib.md5(f"{i}|5".encode()).hexdigest() for i in got["id"]]
    want = got.sort_values(["d", "id"]).groupby("c", dropna=False).cumcount() + 1
    assert (want.sort_index() == got["rn"]).all() and (got.groupby("c", dropna=False)["id"].transform("size") == got["n"]).all()
    assert {r.n for r in smp.stratified_split(df, "c", 0.2, "id", 5).groupBy("c", "split").agg(F.count("*").alias("n")).filter("split = 'test'").collect()} == {100}


def test_user_holdout(spark):
    df = spark.createDataFrame([(u, t) for t in range(30) for u in range(4)], "u int, t int")
    one = smp.user_holdout(df, "u", ["t", "u"], 1, 10)
    two = smp.user_holdout(df, "u", ["t", "u"], 11, 20)
    assert {r["count"] for r in one.filter("split = 'test'").groupBy("u").count().collect()} == {10}
    assert one.filter("split = 'test'").join(two.filter("split = 'test'"), ["u", "t"]).count() == 0
    capped = smp.user_holdout(df, "u", ["t", "u"], 1, 10, 6).filter("split = 'test'").collect()
    assert sorted((r.t, r.u) for r in capped) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)]


def test_batches(classes):
    b = smp.batch_ids(classes, ["id"], 64, drop_last=True)
    assert b.count() == 576 and b.select("batch").distinct().count() == 9
    assert smp.batch_ids(classes, ["id"], 64).select("batch").distinct().count() == 10


# ---- features ---------------------------------------------------------------

def test_encoders_and_scalers(spark):
    df = spark.createDataFrame([("b", 1.0, 5.0), ("a", 3.0, 5.0), (None, 8.0, 5.0)], "c string, x double, k double")
    enc, classes = feat.label_encode(df, ["c"])
    assert [r.c for r in enc.orderBy("x").collect()] == [1, 0, None]
    assert [r.c for r in feat.label_decode(enc, "c", classes["c"]).orderBy("x").collect()] == ["b", "a", None]
    d = feat.get_dummies(df, ["c"])
    assert d.columns == ["x", "k", "c_b"] and [r.c_b for r in d.orderBy("x").collect()] == [1, 0, 0]
    z = np.array([r.x for r in feat.standard_scale(df, ["x", "k"]).orderBy("x").collect()])
    x = np.array([1.0, 3.0, 8.0])
    assert np.allclose(z, (x - x.mean()) / x.std())
    params = feat.minmax_fit(df, ["x", "k"])
    assert [r.k for r in feat.minmax_apply(df, params).collect()] == [0.0] * 3
    far = spark.createDataFrame([(-5.0, 5.0), (100.0, 5.0), (None, 5.0)], "x double, k double")
    assert [r.x for r in feat.minmax_apply(far, params, clip=True).collect()] == [0.0, 1.0, None]


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) + 10
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, x0 array<double>")
    out = feat.pca_apply(df, "x0", feat.pca_fit(df, "x0", 2)).orderBy("i").collect()
    got = np.array([r.pc for r in out])
    c = x - x.mean(0)
    exp = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(got), np.abs(exp), atol=1e-6)


def test_wide_pca_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 70)) * np.geomspace(30, 0.01, 70) @ np.linalg.qr(rng.normal(size=(70, 70)))[0] + 1e4  # a mean far from zero
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None)], "i int, v array<double>").repartition(3)
    got = feat.pca_fit(df, "v", 50)
    exact = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.abs(got.variances / exact[:50] - 1).max() < 0.01 and got.total == pytest.approx(exact.sum()) and got.n == 400
    assert np.abs(got.axes.T @ got.axes - np.eye(50)).max() < 1e-9
    out = feat.pca_apply(df, "v", got)
    assert out.filter("i = 900").first().pc is None and len(out.first().pc) == 50
    assert feat.pca_fit(df.limit(0), "v", 3).n == 0


# ---- files ------------------------------------------------------------------

def test_dispatch_by_extension(spark):
    path = scratch_path(spark, "t") + ".json"
    spark.createDataFrame([("hé, \"x\"\nline", 1)], "review string, y int").write.json(path)
    assert files.read_dataset(spark, path, "review", "y", "review string, y int").first()[:] == ("hé, \"x\"\nline", 1)
    with pytest.raises(ValueError):
        files.read_dataset(spark, "/tmp/a.xlsx", "a", "b")
    with pytest.raises(FileNotFoundError):
        files.read_dataset(spark, "/tmp/none-such.csv", "a", "b")


def test_csv_round_trip_and_external_table(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([("a\nb", "say \"hi\""), ("ü", None)], "hostname string, note string")
    files.write_csv(df.coalesce(1), path)
    assert sorted(map(str, files.read_csv(spark, path, df.schema, multi_line=True).collect())) == sorted(map(str, df.collect()))
    files.external_csv_table(spark, "ext_hosts", path, "hostname string")
    files.write_csv(spark.createDataFrame([("a", 1), (None, 2)], "h string, n int"), path + "-null")
    for multi_line in (True, False):
        strict = files.external_csv_table(spark, "ext_strict", path + "-null", "h string, n int", multi_line=multi_line, required=("h",))
        with pytest.raises(Exception, match="required column h"):
            strict.collect()
    out = files.export_hosts(spark, "ext_hosts", scratch_path(spark, "export"), 1)
    assert [r[:] for r in out.collect()] == [("a\nb", "A\nB")]


def test_delimited_latin1(spark, tmp_path):
    (tmp_path / "u.item").write_bytes("1|Café|01-Jan-1995\n2|B|02-Jan-1995\n".encode("latin-1"))
    df = files.read_delimited(spark, str(tmp_path / "u.item"), "|", ["id", "title", "day"], encoding="ISO-8859-1")
    assert [r.title for r in df.orderBy("id").collect()] == ["Café", "B"]


def test_text_tree_and_intents(spark, tmp_path):
    for part in ("train", "test"):
        for kind in ("pos", "neg"):
            (tmp_path / part / kind).mkdir(parents=True)
            (tmp_path / part / kind / "1.txt").write_text(f"{part} {kind}\nsecond line")
    (tmp_path / "train" / "other").mkdir()
    (tmp_path / "train" / "other" / "2.txt").write_text("no label")
    got = {(r.split, r.label): r.text for r in files.read_text_tree(spark, str(tmp_path)).collect()}
    assert got["train", 1] == "train pos\nsecond line" and len(got) == 4
    (tmp_path / "intents.json").write_text('{"intents": [{"intent": "hi", "text": ["a", "b"], "responses": ["r"]},\n {"intent": "bye", "text": ["c"], "responses": []}]}')
    rows = files.load_intents(spark, str(tmp_path / "intents.json")).collect()
    assert sorted((r.intent, r.text) for r in rows) == [("bye", "c"), ("hi", "a"), ("hi", "b")]
