"""Time-series operators against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import timeseries as ts

N = 400


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(2)
    walk = np.cumsum(rng.normal(size=N)) + 50
    ar = np.zeros(N)
    for i in range(2, N):
        ar[i] = 1.0 + 0.5 * ar[i - 1] - 0.3 * ar[i - 2] + rng.normal()
    data = {"walk": walk, "ar": ar}
    rows = [(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, i int, y double").withColumn("t", F.expr("date_add(date'2015-01-01', i)"))
    return df.select("k", "t", "y").cache(), data


def adf(y, lags):
    dy = np.diff(y)
    rows = len(dy) - lags
    x = np.column_stack([np.ones(rows), y[lags:-1]] + [dy[lags - i:len(dy) - i] for i in range(1, lags + 1)])
    b, *_ = np.linalg.lstsq(x, dy[lags:], rcond=None)
    r = dy[lags:] - x @ b
    cov = r @ r / (rows - x.shape[1]) * np.linalg.inv(x.T @ x)
    aic = rows * (np.log(2 * np.pi) + np.log(r @ r / rows) + 1) + 2 * x.shape[1]
    return b[1] / np.sqrt(cov[1, 1]), aic, rows


@pytest.mark.parametrize("calendar", [True, False])
def test_adf(series, calendar):
    df, data = series
    got = {r.k: r for r in ts.adf_test(df, ["k"], "t", "y", max_lag=4, calendar=calendar).collect()}
    for k, y in data.items():
        common = [adf(y[4 - p:], p)[1] for p in range(5)]
        best = int(np.argmin(common))
        stat, _, n = adf(y, best)
        assert got[k].lags_used == best and got[k].n_obs == n and got[k].adf_stat == pytest.approx(stat, rel=1e-6)
    assert got["ar"].stationary and not got["walk"].stationary


def test_adf_lag_bound_is_the_series_own(spark):
    import random
    rng = random.Random(3)
    rows = [(k, np.datetime64("2020-01-01") + i, rng.gauss(0, 1)) for k, n in (("short", 60), ("long", 900)) for i in range(n)]
    df = spark.createDataFrame([(k, str(t), v) for k, t, v in rows], "k string, t string, y double").withColumn("t", F.col("t").cast("date"))
    both = {r.k: r for r in ts.adf_test(df, ["k"], "t", "y").collect()}
    for k in ("short", "long"):
        alone = ts.adf_test(df.filter(F.col("k") == k), ["k"], "t", "y").first()
        assert (alone.lags_used, alone.n_obs) == (both[k].lags_used, both[k].n_obs)
        assert alone.adf_stat == pytest.approx(both[k].adf_stat, rel=1e-6)
    assert (ts.lag_bound(60), ts.lag_bound(900), ts.lag_bound(3)) == (11, 21, 0)


def test_adf_p_values():
    # Published 1 / 5 / 10 percent points of the asymptotic distribution.
    for stat, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert ts.adf_p_value(stat) == pytest.approx(p, abs=0.002)
    assert ts.adf_p_value(3.0) == 1.0 and ts.adf_p_value(-20.0) == 0.0


def test_acf_and_pacf(series):
    df, data = series
    a = {(r.k, r.lag): r.acf for r in ts.acf(df, ["k"], "t", "y", 6).collect()}
    p = {(r.k, r.lag): r.pacf for r in ts.pacf(df, ["k"], "t", "y", 6).collect()}
    for k, y in data.items():
        c = y - y.mean()
        r = np.array([1.0] + [c[i:] @ c[:-i] / (c @ c) for i in range(1, 7)])
        for lag in range(7):
            assert a[k, lag] == pytest.approx(r[lag])
        for m in range(1, 7):
            toeplitz = np.array([[r[abs(i - j)] for j in range(m)] for i in range(m)])
            assert p[k, m] == pytest.approx(np.linalg.solve(toeplitz, r[1:m + 1])[-1])


def test_fit_ar_and_fitted(series):
    df, data = series
    models = {r.k: r for r in ts.fit_ar(df, ["k"], "t", "y", max_p=3, max_d=1).collect()}
    assert models["walk"].d == 1 and models["ar"].d == 0 and models["ar"].p >= 2
    assert models["ar"].coef[1] == pytest.approx(0.5, abs=0.12) and models["ar"].coef[2] == pytest.approx(-0.3, abs=0.12)
    y, m = data["ar"], models["ar"]
    x = np.column_stack([np.ones(N - 3)] + [y[3 - i:N - i] for i in range(1, m.p + 1)])
    beta, *_ = np.linalg.lstsq(x, y[3:], rcond=None)
    assert np.allclose(m.coef, beta, atol=1e-6)
    model = ts.fit_ar(df, ["k"], "t", "y", 3, 1)
    fit = ts.ar_fitted(df, ["k"], "t", "y", model, 3, 1).filter("k = 'ar'").orderBy("t").collect()
    assert len(fit) == N and fit[0].fitted is None
    assert np.allclose([r.fitted for r in fit[3:]], x @ beta, atol=1e-6)


def test_decomposition_recovers_a_season(spark):
    season = np.array([5, 3, 0, -2, -4, -2, 1, 2, -1, -3, 0, 1], dtype=float)
    rows = [(i, float(10 + 0.5 * i + season[i % 12])) for i in range(60)]
    df = spark.createDataFrame(rows, "t int, y double").withColumn("k", F.lit("a"))
    out = ts.seasonal_decompose(df, ["k"], "t", "y", 12).orderBy("t").collect()
    assert out[0].trend is None and out[6].trend == pytest.approx(13.0)
    assert all(r.seasonal == pytest.approx(season[r.t % 12]) for r in out)
    assert max(abs(r.resid) for r in out if r.resid is not None) < 1e-9


@pytest.mark.parametrize("alpha", [0.2, 0.8, 1.0])
def test_ses_in_blocks(series, alpha, monkeypatch):
    df, data = series
    real = ts.with_blocks
    monkeypatch.setattr(ts, "with_blocks", lambda d, o, p, reach, rows: real(d, o, p, reach, max(reach, 60)))
    got = ts.ses(df, ["k"], "t", "y", alpha)
    for k, y in data.items():
        level, exp = y[0], []
        for i, v in enumerate(y):
            fitted = level
            level = v if i == 0 else alpha * v + (1 - alpha) * level
            exp.append((fitted, level))
        rows = got.filter(F.col("k") == k).orderBy("t").collect()
        assert np.allclose([(r.fitted, r.level) for r in rows], exp, atol=1e-9)
        last = ts.ses_forecast(got, ["k"], "t", 3).filter(F.col("k") == k).collect()
        assert len(last) == 3 and all(r.forecast == pytest.approx(exp[-1][1]) for r in last)


def test_holt_winters_finds_a_pure_season(spark):
    season = np.array([1.2, 0.8, 1.0, 1.0])
    y = [(i, float((100 + 2 * i) * season[i % 4])) for i in range(40)]
    df = spark.createDataFrame(y, "t int, y double").withColumn("k", F.lit("a"))
    out = ts.holt_winters(df, ["k"], "t", "y", 4, horizon=8).orderBy("step").collect()
    exp = [(100 + 2 * i) * season[i % 4] for i in range(40, 48)]
    assert np.allclose([r.forecast for r in out], exp, rtol=0.05)
    short = ts.holt_winters(df.limit(7), ["k"], "t", "y", 4, horizon=2).collect()
    assert [(r.forecast, r.reason) for r in short] == [(None, "shorter than two periods")] * 2


def test_fourier_recovers_trend_and_season(spark):
    df = spark.range(1200).withColumn("ds", F.expr("date_add(date'2018-01-01', cast(id as int))")).withColumn("k", F.lit("a"))
    days = F.datediff("ds", F.lit("2000-01-01"))
    df = df.withColumn("y", 5.0 + 0.01 * days + 3 * F.sin(days * 2 * np.pi / 365.25) + F.cos(days * 2 * np.pi / 7))
    out = ts.fourier_forecast(df.select("k", "ds", "y"), ["k"], "ds", "y", 100)
    assert out.count() == 1300
    truth = 5.0 + 0.01 * days + 3 * F.sin(days * 2 * np.pi / 365.25) + F.cos(days * 2 * np.pi / 7)
    assert out.select(F.max(F.abs(F.col("yhat") - truth))).first()[0] < 1e-4
    cv = ts.cross_validate(df.select("k", "ds", "y"), ["k"], "ds", "y", 600, 100, 200, "fourier")
    assert cv.select(F.max(F.abs(F.col("yhat") - F.col("y")))).first()[0] < 1e-3


def test_rolling_origin_by_hand(series):
    df, _ = series
    got = {(r.k, str(r.cutoff), str(r.t)) for r in ts.rolling_origin(df, ["k"], "t", 100, 60, 90).collect()}
    days = np.datetime64("2015-01-01") + np.arange(N)
    exp, cutoff = set(), days[-1] - 90
    while cutoff >= days[0] + 100:
        exp |= {(k, str(cutoff), str(d)) for k in ("walk", "ar") for d in days if cutoff < d <= cutoff + 90}
        cutoff = cutoff - 60
    assert got == exp
    short = ts.rolling_origin(df.filter("t < '2015-03-01'"), ["k"], "t", 100, 60, 90)
    assert short.count() == 0


def test_naive_cross_validation(series):
    df, data = series
    days = list(np.datetime64("2015-01-01") + np.arange(N))
    for r in ts.cross_validate(df, ["k"], "t", "y", 100, 60, 90).collect():
        assert r.yhat == data[r.k][days.index(np.datetime64(r.cutoff))]


def test_future_frame_and_segments(series):
    df, data = series
    assert ts.future_frame(df.select("k", "t"), ["k"], "t", 5).count() == 2 * (N + 5)
    assert ts.future_frame(df.select("k", "t"), ["k"], "t", 5, include_history=False).count() == 10
    seg = ts.segment_series(df, ["k"], ["t"], "y", 24).filter("k = 'ar'").orderBy("segment").collect()
    assert len(seg) == -(-N // 24) and len(seg[-1]["values"]) == N % 24
    assert ts.segment_series(df, ["k"], ["t"], "y", 24, drop_last=True).filter("k = 'ar'").count() == N // 24
    assert seg[1]["values"] == [float(v) for v in data["ar"][24:48]]


def test_smoothing_refuses_an_alpha_outside_its_range(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], "k string, t int, y double")
    for alpha in (0.0, -0.5, 1.5):
        with pytest.raises(ValueError, match="alpha"):
            ts.ses(df, ["k"], "t", "y", alpha)
