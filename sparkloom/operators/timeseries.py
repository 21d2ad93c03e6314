"""Time-series diagnostics and forecasts, parallel over series.

A series has one row per calendar period and key (``resample`` makes one from
raw rows), so the calendar bounds its length. Fits use sums of products per
series; only those small sums, never the rows, meet in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.operators.metrics import regression_metrics
from sparkloom.operators.ordered import frame_windows, with_blocks, with_ordinal
from sparkloom.operators.skew import dimension_join
from sparkloom.operators.windows import diff, lag_col, rolling
from sparkloom.runtime import cut_lineage
from sparkloom.sources.files import date_spine

# Published response surface of the Dickey-Fuller distribution with a constant.
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040),
                "10%": (-2.56677, -1.5384, -2.809, 0.0)}


def adf_p_value(stat: float) -> float:
    if stat > ADF_MAX:
        return 1.0
    if stat < ADF_MIN:
        return 0.0
    coef = ADF_SMALL_P if stat <= ADF_STAR else ADF_LARGE_P
    z = sum(c * stat**i for i, c in enumerate(coef))
    return 0.5 * (1.0 + erf(z / sqrt(2.0)))


# ---- least squares from sums of products ------------------------------------

def gram(df: DataFrame, keys: list[str], x: list[Column], y: Column) -> DataFrame:
    """Per key: n and the upper triangle of [x, y]'[x, y] as one array; a null factor adds nothing."""
    cols = [*x, y]
    terms = [F.sum(F.coalesce(a * b, F.lit(0.0))) for i, a in enumerate(cols) for b in cols[i:]]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*terms).alias("gram"))


def _square(tri: np.ndarray) -> np.ndarray:
    m = int((sqrt(8 * len(tri) + 1) - 1) / 2)
    g = np.zeros((m, m))
    g[np.triu_indices(m)] = tri
    return g + np.triu(g, 1).T


def _solve(g: np.ndarray, cols: list[int]) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares and inverse of X'X for the chosen columns (y is last)."""
    xx, xy = g[np.ix_(cols, cols)], g[cols, -1]
    inv = np.linalg.pinv(xx)
    beta = inv @ xy
    return beta, max(float(g[-1, -1] - 2 * beta @ xy + beta @ xx @ beta), 0.0), inv


def _aic(n: float, ssr: float, params: int) -> float:
    return n * (log(2 * pi) + log(max(ssr, 1e-300) / n) + 1) + 2 * params


def _lags(df: DataFrame, col: str, by: list[str], t: str, n: int, calendar: bool) -> DataFrame:
    return frame_windows(df, lambda w: {f"__l{i}": F.lag(col, i).over(w) for i in range(1, n + 1)}, [t], by, n, calendar)


# ---- diagnostics ------------------------------------------------------------

def lag_bound(n: int) -> int:
    """Most lags tried for a series of ``n`` values."""
    return max(0, min(ceil(12 * (n / 100) ** 0.25), n // 2 - 2))


def adf_test(df: DataFrame, by: list[str], t: str, y: str, max_lag: int | None = None, auto_lag: bool = True,
             calendar: bool = True) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant; the lag order is chosen by AIC.

    The sums are kept apart by how many lags a row has, so that one pass serves
    both the common sample of the order search and the longer final sample.
    """
    stats = cut_lineage(df.groupBy(*by).agg(F.count(y).alias("__n"), F.avg(y).alias("__m"), F.stddev_pop(y).alias("__s")))
    own_bound = max_lag is None
    if own_bound:  # as many lags are laid out as the longest series needs; each series keeps to its own bound
        max_lag = lag_bound(stats.agg(F.max("__n")).first()[0] or 1)
    scaled = dimension_join(df.select(*by, t, y), stats, by).withColumn(
        "__y", (F.col(y) - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0))
    base = frame_windows(scaled, lambda w: {"__p": F.lag("__y", 1).over(w), "__i": F.row_number().over(w)} if calendar
                         else {"__p": F.lag("__y", 1).over(w)}, [t], by, 1, calendar)
    if not calendar:
        base = with_ordinal(base, [t], by, name="__i")
    d = base.withColumn("__d", F.col("__y") - F.col("__p"))
    lagged = _lags(d, "__d", by, t, max_lag, calendar) if max_lag else d
    rows = lagged.filter("__p is not null").withColumn("__depth", F.least(F.col("__i") - 2, F.lit(max_lag)).cast("int"))
    x = [F.lit(1.0), F.col("__p"), *[F.col(f"__l{i}") for i in range(1, max_lag + 1)]]
    sums = gram(rows, [*by, "__depth"], x, F.col("__d"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        def at_least(depth: int) -> tuple[float, np.ndarray]:
            part = pdf[pdf["__depth"] >= depth]
            return float(part["n"].sum()), _square(np.sum(np.stack(part["gram"].to_numpy()), axis=0))

        total = int(pdf["n"].sum()) + 1
        top = min(lag_bound(total) if own_bound else max_lag, max(0, total // 2 - 2), int(pdf["__depth"].max()))
        best = top
        if auto_lag and top:
            n, g = at_least(top)
            best = min(range(top + 1), key=lambda p: (_aic(n, _solve(g, list(range(p + 2)))[1], p + 2), p))
        n, g = at_least(best)
        beta, ssr, inv = _solve(g, list(range(best + 2)))
        free = n - best - 2
        se = sqrt(ssr / free * inv[1, 1]) if free > 0 and ssr > 0 and inv[1, 1] > 0 else 0.0
        stat = float(beta[1]) / se if se else float("nan")
        p = adf_p_value(stat) if se else float("nan")
        crit = [sum(c / n**i for i, c in enumerate(b)) for b in ADF_CRITICAL.values()]
        head = {k: [pdf[k].iloc[0]] for k in by}
        return pd.DataFrame({**head, "adf_stat": [stat], "p_value": [p], "lags_used": [best], "n_obs": [int(n)],
                             "crit_1": [crit[0]], "crit_5": [crit[1]], "crit_10": [crit[2]], "stationary": [bool(p <= 0.05)]})

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)
    schema = (f"{keys}, adf_stat double, p_value double, lags_used int, n_obs bigint, crit_1 double, crit_5 double, "
              "crit_10 double, stationary boolean")
    # At most max_lag + 1 rows of sums per series reach a group.
    return sums.groupBy(*by).applyInPandas(solve, schema)


def stationarity_report(df: DataFrame, by: list[str], t: str, y: str, window: int = 10, max_lag: int | None = None,
                        calendar: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rolling mean and deviation of the rows, and one test row per series."""
    return rolling(df, y, window, by, [t], calendar=calendar), adf_test(df, by, t, y, max_lag, calendar=calendar)


def seasonal_decompose(df: DataFrame, by: list[str], t: str, y: str, period: int = 12) -> DataFrame:
    """Additive trend (centred moving average), seasonal (centred mean per phase) and residual."""
    half = period // 2

    def build(w) -> dict[str, Column]:
        inner = w.rowsBetween(-half, half)
        full = F.count(y).over(inner) == 2 * half + 1
        total = F.sum(y).over(inner)
        if period % 2 == 0:
            total = total - 0.5 * (F.lag(y, half).over(w) + F.lead(y, half).over(w))
        return {"trend": F.when(full, total / period), "__phase": ((F.row_number().over(w) - 1) % period).cast("int")}

    rows = frame_windows(df, build, [t], by, half, calendar=True)
    means = rows.groupBy(*by, "__phase").agg(F.avg(F.col(y) - F.col("trend")).alias("__s"))
    centred = means.withColumn("seasonal", F.col("__s") - F.avg("__s").over(Window.partitionBy(*by)))
    out = dimension_join(rows, centred.drop("__s"), [*by, "__phase"], derived=True)
    return out.withColumn("resid", F.col(y) - F.col("trend") - F.col("seasonal")).drop("__phase")


def acf(df: DataFrame, by: list[str], t: str, y: str, nlags: int, calendar: bool = True) -> DataFrame:
    """Autocorrelations for lags 0..nlags in long form."""
    mean = df.groupBy(*by).agg(F.avg(y).alias("__m"))
    c = dimension_join(df.select(*by, t, y), mean, by, derived=True).withColumn("__y", F.col(y) - F.col("__m"))
    rows = _lags(c, "__y", by, t, nlags, calendar)
    sums = rows.groupBy(*by).agg(F.sum(F.col("__y") * F.col("__y")).alias("__v"), F.array(
        *[F.coalesce(F.sum(F.col("__y") * F.col(f"__l{i}")), F.lit(0.0)) for i in range(1, nlags + 1)]).alias("__c"))
    return sums.select(*by, F.posexplode(F.concat(F.array(F.lit(1.0)), F.transform("__c", lambda s: s / F.col("__v"))))
                       .alias("lag", "acf"))


def pacf(df: DataFrame, by: list[str], t: str, y: str, nlags: int, calendar: bool = True) -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion on the autocorrelations."""
    packed = acf(df, by, t, y, nlags, calendar).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("__a"))

    @F.pandas_udf("array<double>")
    def durbin(arrays: pd.Series) -> pd.Series:
        def one(r: np.ndarray) -> list[float]:
            out, phi = [1.0], np.zeros(0)
            for k in range(1, len(r)):
                gap = 1.0 - phi @ r[1:k]
                last = (r[k] - phi @ r[1:k][::-1]) / gap if abs(gap) > 1e-12 else 0.0
                phi = np.append(phi - last * phi[::-1], last)
                out.append(float(last))
            return out
        return arrays.map(lambda a: one(np.asarray(a, dtype=float)))

    values = durbin(F.transform("__a", lambda s: s["acf"]))
    return packed.select(*by, F.posexplode(values).alias("lag", "pacf"))


# ---- autoregression ---------------------------------------------------------

def fit_ar(df: DataFrame, by: list[str], t: str, y: str, max_p: int, max_d: int = 1, min_p: int = 0,
           calendar: bool = True) -> DataFrame:
    """AR(p) with constant on the d-times differenced series by least squares; (p, d) by AIC.

    One row per series: p, d, aic, sigma2, n and coef = [constant, lag 1, ..., lag p].
    """
    parts = None
    for d in range(max_d + 1):
        z = diff(df.select(*by, t, y), y, by, [t], d, calendar, name="__z") if d else df.select(*by, t, y, F.col(y).alias("__z"))
        lagged = _lags(z, "__z", by, t, max_p, calendar).filter(F.col("__z").isNotNull() & F.col(f"__l{max_p}").isNotNull())
        x = [F.lit(1.0), *[F.col(f"__l{i}") for i in range(1, max_p + 1)]]
        sums = gram(lagged, by, x, F.col("__z")).withColumn("d", F.lit(d))
        parts = sums if parts is None else parts.unionByName(sums)

    @F.pandas_udf("array<struct<p int, aic double, sigma2 double, coef array<double>>>")
    def candidates(n: pd.Series, g: pd.Series) -> pd.Series:
        def one(count: int, tri: np.ndarray) -> list[dict]:
            sq, out = _square(np.asarray(tri, dtype=float)), []
            scale = np.sqrt(np.maximum(np.diag(sq), 1e-300))
            unit = sq / np.outer(scale, scale)
            for p in range(min_p, max_p + 1):
                cols = list(range(p + 1))
                beta, ssr, _ = _solve(unit, cols)
                coef, ssr = beta * scale[-1] / scale[cols], ssr * scale[-1] ** 2
                out.append({"p": p, "aic": _aic(count, ssr, p + 2), "sigma2": ssr / count, "coef": [float(b) for b in coef]})
            return out
        return pd.Series([one(a, b) for a, b in zip(n, g)])

    fits = parts.select(*by, "d", "n", F.explode(candidates("n", "gram")).alias("f"))
    best = fits.groupBy(*by).agg(F.min_by(F.struct("f.p", "d", "f.aic", "f.sigma2", "n", "f.coef"),
                                          F.struct("f.aic", "d", "f.p")).alias("b"))
    return best.select(*by, "b.*")


def ar_fitted(df: DataFrame, by: list[str], t: str, y: str, model: DataFrame, max_p: int, max_d: int,
              calendar: bool = True) -> DataFrame:
    """In-sample one-step predictions and residuals on the original scale."""
    model = cut_lineage(model.select(*by, "d", "coef"))
    base = df.select(*by, t, y)
    out = None
    for d in range(max_d + 1):
        z = diff(base, y, by, [t], d, calendar, name="__z") if d else base.withColumn("__z", F.col(y))
        lagged = dimension_join(_lags(z, "__z", by, t, max_p, calendar), model.filter(F.col("d") == d), by)
        lags = F.array(F.lit(1.0), *[F.col(f"__l{i}") for i in range(1, max_p + 1)])
        pred = F.aggregate(F.zip_with("coef", F.slice(lags, F.lit(1), F.size("coef")), lambda c, x: c * x), F.lit(0.0),
                           lambda a, x: a + x)
        part = lagged.select(*by, t, y, (F.col(y) - F.col("__z") + pred).alias("fitted"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("resid", F.col(y) - F.col("fitted"))


# ---- smoothing --------------------------------------------------------------

def ses(df: DataFrame, by: list[str], t: str, y: str, alpha: float) -> DataFrame:
    """Simple exponential smoothing: ``fitted`` is the level before a row, ``level`` the one after it.

    The first observation starts the level. An old level fades by (1 - alpha) per
    row, so a block that first reads enough earlier rows gets the same doubles as
    the whole series would give; no series is held in one place. ``alpha`` lies above 0, up to 1.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must lie above 0 and not above 1")
    reach = 1 if alpha >= 1 else int(ceil(log(1e-18) / log(1.0 - alpha)))
    blocks = with_blocks(df.select(*by, t, y), [t], by, reach, max(50_000, 10 * reach))

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rn")
        level = pdf[y].astype("float64").ewm(alpha=alpha, adjust=False).mean()
        fitted = level.shift(1)
        fitted.iloc[0] = pdf[y].iloc[0]
        out = pdf.assign(fitted=fitted, level=level)
        return out[out["__home"] == out["__block"]][[*by, t, y, "fitted", "level"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by, t, y).schema.fields)
    return blocks.groupBy(*by, "__block").applyInPandas(smooth, f"{schema}, fitted double, level double")


def ses_forecast(smoothed: DataFrame, by: list[str], t: str, horizon: int = 3) -> DataFrame:
    """The last level, for every step ahead."""
    last = smoothed.groupBy(*by).agg(F.max_by("level", t).alias("forecast"))
    return last.select(*by, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "forecast")


def _hw_grid(y: np.ndarray, period: int, grid: np.ndarray) -> tuple[int, float, float, float, np.ndarray]:
    """Place of the grid point (alpha, beta, gamma) with the least squared one-step error, that error, and its final
    level, trend and season. All points run side by side, one step of time after the other."""
    alpha, beta, gamma = grid.T
    level = np.full(len(grid), y[:period].mean())
    trend = np.full(len(grid), (y[period:2 * period].mean() - y[:period].mean()) / period)
    season = np.repeat((y[:period] / y[:period].mean())[:, None], len(grid), axis=1)
    sse = np.zeros(len(grid))
    for i, value in enumerate(y):
        s, ahead = season[i % period], level + trend
        sse += (value - ahead * s) ** 2
        new = alpha * value / s + (1 - alpha) * ahead
        season[i % period] = gamma * value / ahead + (1 - gamma) * s
        level, trend = new, beta * (new - level) + (1 - beta) * trend
    best = int(np.lexsort((gamma, beta, alpha, sse))[0])
    return best, float(sse[best]), float(level[best]), float(trend[best]), season[:, best]


def holt_winters(df: DataFrame, by: list[str], t: str, y: str, period: int = 12,
                 grid: list[tuple[float, float, float]] | None = None, horizon: int = 36) -> DataFrame:
    """Additive trend, multiplicative season; (alpha, beta, gamma) of least squared error from a grid.

    A series is one row, and meets all grid points there. A series with a value that is not positive, or shorter
    than two periods, has no such model: its steps have a null forecast and a ``reason``.
    """
    steps = (0.1, 0.3, 0.5, 0.7, 0.9)
    points = np.array(grid if grid is not None else [(a, b, g) for a in steps for b in steps for g in steps], dtype=float)
    # One value per calendar period: the calendar bounds the array.
    packed = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(t, F.col(y).cast("double").alias("v")))).alias("__r")) \
        .select(*by, F.transform("__r", lambda r: r["v"]).alias("__y"))
    reason = F.when(F.size("__y") < 2 * period, "shorter than two periods").when(
        ~F.coalesce(F.forall("__y", lambda v: v > 0), F.lit(False)), "a value is not positive")

    @F.pandas_udf("struct<alpha double, beta double, gamma double, sse double, level double, trend double, season array<double>>")
    def run(series: pd.Series) -> pd.DataFrame:
        out = []
        for values in series:
            best, *fit, season = _hw_grid(np.array(values, dtype=float), period, points) if values is not None else (0, *[None] * 3, None)
            out.append([*(points[best] if values is not None else [None] * 3), *fit, None if season is None else list(season)])
        return pd.DataFrame(out, columns=["alpha", "beta", "gamma", "sse", "level", "trend", "season"])

    fitted = packed.withColumn("reason", reason).withColumn("f", run(F.when(F.col("reason").isNull(), F.col("__y"))))
    step = fitted.select(*by, "reason", "f.*", F.size("__y").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    slot = (F.col("n") + F.col("step") - 1) % period
    return step.select(*by, "alpha", "beta", "gamma", "sse", "step",
                       ((F.col("level") + F.col("step") * F.col("trend")) * F.get("season", slot)).alias("forecast"), "reason")


# ---- baselines and forecasts ------------------------------------------------

def naive_forecast(df: DataFrame, by: list[str], t: str, y: str, calendar: bool = True) -> tuple[DataFrame, DataFrame]:
    """The previous value as forecast, and its errors per series."""
    rows = lag_col(df, y, 1, by, [t], "yhat", calendar).filter("yhat is not null")
    return rows, regression_metrics(rows, y, "yhat", by)


def future_frame(df: DataFrame, by: list[str], t: str, periods: int, freq: str = "D", include_history: bool = True) -> DataFrame:
    """Dates of every series followed by ``periods`` later ones."""
    unit = {"D": lambda d, n: F.date_add(d, n), "MS": lambda d, n: F.add_months(d, n)}[freq]
    last = df.groupBy(*by).agg(F.max(F.to_date(t)).alias("__last"))
    ahead = last.select(*by, unit(F.col("__last"), F.lit(1)).alias("__a"), unit(F.col("__last"), F.lit(periods)).alias("__b"))
    future = date_spine(ahead, "__a", "__b", freq, t)
    return df.select(*by, F.to_date(t).alias(t)).unionByName(future) if include_history else future


def fourier_terms(t: str, origin: Column, yearly: int, weekly: int) -> list[Column]:
    """1, time in years, and sine / cosine pairs of the year and the week."""
    days = F.datediff(F.to_date(t), origin).cast("double")
    out = [F.lit(1.0), days / 365.25]
    for period, order in ((365.25, yearly), (7.0, weekly)):
        for k in range(1, order + 1):
            angle = days * (2 * pi * k / period)
            out += [F.sin(angle), F.cos(angle)]
    return out


ORIGIN = "2000-01-01"


def _fourier_models(sums: DataFrame, keys: list[str]) -> DataFrame:
    @F.pandas_udf("struct<coef array<double>, sigma double>")
    def fit(n: pd.Series, g: pd.Series) -> pd.DataFrame:
        out = []
        for count, tri in zip(n, g):
            sq = _square(np.asarray(tri, dtype=float))
            beta, ssr, _ = _solve(sq, list(range(len(sq) - 1)))
            out.append(([float(b) for b in beta], sqrt(ssr / max(count - len(beta), 1))))
        return pd.DataFrame(out, columns=["coef", "sigma"])
    return sums.select(*keys, fit("n", "gram").alias("m")).select(*keys, "m.*")


def _fourier_predict(rows: DataFrame, t: str, yearly: int, weekly: int, width: float) -> DataFrame:
    x = F.array(*fourier_terms(t, F.lit(ORIGIN).cast("date"), yearly, weekly))
    yhat = F.aggregate(F.zip_with("coef", x, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    out = rows.withColumn("yhat", yhat)
    return out.withColumns({"yhat_lower": F.col("yhat") - width * F.col("sigma"),
                            "yhat_upper": F.col("yhat") + width * F.col("sigma")}).drop("coef", "sigma")


def fourier_forecast(df: DataFrame, by: list[str], ds: str, y: str, periods: int, freq: str = "D", yearly: int = 3,
                     weekly: int = 2, width: float = 1.28) -> DataFrame:
    """Linear trend with yearly and weekly seasonality by least squares; interval of ``width`` deviations."""
    x = fourier_terms(ds, F.lit(ORIGIN).cast("date"), yearly, weekly)
    models = _fourier_models(gram(df, by, x, F.col(y).cast("double")), by)
    frame = future_frame(df, by, ds, periods, freq)
    return _fourier_predict(dimension_join(frame, cut_lineage(models), by, probe=True), ds, yearly, weekly, width)


def cutoff_bounds(df: DataFrame, by: list[str], ds: str, initial: int, period: int, horizon: int) -> DataFrame:
    """Latest cutoff and number of cutoffs per series: from the end minus the horizon, back by
    ``period`` days while ``initial`` days of history remain."""
    b = df.groupBy(*by).agg(F.min(F.to_date(ds)).alias("__lo"), F.max(F.to_date(ds)).alias("__hi"))
    last = F.date_sub("__hi", horizon)
    room = F.datediff(last, F.date_add("__lo", initial))
    cuts = (F.floor(room / period) + 1).cast("int")
    return cut_lineage(b.select(*by, last.alias("__last"), cuts.alias("__cuts")).filter("__cuts > 0"))


def rolling_origin(df: DataFrame, by: list[str], ds: str, initial: int, period: int, horizon: int,
                   bounds: DataFrame | None = None) -> DataFrame:
    """Test rows of every origin: cutoff < ds <= cutoff + horizon.

    The cutoffs form a regular grid, so every row works out its own ones; no
    range join is needed.
    """
    bounds = bounds if bounds is not None else cutoff_bounds(df, by, ds, initial, period, horizon)
    rows = dimension_join(df, bounds, by)
    back = F.datediff("__last", F.to_date(ds))
    # Cutoff j lies j * period days before the last one.
    lo = F.greatest(F.floor(back / period) + 1, F.lit(0)).cast("int")
    hi = F.least(F.floor((back + horizon) / period), F.col("__cuts") - 1).cast("int")
    which = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("__j", F.explode(which)) \
        .withColumn("cutoff", F.date_sub("__last", (F.col("__j") * period).cast("int"))).drop("__j", "__last", "__cuts")


def cross_validate(df: DataFrame, by: list[str], ds: str, y: str, initial: int = 1095, period: int = 180, horizon: int = 365,
                   forecaster: str = "naive", yearly: int = 3, weekly: int = 2, width: float = 1.28) -> DataFrame:
    """Rolling-origin forecasts: (by, ds, cutoff, y, yhat[, yhat_lower, yhat_upper]).

    Training state is summed per step between cutoffs and accumulated over the
    few cutoffs, so no row is copied once per cutoff.
    """
    slim = df.select(*by, ds, y)
    bounds = cutoff_bounds(slim, by, ds, initial, period, horizon)
    test = rolling_origin(slim, by, ds, initial, period, horizon, bounds)
    # A training row counts from the earliest cutoff that may use it: the largest step back.
    steps_back = F.least(F.floor(F.datediff("__last", F.to_date(ds)) / period), F.col("__cuts") - 1).cast("int")
    train = dimension_join(slim, bounds, by).withColumn("__j", steps_back).filter("__j >= 0")
    upto = Window.partitionBy(*by).orderBy(F.col("__j").desc()).rowsBetween(Window.unboundedPreceding, 0)
    spine = bounds.select(
        *by, "__last", F.explode(F.sequence(F.lit(0), F.col("__cuts") - 1)).alias("__j"))
    cutoff = F.date_sub("__last", (F.col("__j") * period).cast("int")).alias("cutoff")
    if forecaster == "naive":
        step = train.groupBy(*by, "__j").agg(F.max_by(y, ds).alias("__v"))
        state = spine.join(step, [*by, "__j"], "left").select(*by, cutoff, F.last("__v", ignorenulls=True).over(upto).alias("yhat"))
        return dimension_join(test, state, [*by, "cutoff"], derived=True)
    if forecaster != "fourier":
        raise ValueError("forecaster is 'naive' or 'fourier'")
    x = fourier_terms(ds, F.lit(ORIGIN).cast("date"), yearly, weekly)
    step = gram(train, [*by, "__j"], x, F.col(y).cast("double"))
    size = len(x) + 1
    cells = size * (size + 1) // 2
    sums = spine.join(step, [*by, "__j"], "left").select(
        *by, cutoff, F.sum("n").over(upto).alias("n"),
        F.array(*[F.sum(F.get("gram", F.lit(i))).over(upto) for i in range(cells)]).alias("gram"))
    models = _fourier_models(sums, [*by, "cutoff"])
    return _fourier_predict(dimension_join(test, cut_lineage(models), [*by, "cutoff"], probe=True), ds, yearly, weekly, width)


def segment_series(df: DataFrame, by: list[str], t: list[str], y: str, n: int = 24, drop_last: bool = False) -> DataFrame:
    """Consecutive segments of ``n`` values as arrays; the last may be shorter, and is left out if ``drop_last``."""
    rows = with_ordinal(df.select(*by, *t, y), t, by, name="__rn").withColumn("segment", F.floor((F.col("__rn") - 1) / n))
    packed = rows.groupBy(*by, "segment").agg(F.array_sort(F.collect_list(F.struct("__rn", F.col(y).alias("v")))).alias("__s"))
    whole = packed.filter(F.size("__s") == n) if drop_last else packed
    return whole.select(*by, "segment", F.transform("__s", lambda s: s["v"]).alias("values"))
