"""Forecasting of many monthly series at once.

A series is one row per month, so whatever is collected per series is bounded by the calendar; the
work is spread over the series.  Recursions are folds over the ordered array of a series, regressions
sum their cross products in Spark and solve a small system per series.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.functions.linear import cross_products, least_squares, solve, square
from paramo.functions.parsing import rounded
from paramo.functions.search import minimise
from paramo.operators.features import interpolate
from paramo.session import cut_lineage, materialise

SEASON = 12
LEAST_POINTS = 12


def regularise(df: DataFrame, key: str = "series_key", month: str = "month", value: str = "y", least: int = LEAST_POINTS) -> DataFrame:
    """Unbroken months per series, gaps filled on the line between their neighbours; short series are left out."""
    known = df.where(F.col(value).isNotNull()).groupBy(key, F.trunc(month, "month").alias("month")).agg(F.avg(value).alias("y"))
    spans = known.groupBy(key).agg(F.min("month").alias("a"), F.max("month").alias("b"), F.count("*").alias("n")).where(F.col("n") >= least)
    months = spans.select(key, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return interpolate(months.join(known, [key, "month"], "left"), ["y"], by=[key])


def forward(value: Column, kind: Column | str) -> Column:
    """Variance-steadying transform: log (floor 0.01), sqrt (floor 0) or none."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return (F.when(k == "log", F.ln(F.greatest(value, F.lit(0.01)))).when(k == "sqrt", F.sqrt(F.greatest(value, F.lit(0.0)))).otherwise(value))


def inverse(value: Column, kind: Column | str) -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(k == "log", F.exp(value)).when(k == "sqrt", value * value).otherwise(value)


def series_arrays(df: DataFrame, key: str = "series_key", kind: str = "none") -> DataFrame:
    """One row per series: last month, last value and the transformed values in order."""
    return df.groupBy(key).agg(
        F.max("month").alias("last_month"), F.max_by("y", "month").alias("last_value"),
        F.sort_array(F.collect_list(F.struct("month", forward(F.col("y"), kind).alias("y")))).alias("_p"),
    ).withColumn("y", F.col("_p.y")).drop("_p").withColumns({"n": F.size("y"), "kind": F.lit(kind)})


# --- Holt-Winters --------------------------------------------------------------------------

def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def holt_winters_start(df: DataFrame, m: int = SEASON) -> DataFrame:
    """Seasonal form and starting level, trend and season of each series.

    Two full cycles allow a multiplicative season, one cycle an additive one.  A value of zero or less
    rules the multiplicative form out, and the series is then fitted without a season.
    """
    first, second = F.slice("y", 1, m), F.slice("y", m + 1, m)
    long = F.col("n") >= 2 * m
    mode = F.when(long & (F.array_min("y") > 0), "mul").when(~long & (F.col("n") >= m), "add").otherwise("none")
    df = df.withColumns({"mode": mode, "l0": _mean(first)})
    df = df.withColumn("b0", F.when(long, (_mean(second) - F.col("l0")) / m).otherwise(
        (F.element_at("y", F.least(F.col("n"), F.lit(m))) - F.element_at("y", 1)) / F.greatest(F.least(F.col("n"), F.lit(m)) - 1, F.lit(1))))
    level, kind = F.col("l0"), F.col("mode")
    return df.withColumn("s0", F.when(kind == "mul", F.transform(first, lambda x: x / level))
                         .when(kind == "add", F.transform(first, lambda x: x - level))
                         .otherwise(F.array_repeat(F.lit(0.0), m)))


def _smooth(state: Column, y: Column, at: Column, mode: Column, a: Column, b: Column, g: Column, phi: Column):
    """One step: (forecast of y, new level, new trend, new season)."""
    mul = mode == "mul"
    season = F.get(state["s"], at)
    base = state["l"] + phi * state["b"]
    guess = F.when(mul, base * season).otherwise(base + season)
    level = a * F.when(mul, y / season).otherwise(y - season) + (1 - a) * base
    trend = b * (level - state["l"]) + (1 - b) * phi * state["b"]
    rate = F.when(mode == "none", 0.0).otherwise(g)
    fresh = rate * F.when(mul, y / base).otherwise(y - base) + (1 - rate) * season
    return guess, level, trend, F.transform(state["s"], lambda x, j: F.when(j == at, fresh).otherwise(x))


def holt_winters_fit(df: DataFrame, m: int = SEASON, keep_fitted: bool = True) -> DataFrame:
    """Run the recursion with the columns alpha, beta, gamma, phi; adds ``fit`` (level, trend, season,
    squared error and, when asked for, the fitted values)."""
    a, b, g, phi, mode = (F.col(c) for c in ("alpha", "beta", "gamma", "phi", "mode"))
    start = F.struct(F.col("l0").alias("l"), F.col("b0").alias("b"), F.col("s0").alias("s"), F.lit(0).alias("i"),
                     F.lit(0.0).alias("sse"), F.array().cast("array<double>").alias("f"))

    def step(state: Column, y: Column) -> Column:
        guess, level, trend, season = _smooth(state, y, state["i"] % m, mode, a, b, g, phi)
        error = y - guess
        fitted = F.concat(state["f"], F.array(guess)) if keep_fitted else state["f"]
        return F.struct(level.alias("l"), trend.alias("b"), season.alias("s"), (state["i"] + 1).alias("i"),
                        (state["sse"] + error * error).alias("sse"), fitted.alias("f"))

    return df.withColumn("fit", F.aggregate("y", start, step))


GRID = [(a, b, g, p) for a in (0.1, 0.3, 0.5, 0.8) for b in (0.02, 0.1, 0.3) for g in (0.05, 0.2, 0.5) for p in (0.85, 0.95, 0.98)]


#: Least and greatest alpha, beta, gamma and phi of a search; series worked on side by side.
BOUNDS = np.array([(0.001, 0.999), (0.001, 0.999), (0.001, 0.999), (0.8, 0.98)])
SIDE_BY_SIDE = 512


def smoothing_error(y: np.ndarray, n: np.ndarray, mode: np.ndarray, level: np.ndarray, trend: np.ndarray, season: np.ndarray, params: np.ndarray) -> np.ndarray:
    """The squared error of the recursion of many series side by side; a row of ``y`` has ``n`` values, then anything."""
    a, b, g, phi = params.T
    mul, g = mode == "mul", np.where(mode == "none", 0, g)
    season, total, m = season.copy(), np.zeros(len(y)), season.shape[1]
    with np.errstate(all="ignore"):
        for t in range(int(n.max(initial=0))):
            live, now, seen = t < n, season[:, t % m], y[:, t]
            base = level + phi * trend
            total += np.where(live, (seen - np.where(mul, base * now, base + now)) ** 2, 0)
            fresh_level = a * np.where(mul, seen / now, seen - now) + (1 - a) * base
            trend = np.where(live, b * (fresh_level - level) + (1 - b) * phi * trend, trend)
            season[:, t % m] = np.where(live, g * np.where(mul, seen / base, seen - base) + (1 - g) * now, now)
            level = np.where(live, fresh_level, level)
    return total


def _refined(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows with the parameters of least squared error found from those they have."""
    n = pdf["n"].to_numpy()
    y = np.zeros((len(pdf), n.max(initial=1)))
    for k, v in enumerate(pdf["y"]):
        y[k, :n[k]] = v
    season, mode = np.stack([np.asarray(v, float) for v in pdf["s0"]]), pdf["mode"].to_numpy()
    level, trend = pdf["l0"].to_numpy(float), pdf["b0"].to_numpy(float)
    names = ["alpha", "beta", "gamma", "phi"]
    low, wide = BOUNDS[:, 0], BOUNDS[:, 1] - BOUNDS[:, 0]
    start = pdf[names].to_numpy(float)
    inside = np.clip((start - low) / wide, 1e-6, 1 - 1e-6)

    def given(u: np.ndarray) -> np.ndarray:
        return low + wide / (1 + np.exp(-np.clip(u, -30, 30)))

    def errors(rows: np.ndarray, params: np.ndarray) -> np.ndarray:
        return smoothing_error(y[rows], n[rows], mode[rows], level[rows], trend[rows], season[rows], params)

    before = errors(np.arange(len(pdf)), start)
    unit = np.where(before > 0, before, 1.0)  # relative costs, whatever the scale of a series

    def cost(rows: np.ndarray, u: np.ndarray) -> np.ndarray:
        at = np.repeat(rows, u.shape[1])
        return (errors(at, given(u.reshape(-1, 4))) / unit[at]).reshape(u.shape[:2])

    u, f = minimise(cost, np.log(inside / (1 - inside)))
    better = (f * unit < before)[:, None]
    return pdf.assign(**dict(zip(names, np.where(better, given(u), start).T)))


def holt_winters(df: DataFrame, key: str = "series_key", kind: str = "none", m: int = SEASON,
                 grid: Sequence[tuple[float, float, float, float]] = tuple(GRID), remove_bias: bool = True, search: bool = False) -> DataFrame:
    """Fit every series (regular months) with the parameters of the grid that err least.

    The grid is unfolded per series, scored, and only the best parameters run again to keep fitted values.  With ``search``
    they are first improved by a search within BOUNDS; the squared error is never above that of the grid.
    """
    base = holt_winters_start(series_arrays(df, key, kind), m)
    choices = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("alpha", "beta", "gamma", "phi"), p)]) for p in grid])
    if len(grid) > 1:
        tried = holt_winters_fit(base.withColumn("_g", F.explode(choices)).select("*", "_g.*"), m, keep_fitted=False)
        best = tried.groupBy(key).agg(F.min_by("_g", F.col("fit")["sse"]).alias("_g"))
        base = base.join(best, key)
    else:
        base = base.withColumn("_g", choices[0])
    base = base.select("*", "_g.*").drop("_g")
    if search:
        def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), SIDE_BY_SIDE):
                    yield _refined(pdf.iloc[at:at + SIDE_BY_SIDE])

        base = base.mapInPandas(refine, base.schema)
    out = holt_winters_fit(base, m)
    residuals = F.zip_with("y", F.col("fit")["f"], lambda y, f: y - f)
    out = out.withColumn("residuals", residuals)
    return out.withColumn("bias", _mean(F.col("residuals")) if remove_bias else F.lit(0.0))


def holt_winters_forecast(fits: DataFrame, horizon: int = 6, key: str = "series_key", m: int = SEASON) -> DataFrame:
    """(key, month, step, hw): the coming months on the original scale."""
    fit = F.col("fit")
    steps = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    damp = F.col("phi") * (1 - F.pow("phi", F.col("step"))) / (1 - F.col("phi"))
    base = fit["l"] + damp * fit["b"]
    season = F.get(fit["s"], (F.col("n") + F.col("step") - 1) % m)
    value = F.when(F.col("mode") == "mul", base * season).otherwise(base + season) + F.col("bias")
    return steps.select(key, F.add_months("last_month", F.col("step")).alias("month"), "step", inverse(value, F.col("kind")).alias("hw"))


def holt_winters_intervals(fits: DataFrame, horizon: int = 6, key: str = "series_key", m: int = SEASON, paths: int = 500,
                           alpha: float = 0.05, seed: int = 2026) -> DataFrame:
    """(key, month, step, low, high) from simulated paths.

    A path draws past residuals by a hash of (seed, series, path, step), so the draw does not depend on the
    partitioning.  The percentiles are over ``paths`` values per series and step.
    """
    a, b, g, phi, mode = (F.col(c) for c in ("alpha", "beta", "gamma", "phi", "mode"))
    runs = fits.withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(paths))))
    fit = F.col("fit")
    draws = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.get(
        F.col("residuals"), F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("path"), h), F.size("residuals")).cast("int")))
    start = F.struct(fit["l"].alias("l"), fit["b"].alias("b"), fit["s"].alias("s"), F.col("n").alias("i"), F.array().cast("array<double>").alias("f"))

    def step(state: Column, error: Column) -> Column:
        base = state["l"] + phi * state["b"]
        season = F.get(state["s"], state["i"] % m)
        y = F.when(mode == "mul", base * season).otherwise(base + season) + error
        _, level, trend, seasons = _smooth(state, y, state["i"] % m, mode, a, b, g, phi)
        return F.struct(level.alias("l"), trend.alias("b"), seasons.alias("s"), (state["i"] + 1).alias("i"), F.concat(state["f"], F.array(y)).alias("f"))

    walked = runs.select(key, "last_month", "kind", F.posexplode(F.aggregate(draws, start, step, lambda s: s["f"])).alias("_h", "value"))
    value = inverse(F.col("value"), F.col("kind"))
    return walked.groupBy(key, F.add_months("last_month", F.col("_h") + 1).alias("month"), (F.col("_h") + 1).alias("step")).agg(
        F.percentile(value, F.lit(alpha / 2)).alias("low"), F.percentile(value, F.lit(1 - alpha / 2)).alias("high"))


def plain_band(df: DataFrame, value: str, share: float = 0.05) -> DataFrame:
    """The +-5 % band used where nothing can be simulated."""
    return df.withColumns({"low": F.col(value) * (1 - share), "high": F.col(value) * (1 + share)})


# --- seasonal ARIMA by two-stage regression (Hannan and Rissanen) ------------------------------

# (rank, seasonal difference, autoregressive lags, moving-average lags), tried in this order
ORDERS = [
    (1, True, (1, 12, 13), (1, 12, 13)),
    (2, True, (1, 12, 13), ()),
    (3, True, (), (1, 12, 13)),
    (4, False, (1,), (1,)),
]
LONG_LAGS = {True: (1, 2, 3, 12, 13), False: (1, 2, 3)}
HISTORY = 13


def _lags(df: DataFrame, key: str, column: str, lags: Sequence[int], prefix: str) -> DataFrame:
    w = W.partitionBy(key).orderBy("month")
    return df.withColumns({f"{prefix}{j}": F.lag(column, j).over(w) for j in lags})


def _fitted(columns: Sequence[str], beta: Column) -> Column:
    total = F.lit(0.0)
    for j, c in enumerate(columns):
        total = total + F.col(c) * F.get(beta, F.lit(j))
    return total


def sarima_fit(df: DataFrame, key: str = "series_key", kind: str = "none", m: int = SEASON) -> DataFrame:
    """The first order of the list that can be estimated, per series.

    A long autoregression supplies residuals; the second regression uses lagged values and lagged
    residuals.  Both systems are sums over the rows of a series, solved per series.
    """
    base = df.select(key, "month", forward(F.col("y"), kind).alias("y"))
    w = W.partitionBy(key).orderBy("month")
    base = base.withColumn("d1", F.col("y") - F.lag("y").over(w))
    tries = None
    for seasonal in (True, False):
        work = base.withColumn("x", F.col("d1") - F.lag("d1", m).over(w) if seasonal else F.col("d1"))
        work = _lags(work, key, "x", sorted({*LONG_LAGS[seasonal], 1, *((12, 13) if seasonal else ())}), "x")
        long = [f"x{j}" for j in LONG_LAGS[seasonal]]
        first = least_squares(work, [key], long, "x").select(key, F.col("beta").alias("_long"))
        # before its lags exist, a residual counts as zero
        rest = F.coalesce(F.col("x") - _fitted(long, F.col("_long")), F.when(F.col("x").isNotNull(), F.lit(0.0)))
        work = _lags(work.join(first, key).withColumn("e", rest), key, "e", (1, 12, 13) if seasonal else (1,), "e")
        history = work.groupBy(key).agg(
            F.max("month").alias("last_month"), F.count("*").alias("n"),
            F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("month", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("e", F.lit(0.0)).alias("e"), "y")))), 1, HISTORY).alias("_h"))
        for rank, is_seasonal, ar, ma in ORDERS:
            if is_seasonal != seasonal:
                continue
            names = [f"x{j}" for j in ar] + [f"e{j}" for j in ma]
            fit = least_squares(work, [key], names, "x").where(F.col("beta").isNotNull() & (F.col("n") >= 2 * len(names) + 1))
            at = {name: F.get(F.col("beta"), F.lit(j)) for j, name in enumerate(names)}
            coef = lambda p: F.array(*[at.get(f"{p}{j}", F.lit(0.0)) for j in (1, 12, 13)])
            fit = fit.select(key, F.lit(rank).alias("rank"), F.lit(seasonal).alias("seasonal"), coef("x").alias("ar"), coef("e").alias("ma"),
                             F.sqrt(F.col("sse") / F.greatest(F.col("n") - len(names), F.lit(1))).alias("sigma"))
            fit = fit.join(history, key).select(key, F.struct("rank", "seasonal", "ar", "ma", "sigma", "last_month", "n", "_h").alias("_fit"))
            tries = fit if tries is None else tries.unionByName(fit)
    best = tries.groupBy(key).agg(F.min_by("_fit", F.col("_fit")["rank"]).alias("_fit"))
    return best.select(key, "_fit.*").withColumn("kind", F.lit(kind))


def _roll(seasonal: Column, ar: Column, ma: Column, x: Column, e: Column, y: Column, horizon: int) -> Column:
    """Values of the next steps from the latest values first arrays of differences, residuals and levels."""
    def term(weights: Column, past: Column) -> Column:
        return sum((F.get(weights, F.lit(i)) * F.coalesce(F.get(past, F.lit(j)), F.lit(0.0)) for i, j in enumerate((0, 11, 12))), F.lit(0.0))

    start = F.struct(x.alias("x"), e.alias("e"), y.alias("y"), F.array().cast("array<double>").alias("f"))

    def step(s: Column, _: Column) -> Column:
        diff = term(ar, s["x"]) + term(ma, s["e"])
        level = diff + F.get(s["y"], F.lit(0)) + F.when(seasonal, F.get(s["y"], F.lit(11)) - F.get(s["y"], F.lit(12))).otherwise(0.0)
        push = lambda past, v: F.concat(F.array(v), F.slice(past, 1, HISTORY - 1))
        return F.struct(push(s["x"], diff).alias("x"), push(s["e"], F.lit(0.0)).alias("e"), push(s["y"], level).alias("y"), F.concat(s["f"], F.array(level)).alias("f"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda s: s["f"])


def sarima_forecast(fits: DataFrame, horizon: int = 6, key: str = "series_key", z: float = 1.959963984540054) -> DataFrame:
    """(key, month, step, arima, arima_low, arima_high); the spread grows with the impulse response."""
    fits = fits.withColumns({"hx": F.col("_h.x"), "he": F.col("_h.e"), "hy": F.col("_h.y")})
    one = F.array(F.lit(1.0), *[F.lit(0.0)] * (HISTORY - 1))
    args = [F.col(c) for c in ("seasonal", "ar", "ma")]
    out = fits.withColumns({"mean": _roll(*args, F.col("hx"), F.col("he"), F.col("hy"), horizon), "psi": _roll(*args, one, one, one, horizon)})
    spread = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.col("sigma") * F.sqrt(F.aggregate(
        F.slice("psi", 1, h - 1), F.lit(1.0), lambda s, p: s + p * p)))
    out = out.withColumn("spread", spread).select(key, "last_month", "kind", F.posexplode(F.arrays_zip("mean", "spread")).alias("_i", "_v"))
    mean, wide = F.col("_v")["mean"], F.col("_v")["spread"] * z
    kind = F.col("kind")
    return out.select(key, F.add_months("last_month", F.col("_i") + 1).alias("month"), (F.col("_i") + 1).alias("step"),
                      inverse(mean, kind).alias("arima"), inverse(mean - wide, kind).alias("arima_low"), inverse(mean + wide, kind).alias("arima_high"))


# --- unit-root test -----------------------------------------------------------------------------

# 5 % response surface of the constant-only test (MacKinnon, 2010)
MACKINNON_5 = (-2.86154, -2.8903, -4.234, -40.040)


def stationarity(df: DataFrame, key: str = "series_key", max_lag: int = 12) -> DataFrame:
    """(key, lag, t_stat, critical, stationary): augmented Dickey-Fuller test at 5 %.

    The lag comes from the lowest AIC over one common sample.  One pass sums the cross products for the
    longest lag; shorter lags are the leading part of the same system.
    """
    w = W.partitionBy(key).orderBy("month")
    rows = df.select(key, "month", "y", F.count("*").over(W.partitionBy(key)).alias("_size"))
    cap = F.least(F.lit(max_lag), F.ceil(12 * F.pow(F.col("_size") / 100, 0.25)), F.floor(F.col("_size") / 2) - 2).cast("int")
    rows = rows.withColumns({"lag1": F.lag("y").over(w), "cap": cap}).withColumn("dy", F.col("y") - F.col("lag1"))
    rows = rows.withColumns({f"d{j}": F.lag("dy", j).over(w) for j in range(1, max_lag + 1)}).withColumn("one", F.lit(1.0))
    names = ["one", "lag1", *[f"d{j}" for j in range(1, max_lag + 1)]]
    k = len(names)

    def limited(frame: DataFrame, limit: Column) -> DataFrame:
        """Lags beyond the limit become zero columns; rows need only the lags up to it."""
        return frame.withColumns({f"d{j}": F.when(F.lit(j) <= limit, F.col(f"d{j}")).otherwise(0.0) for j in range(1, max_lag + 1)})

    sums = cross_products(limited(rows, F.col("cap")), [key, "cap"], names, "dy")
    kinds = dict(df.dtypes)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            picks = []
            for n, yy, xx, xy, top in zip(pdf["n"], pdf["yy"], pdf["xx"], pdf["xy"], pdf["cap"]):
                gram, xy = square(xx, k), np.asarray(xy, dtype=float)
                scores = {}
                for lag in range(0, int(top) + 1):
                    fit = solve(n, yy, gram[:lag + 2, :lag + 2], xy[:lag + 2])
                    if fit and fit[2] > 0:
                        scores[lag] = n * np.log(fit[2] / n) + 2 * (lag + 2)
                picks.append(min(scores, key=scores.get) if scores else 0)
            yield pdf[[key]].assign(lag=picks)

    lags = sums.mapInPandas(choose, f"`{key}` {kinds[key]}, lag int")
    fit = least_squares(limited(rows.join(lags, key), F.col("lag")), [key, "lag"], names, "dy")
    b0, b1, b2, b3 = MACKINNON_5
    n = F.col("n").cast("double")
    t = F.get(F.col("beta"), F.lit(1)) / F.nullif(F.get(F.col("se"), F.lit(1)), F.lit(0.0))
    out = fit.select(key, "lag", t.alias("t_stat"), (b0 + b1 / n + b2 / (n * n) + b3 / (n * n * n)).alias("critical"))
    return out.withColumn("stationary", F.coalesce(F.col("t_stat") < F.col("critical"), F.lit(False)))


# --- measures, ensemble, output ------------------------------------------------------------------

def metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (), digits: int | None = 4) -> DataFrame:
    """RMSE, MAE and MAPE over rows with both values and a non-zero actual; zeros when none is left."""
    ok = F.col(actual).isNotNull() & F.col(predicted).isNotNull() & ~F.isnan(actual) & ~F.isnan(predicted) & (F.col(actual) != 0)
    error = F.when(ok, F.col(actual) - F.col(predicted))
    zero = F.lit(0.0)
    return df.groupBy(*by).agg(
        rounded(F.coalesce(F.sqrt(F.avg(error * error)), zero), digits).alias("rmse"),
        rounded(F.coalesce(F.avg(F.abs(error)), zero), digits).alias("mae"),
        rounded(F.coalesce(F.avg(F.abs(error / F.col(actual))) * 100, zero), digits).alias("mape"))


def linear_trend(df: DataFrame, horizon: int = 6, key: str = "series_key", kind: str = "none") -> DataFrame:
    """(key, month, step, trend): last value plus slope per month, on the transformed scale."""
    w = W.partitionBy(key).orderBy("month")
    rows = df.select(key, "month", forward(F.col("y"), kind).alias("y"), (F.row_number().over(w) - 1).alias("x"))
    line = rows.groupBy(key).agg(F.regr_slope("y", "x").alias("slope"), F.max_by("y", "month").alias("last"), F.max("month").alias("last_month"))
    line = line.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return line.select(key, F.add_months("last_month", F.col("step")).alias("month"), "step",
                       inverse(F.col("last") + F.coalesce("slope", F.lit(0.0)) * F.col("step"), kind).alias("trend"))


def ensemble(hw: DataFrame, arima: DataFrame, trend: DataFrame, key: str = "series_key") -> DataFrame:
    """0.6 Holt-Winters + 0.4 ARIMA for value and bounds; whichever exists alone; else the trend with 5 % bands.

    Inputs: (key, month, hw, low, high), (key, month, arima, arima_low, arima_high), (key, month, trend).
    """
    out = trend.join(hw, [key, "month"], "full").join(arima, [key, "month"], "full")
    both, h, a = F.col("hw").isNotNull() & F.col("arima").isNotNull(), F.col("hw").isNotNull(), F.col("arima").isNotNull()

    def mix(x: str, y: str, fallback: Column) -> Column:
        return F.when(both, F.col(x) * 0.6 + F.col(y) * 0.4).when(h, F.col(x)).when(a, F.col(y)).otherwise(fallback)

    t = F.col("trend")
    return out.select(
        key, "month", mix("hw", "arima", t).alias("value"), mix("low", "arima_low", t * 0.95).alias("low"),
        mix("high", "arima_high", t * 1.05).alias("high"),
        F.when(both, "ensemble").when(h, "holt_winters").when(a, "sarima").otherwise("trend").alias("model"))


def output(history: DataFrame, forecast: DataFrame, key: str = "series_key", last: int = 12) -> DataFrame:
    """The last actual months followed by the forecast, with direction and expected change.

    ``forecast`` has (key, month, value, low, high).  ``change_first_pct`` looks at the first step,
    ``change_last_pct`` at the last; the word follows the first.
    """
    w = W.partitionBy(key).orderBy(F.col("month").desc())
    past = history.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last)
    tail = history.groupBy(key).agg(F.max_by("y", "month").alias("last_value"))
    ends = forecast.groupBy(key).agg(F.min_by("value", "month").alias("_a"), F.max_by("value", "month").alias("_b"))
    base = F.col("last_value")
    ahead = forecast.join(tail, key).join(ends, key).withColumns({
        "change_first_pct": (F.col("_a") - base) / base * 100, "change_last_pct": (F.col("_b") - base) / base * 100})
    size = F.abs("change_first_pct")
    word = (F.when(size < 1, "levemente").when(size < 5, "moderadamente").when(size < 15, "significativamente").otherwise("de forma pronunciada"))
    ahead = ahead.select(key, "month", F.lit("forecast").alias("part"), "value", "low", "high",
                         F.when(F.col("value") > base, "alcista").otherwise("bajista").alias("direction"),
                         "change_first_pct", "change_last_pct", word.alias("intensity"))
    actual = past.select(key, "month", F.lit("actual").alias("part"), F.col("y").alias("value"))
    return actual.unionByName(ahead, allowMissingColumns=True)


def pipeline(df: DataFrame, kinds: Mapping[str, str] | str = "log", horizon: int = 6, key: str = "series_key", month: str = "month", value: str = "y") -> DataFrame:
    """The whole path for many series: (key, month, part, value, low, high, model, direction, changes, intensity, reading).

    Series are made regular, transformed by their kind (one for all, or by key, 'none' where not listed), fitted by
    Holt-Winters with simulated bounds and by seasonal ARIMA of greatest likelihood, and the two are averaged.  A series that
    neither can fit, being too short, say, gets the linear trend.
    """
    from paramo.operators import arima  # which builds on this module
    named = df.select(F.col(key).alias("series_key"), F.col(month).alias("month"), F.col(value).cast("double").alias("y"))
    rows = materialise(named)
    regular = materialise(regularise(rows))
    if isinstance(kinds, str):
        groups = {kinds: F.lit(True)}
    else:
        table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
        kind_of = F.coalesce(F.element_at(table, F.col("series_key")), F.lit("none"))
        groups = {k: kind_of == k for k in sorted({*kinds.values(), "none"})}
    parts = []
    for kind, mine in groups.items():
        own = regular.where(mine)
        fits = cut_lineage(holt_winters(own, kind=kind, search=True))
        bands = holt_winters_intervals(fits, horizon).select("series_key", "month", "low", "high")
        hw = holt_winters_forecast(fits, horizon).select("series_key", "month", "hw").join(bands, ["series_key", "month"])
        ar = arima.forecast(arima.fit(own, kind=kind), horizon).drop("step")
        trend = linear_trend(rows.where(mine), horizon, kind=kind).drop("step")
        parts.append(ensemble(hw, ar, trend))
    forecast = cut_lineage(reduce(DataFrame.unionByName, parts))
    shown = output(rows, forecast.drop("model")).join(forecast.select("series_key", "month", "model"), ["series_key", "month"], "left")
    up = F.col("change_last_pct") > 0
    reading = F.when(F.col("part") == "forecast", F.format_string("Se espera que %s %s %s: %+.1f%% en el primer mes y %+.1f%% al final del horizonte.",
                     F.col("series_key"), F.when(up, "suba").otherwise("baje"), F.col("intensity"), F.col("change_first_pct"), F.col("change_last_pct")))
    return shown.withColumn("reading", reading).withColumnRenamed("series_key", key)


def series_list(df: DataFrame, key: str = "series_key", config: Mapping[str, tuple] = fv.FORECAST_SERIES) -> DataFrame:
    """Per series: title, unit, transform, points and first and last month."""
    spans = df.where(F.col("y").isNotNull()).groupBy(key).agg(
        F.count("*").alias("points"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    dim = df.sparkSession.createDataFrame([(k, v[0], v[1], v[3]) for k, v in config.items()], "_k string, title string, unit string, transform string")
    out = spans.join(F.broadcast(dim), F.col(key) == F.col("_k"), "left").drop("_k")
    return out.withColumns({"title": F.coalesce("title", key), "unit": F.coalesce("unit", F.lit("")), "transform": F.coalesce("transform", F.lit("none"))})
