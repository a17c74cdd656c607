"""Seasonal ARIMA of many monthly series by exact Gaussian likelihood.

A series is one row holding its months, so its length is that of the calendar; the work is spread over the series and, inside a
batch of them, every step is taken for all series and all trial parameters side by side.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramo.functions.search import minimise
from paramo.operators.forecast import SEASON, inverse, series_arrays

# (rank, seasonal, which of phi, season phi, theta, season theta are estimated), tried in this order
ORDERS = [
    (1, True, (0, 1, 2, 3)),
    (2, True, (0, 1)),
    (3, True, (2, 3)),
    (4, False, (0, 2)),
]
#: Coefficients stay below this in size, so that a model is stationary and invertible.
LIMIT = 0.99
#: Series worked on side by side, and starting values of the autoregressive and moving-average parts.
SIDE_BY_SIDE, STARTS = 256, ((0.0, 0.5), (0.0, -0.6))


def polynomials(params: np.ndarray, seasonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lag weights of (1 - phi L)(1 - Phi L^12) on the past and of (1 + theta L)(1 + Theta L^12) on past shocks, (models, order)."""
    r = SEASON + 2 if seasonal else 2
    ar, ma = np.zeros((len(params), r)), np.zeros((len(params), r))
    ar[:, 0], ma[:, 1] = params[:, 0], params[:, 2]
    ma[:, 0] = 1
    if seasonal:
        ar[:, SEASON - 1], ar[:, SEASON] = params[:, 1], -params[:, 0] * params[:, 1]
        ma[:, SEASON], ma[:, SEASON + 1] = params[:, 3], params[:, 2] * params[:, 3]
    return ar, ma


def _moved(ar: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The transition applied to the second axis: every entry takes its share of the first and what stands after it."""
    out = ar.reshape(*ar.shape, *[1] * (x.ndim - 2)) * x[:, :1]
    out[:, :-1] += x[:, 1:]
    return out


def stationary(ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """Covariance of the state before anything is seen, summed by doubling."""
    r = ar.shape[1]
    step = np.zeros((len(ar), r, r))
    step[:, :, 0] = ar
    step[:, np.arange(r - 1), np.arange(1, r)] = 1
    total = ma[:, :, None] * ma[:, None, :]
    for _ in range(18):  # at LIMIT a season's weight is below 1e-50 after 2^18 months
        total = total + step @ total @ step.transpose(0, 2, 1)
        step = step @ step
        if np.abs(step).max(initial=0) < 1e-12:
            break
    return total


def kalman(w: np.ndarray, n: np.ndarray, params: np.ndarray, seasonal: bool):
    """(log likelihood, variance of the shocks, next state, its covariance in units of that variance) of each row of ``w``.

    A row has ``n`` values, then anything; the variance is the one that makes its values likeliest.  Where all values are 0
    the variance is 0 and the likelihood infinite.
    """
    ar, ma = polynomials(params, seasonal)
    noise = ma[:, :, None] * ma[:, None, :]
    cover, state = stationary(ar, ma), np.zeros_like(ar)
    squares, logs = np.zeros(len(w)), np.zeros(len(w))
    for t in range(int(n.max(initial=0))):
        live = t < n
        spread = cover[:, 0, 0]
        miss = w[:, t] - state[:, 0]
        squares += np.where(live, miss * miss / spread, 0)
        logs += np.where(live, np.log(spread), 0)
        ahead = _moved(ar, cover)  # transition x covariance
        gain = ahead[:, :, 0] / spread[:, None]
        next_state = _moved(ar, state) + gain * miss[:, None]
        next_cover = _moved(ar, ahead.transpose(0, 2, 1)) + noise - gain[:, :, None] * gain[:, None, :] * spread[:, None, None]
        state = np.where(live[:, None], next_state, state)
        cover = np.where(live[:, None, None], next_cover, cover)
    variance = squares / np.maximum(n, 1)
    with np.errstate(divide="ignore"):
        likelihood = -0.5 * (n * (np.log(2 * np.pi * variance) + 1) + logs)
    return likelihood, variance, state, cover


def estimate(w: np.ndarray, n: np.ndarray, free: tuple[int, ...], seasonal: bool) -> np.ndarray:
    """The likeliest parameters of each row, those not ``free`` being 0.

    A search from the best of all STARTS, in the hyperbolic tangent of the parameters; the likelihood is never below that of any start.
    """
    p, s = len(free), len(w)

    def given(u: np.ndarray) -> np.ndarray:
        out = np.zeros((len(u), 4))
        out[:, list(free)] = LIMIT * np.tanh(u)
        return out

    def cost(rows: np.ndarray, u: np.ndarray) -> np.ndarray:
        """(rows, trials) of ``u`` (rows, trials, p)."""
        at = np.repeat(rows, u.shape[1])
        found = kalman(w[at], n[at], given(u.reshape(-1, p)), seasonal)[0]
        return (-found / np.maximum(n[at], 1)).reshape(u.shape[:2])

    grid = np.arctanh(np.array(list(itertools.product(*[STARTS[0] if k < 2 else STARTS[1] for k in free]))) / LIMIT)
    first = cost(np.arange(s), np.broadcast_to(grid, (s, *grid.shape)))
    u, f = minimise(cost, grid[first.argmin(axis=1)])
    out = given(u)
    out[~np.isfinite(f)] = 0
    return out


def differenced(y: np.ndarray, seasonal: bool) -> np.ndarray:
    d = np.diff(y)
    return d[SEASON:] - d[:-SEASON] if seasonal else d


def _batch(series: list[np.ndarray], seasonal: bool, free: tuple[int, ...]) -> list[dict]:
    n = np.array([len(x) for x in series])
    w = np.zeros((len(series), n.max(initial=1)))
    for k, x in enumerate(series):
        w[k, :len(x)] = x
    params = estimate(w, n, free, seasonal)
    likelihood, variance, state, cover = kalman(w, n, params, seasonal)
    fits = []
    for k in range(len(series)):
        known = np.isfinite(likelihood[k])
        fits.append({"params": params[k].tolist(), "sigma": float(np.sqrt(variance[k])), "loglik": float(likelihood[k]) if known else None,
                     "aic": float(2 * (len(free) + 1) - 2 * likelihood[k]) if known else None, "state": state[k].tolist(), "cover": cover[k].ravel().tolist()})
    return fits


FIT = ("rank int, seasonal boolean, params array<double>, sigma double, loglik double, aic double, state array<double>, cover array<double>, "
       "tail array<double>, n int, last_month date, kind string")


def fit(df: DataFrame, key: str = "series_key", kind: str = "none", choose: str = "first") -> DataFrame:
    """One row per series (regular months): order, parameters, deviation of the shocks, likelihood, AIC, and what a forecast starts from.

    The differenced series is a multiplicative seasonal ARMA process in state-space form; its parameters maximise the exact
    likelihood by a Kalman filter.  ``choose`` takes the 'first' order that the series is long enough for (twice its
    parameters and one value more, after differencing), or by 'aic' the best of those that are differenced alike.  A series
    too short for all gives no row; one without any change has deviation 0 and no likelihood.
    """
    if choose not in ("first", "aic"):
        raise ValueError("choose is 'first' or 'aic'")
    kinds = dict(df.dtypes)
    rows = series_arrays(df, key, kind).select(F.col(key).alias("_key"), "y", "last_month", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), SIDE_BY_SIDE):
                part = pdf.iloc[at:at + SIDE_BY_SIDE]
                best: dict[int, dict] = {}
                levels = [np.asarray(y, float) for y in part["y"]]
                for rank, seasonal, free in ORDERS:
                    changes = {k: differenced(y, seasonal) for k, y in enumerate(levels)
                               if (k not in best or (choose == "aic" and best[k]["seasonal"] == seasonal))}
                    changes = {k: x for k, x in changes.items() if len(x) >= 2 * len(free) + 1}
                    for k, found in zip(changes, _batch(list(changes.values()), seasonal, free) if changes else []):
                        if k not in best or (found["aic"] is not None and found["aic"] < (best[k]["aic"] or np.inf)):
                            best[k] = {"rank": rank, "seasonal": seasonal, **found, "tail": levels[k][-SEASON - 1:].tolist(), "n": len(levels[k])}
                out = pd.DataFrame([{"_key": part["_key"].iloc[k], **best[k], "last_month": part["last_month"].iloc[k], "kind": part["kind"].iloc[k]} for k in sorted(best)])
                if len(out):
                    yield out

    return rows.mapInPandas(run, f"_key {kinds[key]}, {FIT}").withColumnRenamed("_key", key)


def ahead(fit_: dict, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, deviation) of the coming values of one series on its transformed scale."""
    seasonal, r = bool(fit_["seasonal"]), len(fit_["state"])
    ar, ma = polynomials(np.array([fit_["params"]], float), seasonal)
    state = np.array([fit_["state"]], float)
    now = np.array(fit_["cover"], float).reshape(1, r, r)
    # rows[i]: how the i-th change ahead depends on the state and, by ma, on the shocks between
    carried = np.eye(r)[None]
    rows, means, level = [], [], list(map(float, fit_["tail"]))
    for _ in range(horizon):
        rows.append(carried[0, 0])
        means.append(state[0, 0])
        state, carried = _moved(ar, state), _moved(ar, carried)
    weights = np.array(rows)
    psi = weights @ ma[0]
    shared = weights @ now[0] @ weights.T
    for i in range(horizon):
        for j in range(horizon):
            shared[i, j] += sum(psi[i - k] * psi[j - k] for k in range(1, min(i, j) + 1))
    summing = np.zeros(horizon)
    total = []
    for h in range(horizon):
        step = means[h] + level[-1] + (level[-SEASON] - level[-SEASON - 1] if seasonal else 0)
        summing[h] = (1 if h == 0 else summing[h - 1]) + (summing[h - SEASON] - (summing[h - SEASON - 1] if h > SEASON else 0) if seasonal and h >= SEASON else 0)
        level.append(step)
        total.append(step)
    sums = np.array([[summing[i - j] if i >= j else 0.0 for j in range(horizon)] for i in range(horizon)])
    return np.array(total), fit_["sigma"] * np.sqrt(np.maximum(np.diag(sums @ shared @ sums.T), 0))


def forecast(fits: DataFrame, horizon: int = 6, key: str = "series_key", z: float = 1.959963984540054) -> DataFrame:
    """(key, month, step, arima, arima_low, arima_high); the deviations are those of the filter's forecast."""
    kinds = dict(fits.dtypes)
    held = fits.select(F.col(key).alias("_key"), "seasonal", "params", "sigma", "state", "cover", "tail", "last_month", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [ahead(r, horizon) for r in pdf.to_dict("records")]
            yield pdf[["_key", "last_month", "kind"]].assign(mean=[m.tolist() for m, _ in found], spread=[s.tolist() for _, s in found])

    out = held.mapInPandas(run, f"_key {kinds[key]}, last_month date, kind string, mean array<double>, spread array<double>")
    out = out.select("_key", "last_month", "kind", F.posexplode(F.arrays_zip("mean", "spread")).alias("_i", "_v"))

    def shown(value: Column) -> Column:
        return inverse(value, F.col("kind"))

    mean, wide = F.col("_v")["mean"], F.col("_v")["spread"] * z
    return out.select(F.col("_key").alias(key), F.add_months("last_month", F.col("_i") + 1).alias("month"), (F.col("_i") + 1).alias("step"),
                      shown(mean).alias("arima"), shown(mean - wide).alias("arima_low"), shown(mean + wide).alias("arima_high"))
