import datetime as dt

import numpy as np
import pandas as pd
import pytest

from paramo.operators import arima
from paramo.operators import forecast as fc

MONTHS = [d.date() for d in pd.date_range(dt.date(2010, 1, 1), periods=240, freq="MS")]


def weights(params, seasonal, n):
    """Shock weights of the process, term by term."""
    ar, ma = arima.polynomials(np.array([params]), seasonal)
    ar, ma = ar[0], ma[0]
    psi = np.zeros(n)
    for j in range(n):
        psi[j] = (ma[j] if j < len(ma) else 0) + sum(ar[i] * psi[j - 1 - i] for i in range(min(len(ar), j)))
    return psi


def covariance(params, seasonal, n):
    psi = weights(params, seasonal, 3000)
    gamma = np.array([psi[:len(psi) - k] @ psi[k:] for k in range(n)])
    return gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]


def density(w, params, seasonal):
    """Log density of a normal vector at the variance that makes it likeliest."""
    c = covariance(params, seasonal, len(w))
    variance = w @ np.linalg.solve(c, w) / len(w)
    return -0.5 * (len(w) * np.log(2 * np.pi * variance) + np.linalg.slogdet(c)[1] + len(w))


def simulated(params, seasonal, n, seed):
    rng = np.random.default_rng(seed)
    w = np.convolve(rng.normal(0, 1, n + 600), weights(params, seasonal, 600))[600:600 + n]
    y = np.cumsum(w)
    if seasonal:
        y = np.zeros(n + 13)
        for t in range(13, n + 13):
            y[t] = w[t - 13] + y[t - 1] + y[t - 12] - y[t - 13]
    return y


SETS = [((0.5, 0.3, -0.4, -0.5), True), ((-0.6, 0.6, 0.3, 0.2), True), ((0.7, 0, -0.2, 0), False)]


@pytest.mark.parametrize("params, seasonal", SETS)
def test_likelihood_against_the_dense_density(params, seasonal):
    rng = np.random.default_rng(0)
    series = [rng.normal(0, 3, n) for n in (5, 30, 70)]
    w = np.zeros((3, 70))
    for k, x in enumerate(series):
        w[k, :len(x)] = x
        w[k, len(x):] = 1e6  # never looked at
    got = arima.kalman(w, np.array([5, 30, 70]), np.tile(params, (3, 1)), seasonal)[0]
    assert np.allclose(got, [density(x, params, seasonal) for x in series], atol=1e-6)


@pytest.mark.parametrize("params, seasonal", SETS)
def test_forecast_against_the_conditional_distribution(params, seasonal):
    n, h = 60, 16
    y = simulated(params, seasonal, n, 3)
    w = arima.differenced(y, seasonal)
    _, variance, state, cover = arima.kalman(w[None], np.array([len(w)]), np.array([params]), seasonal)
    mean, wide = arima.ahead({"seasonal": seasonal, "params": params, "sigma": np.sqrt(variance[0]), "state": state[0], "cover": cover[0].ravel(),
                              "tail": y[-13:]}, h)
    c = covariance(params, seasonal, len(w) + h) * variance[0]
    past, cross = c[:len(w), :len(w)], c[len(w):, :len(w)]
    changes = cross @ np.linalg.solve(past, w)
    spread = c[len(w):, len(w):] - cross @ np.linalg.solve(past, cross.T)
    # levels are linear in the changes: add a unit to each in turn
    def levels(d):
        out = list(y)
        for x in d:
            out.append(x + out[-1] + (out[-12] - out[-13] if seasonal else 0))
        return np.array(out[len(y):])

    unit = np.stack([levels(np.eye(h)[j]) - levels(np.zeros(h)) for j in range(h)], axis=1)
    assert np.allclose(mean, levels(changes), atol=1e-6)
    assert np.allclose(wide, np.sqrt(np.diag(unit @ spread @ unit.T)), rtol=1e-6)


def test_search_beats_every_start_and_the_two_stage_estimates(spark):
    truth = [(0.5, 0.3, -0.4, -0.5), (0.0, 0.0, -0.6, -0.6), (0.8, -0.3, 0.2, 0.3)]
    rows, ys = [], {}
    for k, params in enumerate(truth):
        y = ys[f"s{k}"] = simulated(params, True, 170, k)
        rows += [(f"s{k}", m, float(v)) for m, v in zip(MONTHS, y)]
    df = spark.createDataFrame(rows, "series_key string, month date, y double")
    found = {r["series_key"]: r for r in arima.fit(df).collect()}
    stage = {r["series_key"]: r for r in fc.sarima_fit(df).collect()}
    for key, y in ys.items():
        w, got = arima.differenced(y, True), found[key]
        assert got["rank"] == 1 and got["loglik"] == pytest.approx(density(w, got["params"], True), abs=1e-4)
        ar, ma = stage[key]["ar"], stage[key]["ma"]
        start = np.clip([ar[0], ar[1], ma[0], ma[1]], -0.98, 0.98)
        at_start, at_truth = (arima.kalman(w[None], np.array([len(w)]), np.array([p]), True)[0][0] for p in (start, truth[int(key[1])]))
        assert got["loglik"] >= max(at_start, at_truth) - 1e-9
        # no neighbour is likelier
        for j in range(4):
            for d in (-0.01, 0.01):
                near = np.array(got["params"])
                near[j] = np.clip(near[j] + d, -0.99, 0.99)
                assert arima.kalman(w[None], np.array([len(w)]), near[None], True)[0][0] <= got["loglik"] + 1e-6
    assert np.allclose(found["s0"]["params"], truth[0], atol=0.4)


def test_orders_lengths_constant_and_empty(spark):
    rng = np.random.default_rng(5)
    rows = [(f"n{n}", m, float(v)) for n in (3, 6, 18, 22, 60) for m, v in zip(MONTHS, rng.normal(10, 1, n))]
    rows += [("flat", m, 4.0) for m in MONTHS[:40]] + [(None, m, float(v)) for m, v in zip(MONTHS, rng.normal(10, 1, 30))]
    df = spark.createDataFrame(rows, "series_key string, month date, y double")
    fits = {r["series_key"]: r for r in arima.fit(df).collect()}
    assert {k: r["rank"] for k, r in fits.items()} == {"n6": 4, "n18": 2, "n22": 1, "n60": 1, "flat": 1, None: 1}
    assert fits["flat"]["sigma"] == 0 and fits["flat"]["loglik"] is None
    out = arima.forecast(arima.fit(df, choose="aic"), 3).toPandas()
    assert len(out) == 18 and np.allclose(out[out.series_key == "flat"][["arima", "arima_low", "arima_high"]], 4.0)
    assert (out.arima_low <= out.arima + 1e-9).all() and (out.arima <= out.arima_high + 1e-9).all()
    best = {r["series_key"]: r for r in arima.fit(df, choose="aic").collect()}
    assert all(best[k]["aic"] <= fits[k]["aic"] for k in fits if fits[k]["aic"] is not None)
    assert arima.forecast(arima.fit(df.limit(0)), 3).count() == 0
    with pytest.raises(ValueError, match="choose"):
        arima.fit(df, choose="all")


def test_intervals_cover_simulated_values(spark):
    rows, ahead, names = [], {}, []
    for k in range(60):
        y = 50 + simulated((0.4, 0.0, -0.3, -0.5), True, 107, 100 + k)
        rows += [(f"s{k:02d}", m, float(v)) for m, v in zip(MONTHS, y[:114])]
        ahead.update({(f"s{k:02d}", MONTHS[114 + j]): y[114 + j] for j in range(6)})
    df = spark.createDataFrame(rows, "series_key string, month date, y double")
    out = arima.forecast(arima.fit(df), 6).collect()
    hit = [r["arima_low"] <= ahead[r["series_key"], r["month"]] <= r["arima_high"] for r in out]
    assert len(hit) == 360 and 0.85 <= np.mean(hit) <= 0.99
