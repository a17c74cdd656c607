import datetime as dt

import numpy as np
import pandas as pd
import pytest

from paramo.functions.search import minimise
from paramo.operators import forecast as fc

MONTHS = [d.date() for d in pd.date_range(dt.date(2012, 1, 1), periods=140, freq="MS")]


def series(n, seed, form):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    season = 1 + 0.2 * np.sin(t * np.pi / 6)
    y = (100 + 0.5 * t + rng.normal(0, 1, n).cumsum()) * season + rng.normal(0, 2, n)
    return y - 120 if form == "none" else y


@pytest.fixture(scope="module")
def rows(spark):
    out = [(f"mul{k}", m, float(v)) for k in range(3) for m, v in zip(MONTHS, series(60 + 7 * k, k, "mul"))]
    out += [("add", m, float(v)) for m, v in zip(MONTHS, series(20, 8, "add"))] + [("none", m, float(v)) for m, v in zip(MONTHS, series(40, 9, "none"))]
    out += [("flat", m, 5.0) for m in MONTHS[:30]]
    return spark.createDataFrame(out, "series_key string, month date, y double")


def test_search_of_known_functions():
    goal = np.array([[1.0, -2.0], [0.5, 3.0], [0.0, 0.0]])

    def cost(which, u):
        d = u - goal[which][:, None, :]
        out = d[..., 0] ** 2 + 10 * (d[..., 1] - d[..., 0] ** 2) ** 2
        return np.where((which == 2)[:, None], np.nan, out)

    u, f = minimise(cost, np.zeros((3, 2)), 200)
    assert np.allclose(u[:2], goal[:2], atol=1e-3) and f[2] == np.inf and (u[2] == 0).all()
    assert minimise(cost, np.zeros((0, 2)))[0].shape == (0, 2)


def test_error_equals_that_of_the_columns_and_is_never_above_the_grid(spark, rows):
    grid = {r["series_key"]: r for r in fc.holt_winters(rows).collect()}
    found = {r["series_key"]: r for r in fc.holt_winters(rows, search=True).collect()}
    assert {r["mode"] for r in found.values()} == {"mul", "add", "none"} and found.keys() == grid.keys()
    for key, r in found.items():
        one = lambda c: np.array([r[c]])
        params = np.array([[r[c] for c in ("alpha", "beta", "gamma", "phi")]])
        error = fc.smoothing_error(np.array([r["y"]]), one("n"), one("mode"), one("l0"), one("b0"), np.array([r["s0"]]), params)[0]
        assert error == pytest.approx(r["fit"]["sse"], rel=1e-9, abs=1e-12)
        assert r["fit"]["sse"] <= grid[key]["fit"]["sse"] * (1 + 1e-12) + 1e-12
        assert (params >= fc.BOUNDS[:, 0] - 1e-12).all() and (params <= fc.BOUNDS[:, 1] + 1e-12).all()
    assert sum(found[k]["fit"]["sse"] < 0.999 * grid[k]["fit"]["sse"] for k in found) >= 3
    # no random parameters do better by more than a little
    r, rng = found["mul0"], np.random.default_rng(0)
    tries = fc.BOUNDS[:, 0] + rng.random((3000, 4)) * (fc.BOUNDS[:, 1] - fc.BOUNDS[:, 0])
    many = lambda c: np.array([r[c]] * 3000)
    assert fc.smoothing_error(many("y"), many("n"), many("mode"), many("l0"), many("b0"), many("s0"), tries).min() >= 0.98 * r["fit"]["sse"]


def test_series_of_other_lengths_do_not_matter(spark, rows):
    alone = fc.holt_winters(rows.where("series_key = 'mul0'"), search=True).first()
    beside = fc.holt_winters(rows, search=True).where("series_key = 'mul0'").first()
    assert [alone[c] for c in ("alpha", "beta", "gamma", "phi")] == pytest.approx([beside[c] for c in ("alpha", "beta", "gamma", "phi")], abs=1e-6)
    assert fc.holt_winters(rows.limit(0), search=True).count() == 0


def test_intervals_of_the_fitted_model_cover_simulated_values(spark):
    rng, data, ahead = np.random.default_rng(4), [], {}
    for k in range(40):
        level, trend, season = 100.0, 0.5, list(10 * np.sin(np.arange(12) * np.pi / 6) + 0.0)
        ys = []
        for t in range(78):
            e = rng.normal(0, 2)
            ys.append((level + 0.95 * trend) * (1 + season[t % 12] / 100) + e)
            level, trend = level + 0.95 * trend + 0.4 * e, 0.95 * trend + 0.05 * e
        data += [(f"s{k}", m, float(v)) for m, v in zip(MONTHS, ys[:72])]
        ahead.update({(f"s{k}", MONTHS[72 + j]): ys[72 + j] for j in range(6)})
    df = spark.createDataFrame(data, "series_key string, month date, y double")
    out = fc.holt_winters_intervals(fc.holt_winters(df, search=True), 6).collect()
    hit = [r["low"] <= ahead[r["series_key"], r["month"]] <= r["high"] for r in out]
    assert len(hit) == 240 and np.mean(hit) >= 0.75
