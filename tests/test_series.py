import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.operators import attribution as at
from paramo.operators import features as f
from paramo.operators import forecast as fc
from paramo.operators import models as mo
from paramo.operators import query as q
from paramo.operators import score as sc


def months(n, start=dt.date(2018, 1, 1)):
    return [d.date() for d in pd.date_range(start, periods=n, freq="MS")]


def frame(spark, **series):
    rows = [(k, m, None if v is None else float(v)) for k, vs in series.items() for m, v in zip(months(len(vs)), vs)]
    return spark.createDataFrame(rows, "series_key string, month date, y double")


def test_interpolation_edges_and_gaps(spark):
    df = frame(spark, a=[None, 1, None, None, 4, None], b=[None, None], c=[2])
    out = f.interpolate(df, ["y"], by=["series_key"]).orderBy("series_key", "month").collect()
    assert [r["y"] for r in out] == [1, 1, 2, 3, 4, 4, None, None, 2]


def test_regularise_needs_twelve_points(spark):
    df = frame(spark, short=range(11), long=[1, 2, None, 4, *range(5, 15)])
    out = fc.regularise(df).orderBy("month").collect()
    assert {r["series_key"] for r in out} == {"long"} and [r["y"] for r in out[:4]] == [1, 2, 3, 4]


def test_trend_of_index(spark):
    df = frame(spark, a=[0, 10, 11, None, 12]).withColumnRenamed("y", "idx_total")
    assert [r["change_pct"] for r in q.index_trend(df).orderBy("month").collect()] == [None, None, 10.0, None, None]


def test_change_reaches_over_gaps(spark):
    df = frame(spark, a=[10, None, 12, 12]).withColumnRenamed("y", "idx_total")
    assert [r["upra_var_mensual_pct"] for r in f.pct_change(df, "idx_total").orderBy("month").collect()] == [0.0, 0.0, 20.0, 0.0]


def test_min_month_guard(spark):
    normals = f.seasonal_normals(spark, "2021-01-01", "2021-12-01", fv.RAIN)
    real = spark.createDataFrame([(m, 5.0) for m in months(2)], "month date, value double")
    assert f.with_month_guard(real, normals).where("is_normal").count() == 12
    more = spark.createDataFrame([(m, 5.0) for m in months(3)], "month date, value double")
    assert f.with_month_guard(more, normals).where("NOT is_normal").count() == 3


def test_seasonal_series_is_continued(spark):
    season = [10, 12, 15, 20, 18, 14, 11, 9, 8, 12, 16, 13]
    y = [s * (1 + 0.0) for _ in range(5) for s in season]
    line = [100 + 2 * i for i in range(48)]
    df = fc.regularise(frame(spark, s=y, t=line))
    hw = {(r["series_key"], r["step"]): r["hw"] for r in fc.holt_winters_forecast(fc.holt_winters(df), 12).collect()}
    assert np.allclose([hw[("s", h)] for h in range(1, 13)], season, rtol=1e-6)
    band = fc.holt_winters_intervals(fc.holt_winters(df), 3, paths=50).collect()
    assert all(r["low"] <= r["high"] for r in band)
    # the same seasonal pattern plus a line is exact for the seasonal differences
    noisy = frame(spark, s=[a + 0.5 * i + np.random.default_rng(i).normal(0, 0.05) for i, a in enumerate(y)])
    got = fc.sarima_forecast(fc.sarima_fit(noisy), 6).orderBy("step").collect()
    want = [season[h % 12] + 0.5 * (60 + h) for h in range(6)]
    assert np.allclose([r["arima"] for r in got], want, atol=0.5)
    assert all(r["arima_low"] < r["arima"] < r["arima_high"] for r in got)
    widths = [r["arima_high"] - r["arima_low"] for r in got]
    assert widths == sorted(widths)
    trend = [r["trend"] for r in fc.linear_trend(frame(spark, t=line), 3).orderBy("step").collect()]
    assert np.allclose(trend, [196, 198, 200])


def test_short_and_negative_series_fall_back(spark):
    df = frame(spark, add=list(range(1, 16)), none=[(-1) ** i * 3.0 + i for i in range(30)])
    out = {r["series_key"]: r["mode"] for r in fc.holt_winters(df).collect()}
    assert out == {"add": "add", "none": "none"}


def test_unit_root(spark):
    rng = np.random.default_rng(11)
    noise, walk = rng.normal(size=200), np.cumsum(rng.normal(size=200))
    out = {r["series_key"]: r for r in fc.stationarity(frame(spark, noise=noise, walk=walk)).collect()}
    assert out["noise"]["stationary"] and not out["walk"]["stationary"]
    assert -2.9 < out["walk"]["critical"] < -2.86


def test_metrics_skip_null_and_zero(spark):
    df = spark.createDataFrame([(10.0, 11.0), (0.0, 5.0), (None, 1.0), (20.0, 18.0)], "a double, p double")
    r = fc.metrics(df, "a", "p").first()
    assert (r["rmse"], r["mae"], r["mape"]) == (round(2.5 ** 0.5, 4), 1.5, 10.0)
    r = fc.metrics(df.where("a = 0"), "a", "p").first()
    assert (r["rmse"], r["mae"], r["mape"]) == (0.0, 0.0, 0.0)


def scenario(spark, **over):
    row = {"id": 0, "upra_indice_total": 120.0, "upra_var_mensual_pct": 1.0, "upra_fertilizantes": 100.0, "upra_plaguicidas": 100.0,
           "ideam_precipitacion_mm": 150.0, "ideam_precipitacion_anomalia": 0.0, "ideam_temperatura_c": 22.0, "ideam_temperatura_anomalia": 0.0, "mes": 5, "anio": 2021}
    rows = [{**row, "id": i, **o} for i, o in enumerate(over.get("rows", [{}]))]
    return spark.createDataFrame(pd.DataFrame(rows))


def scores(spark, *rows):
    return [r["score"] for r in sc.score(scenario(spark, rows=list(rows)), (80, 200)).orderBy("id").collect()]


def test_score_properties(spark):
    base, peak, post, harvest, dearer = scores(spark, {}, {"anio": 2022}, {"anio": 2025}, {"mes": 10}, {"upra_indice_total": 180.0})
    assert base < post < peak and harvest == pytest.approx(base + 5.5) and dearer > base and peak == pytest.approx(base + 7)
    extreme = scores(spark, {"upra_indice_total": 1e6, "upra_var_mensual_pct": 99.0, "ideam_precipitacion_anomalia": -500.0, "ideam_temperatura_anomalia": 50.0, "mes": 10, "anio": 2023},
                     {"upra_indice_total": -1e6, "upra_var_mensual_pct": -99.0})
    assert extreme == [100.0, 0.0]


def test_constant_index_is_halfway(spark):
    df = scenario(spark, rows=[{}, {}])
    assert [r["p"] for r in sc.minmax(df, "upra_indice_total", "p").collect()] == [0.5, 0.5]


def test_labels_at_cut_points(spark):
    df = spark.createDataFrame([(24.99,), (25.0,), (41.99,), (42.0,)], "score double")
    assert [r["label"] for r in sc.labelled(df).collect()] == ["BAJA", "MEDIA", "MEDIA", "ALTA"]


def site_rows(spark, n=300):
    rng = np.random.default_rng(4)
    rows = [{"upra_indice_total": 80 + 120 * rng.random(), "upra_var_mensual_pct": rng.normal(0, 4), "ideam_precipitacion_anomalia": rng.normal(0, 90),
             "ideam_temperatura_anomalia": rng.normal(0, 1.5), "mes": int(rng.integers(1, 13)), "anio": int(rng.integers(2019, 2026))} for _ in range(n)]
    return sc.labelled(sc.score(scenario(spark, rows=rows), (80, 200), digits=None))


def test_exact_shapley_adds_up(spark):
    df = site_rows(spark, 30)
    parts = at.score_shapley(df, df, "id", (80, 200))
    total = {r["id"]: r["s"] for r in parts.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    rows = df.select("id", "score").collect()
    mean = np.mean([r["score"] for r in rows])
    assert all(np.isclose(total[r["id"]], r["score"] - mean) for r in rows)


def test_sampled_shapley_adds_up(spark):
    df = site_rows(spark, 12)
    predict = lambda d: sc.score(d, (80, 200), digits=None)
    parts = at.model_shapley(df.limit(3), df, "id", predict, "score", permutations=2)
    total = {r["id"]: r["s"] for r in parts.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    rows = {r["id"]: r["score"] for r in df.collect()}
    assert all(np.isclose(v, rows[k] - np.mean(list(rows.values()))) for k, v in total.items())


def test_split_and_folds_are_stratified(spark):
    df = site_rows(spark, 200)
    sizes = {r["class_id"]: r["n"] for r in df.groupBy("class_id").agg(F.count("*").alias("n")).collect()}
    test = {r["class_id"]: r["n"] for r in mo.stratified_split(df, "id").where("is_test").groupBy("class_id").agg(F.count("*").alias("n")).collect()}
    assert test == {k: -(-n // 5) for k, n in sizes.items()}
    per = mo.folds(df, "id", 3).groupBy("class_id", "fold").agg(F.count("*").alias("n")).toPandas()
    assert (per.groupby("class_id").n.max() - per.groupby("class_id").n.min()).max() <= 1
    assert mo.stratified_split(df.limit(10), "id").where("is_test IS NULL").count() == 10


def test_ensemble_probabilities(spark):
    df = site_rows(spark, 200)
    model = mo.fit_ensemble(df, "id", trees=10, rounds=3)
    out = model.predict(df).toPandas()
    assert np.allclose([sum(p) for p in out.proba], 1) and (out.predicted == out.class_id).mean() > 0.7


def test_permutation_importance_finds_the_driver(spark):
    df = site_rows(spark, 200).withColumn("class_id", (F.col("mes") > 6).cast("int"))
    model = mo.fit_forest(df, trees=10)
    out = at.permutation_importance(df, "id", lambda d: mo.predicted(mo.forest_proba(model, d))).orderBy(F.col("importance").desc()).first()
    assert out["feature"] == "mes" and out["importance"] > 0.2
