import datetime as dt
from itertools import product
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paramo.functions import ranks
from paramo.operators import anomaly as an
from paramo.operators import attribution as at
from paramo.operators import cluster as cl
from paramo.operators import forecast as fc
from paramo.operators import models as mo
from paramo.operators import score as sc
from paramo.operators import tree_attribution as ta

COLUMNS = "id int, upra_indice_total double, upra_var_mensual_pct double, ideam_precipitacion_anomalia double, ideam_temperatura_anomalia double, mes int, anio int"


def score_rows(n, low, high, seed):
    rng = np.random.default_rng(seed)
    return [(i, float(rng.uniform(low, high)), float(rng.uniform(-8, 14)), float(rng.uniform(-200, 300)), float(rng.uniform(-1, 4)),
             int(rng.integers(1, 13)), int(rng.integers(2018, 2026))) for i in range(n)]


def test_score_attribution_against_all_hybrids(spark):
    # the index leaves its bounds, so that the limits of the score cut
    rows, background = score_rows(5, 20, 600, 0), score_rows(25, 20, 600, 1)
    got = {(r["id"], r["feature"]): r["contribution"] for r in at.score_shapley(
        spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(background, COLUMNS), "id", (80.0, 200.0)).collect()}
    groups = [[1, 2], [3], [4], [5, 6]]
    hybrids = []
    for r, b, m in product(range(5), range(25), range(16)):
        x = list(background[b])
        for j, cells in enumerate(groups):
            for c in cells:
                x[c] = rows[r][c] if m >> j & 1 else x[c]
        hybrids.append((r * 1000 + b * 20 + m, *x[1:]))
    value = {r["id"]: r["score"] for r in sc.score(spark.createDataFrame(hybrids, COLUMNS), (80.0, 200.0), digits=None).collect()}
    assert min(value.values()) == 0 and max(value.values()) == 100
    for r in range(5):
        mean = [np.mean([value[r * 1000 + b * 20 + m] for b in range(25)]) for m in range(16)]
        for j, name in enumerate(at.GROUPS):
            want = sum((mean[m | 1 << j] - mean[m]) * factorial(m.bit_count()) * factorial(3 - m.bit_count()) / 24 for m in range(16) if not m >> j & 1)
            assert got[r, name] == pytest.approx(want, abs=1e-9)


def test_score_attribution_of_many_rows_does_not_depend_on_order(spark):
    df = spark.createDataFrame(score_rows(300, 20, 600, 2), COLUMNS)
    one, other = (at.score_shapley(df, b, "id", (80.0, 200.0)).orderBy("id", "feature").toPandas() for b in (df, df.orderBy(F.col("id").desc())))
    assert np.allclose(one.contribution, other.contribution)
    total = one.groupby("id").contribution.sum()
    scores = sc.score(df, (80.0, 200.0), digits=None).toPandas().set_index("id").score
    assert np.allclose(total, scores[total.index] - scores.mean())


def test_weighted_background_counts_like_rows(spark):
    df = spark.createDataFrame(score_rows(8, 80, 200, 3), COLUMNS)
    twice = df.limit(1).withColumn("weight", F.lit(2.0)).unionByName(df.where("id > 5").withColumn("weight", F.lit(1.0)))
    plain = df.limit(1).unionByName(df.limit(1)).unionByName(df.where("id > 5"))
    names = [c for cs in at.GROUPS.values() for c in cs]
    predict = lambda d: sc.score(d, (80, 200), digits=None)
    a, b = (at.model_shapley(df, x, "id", predict, "score", names, permutations=2).orderBy("id", "feature").toPandas() for x in (twice, plain))
    assert np.allclose(a.contribution, b.contribution)


def test_training_is_refused_without_rows_or_classes(spark):
    few = spark.createDataFrame([(i, i % 2) for i in range(9)], "mes int, class_id int")
    with pytest.raises(ValueError, match="10 rows"):
        mo.fit_forest(few, ["mes"], trees=2)
    with pytest.raises(ValueError, match="two classes"):
        mo.fit_forest(spark.createDataFrame([(i, 1) for i in range(20)], "mes int, class_id int"), ["mes"], trees=2)
    with pytest.raises(ValueError, match="must be one of"):
        mo.fit_boosting(spark.createDataFrame([(i, i) for i in range(20)], "mes int, class_id int"), ["mes"], rounds=2)


def test_equal_draws_have_ranks_of_their_own(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    assert sorted(r["draw_rank"] for r in ranks.hash_ranks(df, ["k"], 5).collect()) == [0, 1, 2, 3]


def test_forecast_path(spark):
    months = [d.date() for d in pd.date_range(dt.date(2018, 1, 1), periods=60, freq="MS")]
    rows = [("long", m, float(100 + i + 10 * np.sin(i / 6 * np.pi))) for i, m in enumerate(months)] + [("short", m, 5.0 + i) for i, m in enumerate(months[:6])]
    out = fc.pipeline(spark.createDataFrame(rows, "series_key string, month date, y double"), {"long": "log"}).toPandas()
    ahead = out[out.part == "forecast"]
    assert set(ahead.series_key) == {"long", "short"} and set(ahead[ahead.series_key == "short"].model) == {"trend"}
    assert (ahead.low <= ahead.value + 1e-9).all() and (ahead.value <= ahead.high + 1e-9).all() and ahead.reading.str.contains("Se espera").all()


def test_anomaly_and_cluster_paths(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *[float(x) for x in rng.normal(0, 1, 8)]) for i in range(120)] + [(120, *[9.0] * 8)]
    from paramo import fixed_values as fv
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in fv.MEASURES))
    found = an.ranked(an.detected(df, "id"), "id", None).collect()
    assert found[0]["id"] == 120 and found[0]["kind"] == "riesgo_compuesto" and "a la vez" in found[0]["description"]
    new, named, quality = cl.periods(df.where("id < 100"), df.where("id >= 100"), "id", 3, starts=2, max_iter=20)
    assert new.count() == 21 and new.where("profile IS NULL").count() == 0 and named.count() == 3 and quality.count() == 1


@pytest.mark.parametrize("name", ["ml_calibrate", "ml_evaluate_ensemble"])
def test_registered_ensembles_fit_at_the_defaults(name, monkeypatch):
    from paramo.plans import learning
    asked = {}

    def fit_ensemble(df, key, **how):
        asked.update(how)
        raise InterruptedError

    monkeypatch.setattr(learning, "split", lambda i: (None, None))
    monkeypatch.setattr(learning.mo, "fit_ensemble", fit_ensemble)
    with pytest.raises(InterruptedError):
        getattr(learning, name)(None)
    assert asked == {}


def test_model_attribution_agrees_with_sampled_orders(spark):
    # two features: two orders are all there are, so sampling is exact where both are drawn
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, (80, 2)).astype(float)
    df = spark.createDataFrame([(i, *r, int(r[0] + r[1] > 4)) for i, r in enumerate(x.tolist())], "id int, a double, b double, class_id int")
    model = mo.fit_forest(df, ["a", "b"], trees=5)
    high = lambda d: mo.forest_proba(model, d).withColumn("_p", F.col("proba")[1])
    rows = df.where("id < 6")
    orders = [at.model_shapley(rows, df, "id", high, "_p", ["a", "b"], permutations=1, seed=s).toPandas() for s in range(6)]
    exact = ta.tree_shapley(rows, df, "id", model, 1).toPandas().sort_values(["id", "feature"]).contribution.to_numpy()
    seen = [o.sort_values(["id", "feature"]).contribution.to_numpy() for o in orders]
    first = seen[0]
    other = next(o for o in seen if not np.allclose(o, first))
    assert np.allclose((first + other) / 2, exact, atol=1e-9)
