"""Distributed ranks, quantiles, neighbours, density clusters and factors against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paramo.functions import neighbours as nb
from paramo.functions import ranks
from paramo.functions.linear import least_squares
from paramo.operators import anomaly as an
from paramo.operators import cluster as cl
from paramo.operators import evaluate as ev


def skewed(n=3000, seed=1):
    """Values of which a third are equal, in two groups of very different size."""
    rng = np.random.default_rng(seed)
    v = np.where(rng.random(n) < 0.34, 5.0, np.round(rng.normal(0, 10, n), 2))
    return pd.DataFrame({"g": np.where(rng.random(n) < 0.95, "a", "b"), "v": v})


def test_running_totals_and_quantiles(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    out = ranks.running_totals(df, "v", {"n": F.lit(1)}, ["g"]).toPandas()
    for g, part in pdf.groupby("g"):
        mine = out[out.g == g].sort_values("v")
        counts = part.v.value_counts().sort_index()
        assert mine.n.tolist() == counts.tolist()
        assert mine.n_before.tolist() == (counts.cumsum() - counts).tolist() and set(mine.n_total) == {len(part)}
    q = ranks.exact_quantiles(df, "v", {"lo": 0.05, "mid": 0.5, "hi": 0.95}, ["g"]).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(q.loc[g, ["lo", "mid", "hi"]].astype(float), part.v.quantile([0.05, 0.5, 0.95]))


def test_hash_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("c", F.col("id") % 3)
    a = ranks.hash_ranks(df.repartition(1), ["id"], 7, ["c"]).select("id", "draw_rank").toPandas().sort_values("id")
    b = ranks.hash_ranks(df.repartition(4), ["id"], 7, ["c"]).select("id", "draw_rank").toPandas().sort_values("id")
    assert a.draw_rank.tolist() == b.draw_rank.tolist()
    assert sorted(a.draw_rank)[:3] == [0, 0, 0]


def test_least_squares(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": 1, "one": 1.0, "x": rng.normal(size=200), "zero": 0.0})
    pdf["y"] = 2 + 3 * pdf.x + rng.normal(size=200) * 0.1
    r = least_squares(spark.createDataFrame(pdf), ["g"], ["one", "x", "zero"], "y").first()
    want = np.linalg.lstsq(pdf[["one", "x"]], pdf.y, rcond=None)[0]
    assert np.allclose(r["beta"], [*want, 0.0]) and r["n"] == 200


def points(kind, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "hot":  # a third equal, a third within eps of one another, the rest spread out
        x = np.vstack([np.zeros((150, 2)), rng.normal(3, 0.01, (150, 2)), rng.uniform(-8, 8, (150, 2))])
    else:
        x = np.vstack([rng.normal(0, 0.5, (200, 3)), rng.normal(4, 0.3, (150, 3)), rng.uniform(-6, 9, (40, 3)), [[30, 30, 30]]])
    return x


def brute_dbscan(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = d <= eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    count = 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        todo = [i]
        label[i] = count
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & core):
                if label[j] < 0:
                    label[j] = count
                    todo.append(j)
        count += 1
    for i in np.flatnonzero(~core):
        if (near[i] & core).any():
            label[i] = label[near[i] & core].min()
    return label, core


@pytest.mark.parametrize("kind,eps,size", [("hot", 0.6, 16), ("hot", 0.6, 500), ("mixed", 0.7, 32), ("hot", 0.02, 16)])
def test_dbscan_against_brute_force(spark, kind, eps, size):
    x = points(kind)
    cols = [f"c{j}" for j in range(x.shape[1])]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=range(len(x))))
    got = cl.dbscan(df, "id", cols, eps, 3, size=size, scale=False).toPandas().sort_values("id")
    label, core = brute_dbscan(x, eps, 3)
    assert got.is_core.tolist() == core.tolist()
    assert got.cluster.tolist() == label.tolist()
    s = cl.outlier_summary(spark.createDataFrame(got)).first()
    assert s["outliers"] == (label == -1).sum() and s["clusters"] == label.max() + 1


def brute_lof(x, k, contamination):
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))

    def nearest(m):
        order = np.argsort(m, axis=1, kind="stable")[:, :k]
        return order, np.take_along_axis(m, order, 1)

    other = d.copy()
    np.fill_diagonal(other, np.inf)
    idx, dist = nearest(other)
    kd = dist[:, -1]
    lrd = 1 / (np.maximum(dist, kd[idx]).mean(1) + 1e-10)
    trained = -(lrd[idx].mean(1) / lrd)
    # each row counts as a new point: it finds itself first
    own = np.arange(len(x))[:, None]
    idx2, dist2 = np.hstack([own, idx[:, :k - 1]]), np.hstack([np.zeros((len(x), 1)), dist[:, :k - 1]])
    lrd2 = 1 / (np.maximum(dist2, kd[idx2]).mean(1) + 1e-10)
    lof = lrd[idx2].mean(1) / lrd2
    return lof, -lof < np.quantile(trained, contamination)


@pytest.mark.parametrize("size", [25, 1000])
def test_lof_against_brute_force(spark, size):
    x = points("mixed")
    cols = ["c0", "c1", "c2"]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=range(len(x))))
    got = an.local_outlier_factor(df, "id", cols, 10, size=size).toPandas().sort_values("id")
    lof, flag = brute_lof(x, 10, 0.1)
    assert np.allclose(got.lof, lof, rtol=1e-9) and got.lof_outlier.tolist() == flag.tolist()
    assert got.lof.idxmax() == got.index[-1] or got.lof.max() == got.lof.iloc[-1]


def test_lof_with_many_copies(spark):
    x = points("hot")
    df = spark.createDataFrame(pd.DataFrame(x, columns=["c0", "c1"]).assign(id=range(len(x))))
    got = an.local_outlier_factor(df, "id", ["c0", "c1"], 20, size=64).toPandas().sort_values("id")
    lof, _ = brute_lof(x, 20, 0.1)
    assert len(got) == len(x) and np.allclose(got.lof[:150], 1.0)
    far = np.arange(300, 450)
    assert np.allclose(got.lof.to_numpy()[far], lof[far], rtol=1e-6)


def test_nearest_asks_few_blocks(spark):
    # months that share two of the features, as in the site months: boxes that are not tight ask for nearly all others
    rng = np.random.default_rng(3)
    climate = rng.normal(0, 1, (40, 2))[rng.integers(0, 40, 8000)]
    x = np.hstack([rng.normal(0, 1, (8000, 3)), climate, climate])
    cols = [f"c{j}" for j in range(7)]
    df = nb.distinct_points(spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=range(8000))), cols, "id")
    pts, near = nb.nearest(df, 7, 10, size=64)
    p = pts.select("uid", "v", "block", F.size("asks").alias("asks")).toPandas()
    v = np.stack(p.v.to_numpy())
    assert p.block.value_counts().max() < 4 * 64 and p.asks.sum() < 0.25 * len(p) * p.block.nunique()
    some = p.uid[:50].tolist()
    found = near.where(F.col("uid").isin(some)).toPandas()
    for i, uid in enumerate(some):
        d = np.sort(nb.distances(v[[i]], v)[0])[1:11]
        assert np.array_equal(np.sort(found[found.uid == uid].dist), d)


def test_isolation_forest(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (300, 3)), [[15, 15, 15]]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(301)))
    runs = []
    for parts in (1, 4):
        model = an.fit_isolation_forest(df.repartition(parts), "id", ["a", "b", "c"])
        runs.append(model.detect(df).toPandas().sort_values("id"))
    assert np.allclose(runs[0].if_score, runs[1].if_score)
    s = runs[0]
    assert ((s.if_score < 0) & (s.if_score >= -1)).all() and s.if_score.idxmin() == s.index[-1] and bool(s.if_outlier.iloc[-1])
    assert 0.05 < s.if_outlier.mean() < 0.15


def test_silhouette_and_friends(spark):
    x = points("mixed")
    cols = ["c0", "c1", "c2"]
    c = np.r_[np.zeros(200), np.ones(150), np.full(41, 2)].astype(int)
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(cluster=c))
    got = cl.quality(df, cols, size=64).first()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    widths = []
    for i in range(len(x)):
        a = d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(d[i, c == o].mean() for o in set(c) - {c[i]})
        widths.append((b - a) / max(a, b))
    assert np.isclose(got["silhouette"], np.mean(widths))
    centre = np.array([x[c == k].mean(0) for k in range(3)])
    within = sum(((x[c == k] - centre[k]) ** 2).sum() for k in range(3))
    between = sum((c == k).sum() * ((centre[k] - x.mean(0)) ** 2).sum() for k in range(3))
    assert np.isclose(got["calinski_harabasz"], between / 2 / (within / (len(x) - 3)))


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("d", "e"), ("z", "c"), *[(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]]
    out = {r["node"]: r["component"] for r in nb.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {out[k] for k in "abcz"} == {"a"} and {out[k] for k in "de"} == {"d"} and {v for k, v in out.items() if k[0] == "n"} == {"n000"}


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.1), (0, 0.2), (1, 0.9), (1, 0.2)], "actual int, s double")
    out = {r["name"]: r["auc"] for r in ev.auc_one_vs_rest(df.withColumn("r", -F.col("s")), {0: "r", 1: "s"}).collect()}
    assert np.isclose(out["MEDIA"], (0.5 + 0 + 1 + 1 + 1 + 0.5) / 6) and np.isclose(out["BAJA"], out["MEDIA"])


def test_report_leaves_out_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2)], "actual int, predicted int")
    out = {r["name"]: r for r in ev.class_report(ev.confusion(df)).collect()}
    assert set(out) == {"BAJA", "MEDIA", "macro", "weighted", "accuracy"}
    assert np.isclose(out["BAJA"]["f1"], 2 / 3) and np.isclose(out["MEDIA"]["precision"], 0.5) and out["accuracy"]["f1"] == 0.5


def test_severity_and_kind_at_thresholds(spark):
    rows = [(2.0, -2.0, 0.0, 2.0), (1.99, 0.0, 2.0, 2.5), (-2.0, 0.0, 0.0, 3.0), (0.0, -2.0, 0.0, 2.49), (0.0, 0.0, 0.0, 0.1)]
    df = spark.createDataFrame(rows, "z_upra_var_mensual_pct double, z_ideam_precipitacion_anomalia double, z_ideam_temperatura_anomalia double, max_z double")
    got = [(r["kind"], r["severity"]) for r in an.classified(df).collect()]
    assert got == [("riesgo_compuesto", "MODERADA"), ("ola_calor", "ALTA"), ("precio_minimo", "CRÍTICA"), ("sequia_extrema", "MODERADA"), ("anomalia_multivariada", "MODERADA")]
