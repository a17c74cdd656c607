import numpy as np
import pytest
from pyspark.sql import functions as F

from paramo.operators import boosting as b
from paramo.operators import forest as f
from paramo.operators import models as mo
from tests.test_boosting import COLUMNS, table


def gini_gain(y, w, left):
    def worth(rows):
        sums = np.array([w[rows & (y == c)].sum() for c in range(3)])
        return (sums ** 2).sum() / sums.sum() if sums.sum() else 0.0
    return worth(left) + worth(~left) - worth(np.ones(len(y), bool))


def test_every_split_is_the_best_of_the_drawn_features(spark):
    df, s = table(spark), f.Settings(trees=8, depth=4, features=2)
    model = f.fit(df, COLUMNS, [0, 1, 2], settings=s, key="id")[0]
    data = df.select(*[F.coalesce(c, F.lit(0.0)) for c in COLUMNS], "class_id", F.xxhash64("id")).collect()
    x, y = np.array([r[:3] for r in data]), np.array([r[3] for r in data])
    keys = np.array([r[4] for r in data], np.int64).view(np.uint64)
    balance = len(y) / (3 * np.bincount(y))
    seen = 0
    for t in range(s.trees):
        times = f.bagged(keys, t, s)
        assert abs(times.mean() - 1) < 0.2
        nodes = [np.zeros(len(x), np.int64)] + [b.leaves(b.coded(x, model.edges), model.feature[t], model.code[t], k) for k in range(1, s.depth + 1)]
        for level in range(s.depth):
            for slot in range(1 << level):
                node = (1 << level) - 1 + slot
                rows = np.nonzero((nodes[level] == node) & (times > 0))[0]
                if not len(rows):
                    continue
                w = times[rows] * balance[y[rows]]
                assert model.share[t, node] == pytest.approx([w[y[rows] == c].sum() / w.sum() for c in range(3)])
                gains = {}
                for k in f.drawn_features(t, level, 3, s)[slot]:
                    for v in np.unique(x[rows, k])[1:]:
                        left = x[rows, k] < v
                        if min(times[rows][left].sum(), times[rows][~left].sum()) >= s.least_rows:
                            gains[k, v] = gini_gain(y[rows], w, left)
                best = max(gains.values(), default=0)
                if model.feature[t, node] >= 0:
                    left = b.coded(x[rows], model.edges)[:, model.feature[t, node]] <= model.code[t, node]
                    assert gini_gain(y[rows], w, left) == pytest.approx(best)
                    seen += 1
                else:
                    assert best < 1e-6 or times[rows].sum() < 2 * s.least_rows
    assert seen > 30


@pytest.mark.parametrize("wide", [False, True])
def test_folds_grow_together_as_they_do_alone(spark, monkeypatch, wide):
    df, s = table(spark).repartition(5), f.Settings(trees=6, depth=5)
    edges = b.value_edges(df, COLUMNS, f.BINS)
    alone = [f.fit(df.where(F.col("fold") != k).withColumn("fold", F.lit(9)), COLUMNS, [0, 1, 2], settings=s, key="id", edges=edges) for k in range(3)]
    if wide:
        monkeypatch.setattr(f, "BROADCAST_ROWS", 1)
        monkeypatch.setattr(f, "PART_ROWS", 64)
        monkeypatch.setattr(f, "GROUP_BYTES", 200_000)
    together = f.fit(df, COLUMNS, [0, 1, 2], settings=s, fold="fold", folds=3, key="id", edges=edges)
    assert len(together) == 4 and len(f.fit(df, COLUMNS, [0, 1, 2], settings=s, fold="fold", folds=3, key="id", edges=edges, whole=False)) == 3
    first = together[0]
    assert (first.feature == alone[0][0].feature).all() and np.allclose(first.share, alone[0][0].share) and first.importance.sum() == pytest.approx(1)
    # trees of other models have numbers, and so bags, of their own: they are the trees of a model with as many before
    more = f.fit(df.where("fold <> 1").withColumn("fold", F.lit(9)), COLUMNS, [0, 1, 2], settings=f.Settings(trees=12, depth=5), key="id", edges=edges)[0]
    assert (together[1].feature == more.feature[6:]).all() and (together[1].code == more.code[6:]).all()


def test_forests_do_not_depend_on_partitions(spark, monkeypatch):
    s = f.Settings(trees=5)
    one = f.fit(table(spark).coalesce(1), COLUMNS, [0, 1, 2], settings=s)[0]
    monkeypatch.setattr(f, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(b, "BLOCK_ROWS", 50)
    many = f.fit(table(spark).repartition(7, "x"), COLUMNS, [0, 1, 2], settings=s)[0]
    assert np.array_equal(one.share, many.share) and np.array_equal(one.code, many.code) and np.array_equal(one.importance, many.importance)


def test_saved_model_predicts_alike(spark, tmp_path):
    df = table(spark)
    model = mo.fit_forest(df, COLUMNS, trees=8)
    mo.save(model, str(tmp_path), mo.importances(model, spark, COLUMNS))
    again, metadata = mo.load(spark, str(tmp_path))
    assert [r["rank"] for r in metadata.orderBy("rank").collect()] == [1, 2, 3]
    one, two = (sorted(map(str, mo.forest_proba(m, df).select("id", "proba").collect())) for m in (model, again))
    assert one == two and len(one) == 400
    p = mo.predicted(mo.forest_proba(model, df))
    assert p.where("class_id = predicted").count() > 360
    assert mo.forest_proba(model, df.limit(0)).collect() == []


def test_cross_validation_reports_all_folds(spark):
    row = mo.cross_validate(table(spark), "id", trees=10, k=5, columns=COLUMNS).first()
    assert row["folds"] == 5 and 0.7 < row["f1_mean"] <= 1 and row["f1_std"] < 0.2 and row["accuracy_mean"] > 0.8


def test_no_more_partitions_than_cores(spark):
    rows = spark.range(0, 4000, 1, 40).selectExpr("id", "double(id % 7) a", "double(id % 11) b", "int(id % 3) class_id")
    edges = f.value_edges(rows, ["a", "b"], 32)
    data, n = f.blocks(rows, ["a", "b"], "class_id", None, "id", edges, [0, 1, 2], 0, 10)
    assert n == 4000 and data.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sum(len(b.y) for b in data.collect()) == 4000


def test_bags_at_the_borders_of_the_draws():
    keys = np.random.default_rng(5).integers(0, 1 << 63, 20000).astype(np.uint64)
    times = f.bagged(keys, 3, f.Settings())
    x = keys + np.uint64((2026 * 7_368_787 + 4) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    draws = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0 ** -53
    assert (times == np.searchsorted(f.BAG, draws, "right")).all()


def test_site_months_are_read_once_for_their_score(spark):
    from paramo.plans import learning

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x)

    row = {"upra_var_mensual_pct": 1.0, "ideam_precipitacion_anomalia": 2.0, "ideam_temperatura_anomalia": 0.5}
    sites = spark.range(50).select(F.col("id").alias("row_id"), counted("id").alias("upra_indice_total"), *[F.lit(v).alias(c) for c, v in row.items()],
                                   F.lit(3).alias("mes"), F.lit(2020).alias("anio"))
    rows = learning.labelled(lambda name: sites)
    assert rows.count() == 50 and seen.value == 50


def test_counts_of_open_nodes_against_row_by_row():
    """Rows that are out of the model, of the bag or of every open node do not count, whichever is found out first."""
    rng = np.random.default_rng(7)
    n, s = 3000, f.Settings(trees=1, depth=4, features=2, seed=3)
    codes, fold = rng.integers(0, 6, (n, 4)).astype(np.uint8), rng.integers(0, 3, n).astype(np.int32)
    y = ((codes[:, 0] > 2) + (codes[:, 1] > codes[:, 2])).astype(np.int16)
    block = b.Block(codes, y, fold, rng.integers(0, 1 << 62, n).astype(np.uint64), np.zeros((n, 0, 3)))
    tree, columns = f.seedling(5, 1, 4, 3, s), block.columns()
    for level in range(s.depth):
        found = f.histogram(block, tree, level, s, 6, 3, columns)
        assert np.array_equal(found, f.histogram(block, tree, level, s, 6, 3))
        times, node = f.bagged(block.keys, 5, s), b.leaves(codes, tree.feature, tree.code, level) - ((1 << level) - 1)
        drawn, expected = f.drawn_features(5, level, 4, s), np.zeros_like(found)
        for i in np.flatnonzero((fold != 1) & np.isin(node, tree.open)):
            at = int(np.searchsorted(tree.open, node[i]))
            for j, k in enumerate(drawn[node[i]]):
                expected[at, j, codes[i, k], y[i]] += times[i]
        assert np.array_equal(found, expected)
        f.split(tree, found, level, np.ones(3), s)


def test_probabilities_are_those_of_the_leaves():
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (500, 3))
    edges = [np.sort(rng.normal(0, 1, 8)) for _ in range(3)]
    feature, code = np.full((4, 15), -1, np.int16), np.zeros((4, 15), np.int16)
    for t in range(4):
        inner = [0, 1, 2, 5][:t + 1] if t else []
        feature[t, inner], code[t, inner] = rng.integers(0, 3, len(inner)), rng.integers(0, 7, len(inner))
    share = rng.random((4, 15, 2))
    model = f.Forest(("a", "b", "c"), edges, (0, 1), feature, code, share, np.ones(3) / 3)
    expected = np.mean([share[t][b.leaves(b.coded(x, edges), feature[t], code[t])] for t in range(4)], axis=0)
    assert np.allclose(model.probabilities(x), expected)
