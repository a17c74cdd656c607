import numpy as np
import pytest
from pyspark.sql import functions as F

from paramo.operators import boosting as b
from paramo.operators import models as mo

COLUMNS = ["x", "y", "z"]


def table(spark, n=400, seed=0, values=12):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y, z = (float(v) for v in rng.integers(0, values, 3))
        rows.append((i, x, y if i % 17 else None, z, int(x + 2 * (y > values / 2) > values * 0.7) + int(x > values * 0.8), i % 3))
    return spark.createDataFrame(rows, "id int, x double, y double, z double, class_id int, fold int")


def all_splits(x, g, h, allowed, s):
    """(gain, feature, threshold) of every split, by trying each value of each feature."""
    def worth(rows):
        a = max(abs(g[rows].sum()) - s.l1, 0)
        return a * a / (h[rows].sum() + s.l2)

    out = []
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[1:]:
            left = x[:, f] < v
            if allowed[f] and min(h[left].sum(), h[~left].sum()) >= s.least_curvature:
                out.append((worth(left) + worth(~left) - worth(np.ones(len(x), bool)), f, v))
    return out


def grown_by_hand(x, g, h, allowed, s, depth, tree, node, b_, edges):
    """Compares a tree node by node with the best of all splits of the node's rows."""
    best = max((c for c in all_splits(x, g, h, allowed, s)), default=(0, 0, 0)) if depth else (0, 0, 0)
    feature, code, value = tree
    if depth and best[0] >= s.least_gain:
        f = feature[node]
        assert f >= 0
        threshold = edges[f][code[node] + 1]
        gains = {(c[1], c[2]): c[0] for c in all_splits(x, g, h, allowed, s)}
        assert gains[f, threshold] == pytest.approx(best[0], rel=1e-4)
        left = x[:, f] < threshold
        for child, rows in ((2 * node + 1, left), (2 * node + 2, ~left)):
            grown_by_hand(x[rows], g[rows], h[rows], allowed, s, depth - 1, tree, child, b_, edges)
    else:
        assert feature[node] < 0
        leaf = -np.sign(g.sum()) * max(abs(g.sum()) - s.l1, 0) / (h.sum() + s.l2) * s.step
        assert value[node] == pytest.approx(leaf, abs=1e-5)
        b_.append(len(x))


def test_every_split_is_the_best_of_all(spark):
    df = table(spark)
    s = b.Settings(rounds=3, depth=4, rows=1.0, features=1.0)
    model = b.fit(df, COLUMNS, [0, 1, 2], settings=s, key="id")[0]
    rows = df.select(*[F.coalesce(c, F.lit(0.0)) for c in COLUMNS], "class_id").toPandas().to_numpy()
    x, y = rows[:, :3], rows[:, 3]
    margins, found = np.zeros((len(x), 3)), []
    for r in range(3):
        p = b.softmax(margins)
        for c in range(3):
            tree = model.feature[r, c], model.code[r, c], model.value[r, c]
            grown_by_hand(x, p[:, c] - (y == c), 2 * p[:, c] * (1 - p[:, c]), [True] * 3, s, s.depth, tree, 0, found, model.edges)
        for c in range(3):
            margins[:, c] += model.value[r, c][b.leaves(b.coded(x, model.edges), model.feature[r, c], model.code[r, c])]
    assert len(found) > 30 and np.allclose(model.margins(x), margins)


@pytest.mark.parametrize("one_task", [True, False])
def test_folds_grow_together_as_they_do_alone(spark, monkeypatch, one_task):
    if not one_task:
        monkeypatch.setattr(b, "BLOCK_ROWS", 64)
        monkeypatch.setattr(b, "CHECKPOINT_ROUNDS", 3)
        monkeypatch.setattr(b, "TREE_FROM", 3)
    df, s = table(spark).repartition(5), b.Settings(rounds=8, depth=3)
    edges = b.value_edges(df, COLUMNS)
    together = b.fit(df, COLUMNS, [0, 1, 2], settings=s, fold="fold", folds=3, key="id", edges=edges)
    assert len(together) == 4
    for f, model in enumerate(together):
        monkeypatch.undo()
        alone = b.fit(df.where(F.col("fold") != f), COLUMNS, [0, 1, 2], settings=s, key="id", edges=edges)[0]
        assert (model.feature == alone.feature).all() and (model.code == alone.code).all() and np.array_equal(model.value, alone.value)


def test_models_do_not_depend_on_partitions(spark, monkeypatch):
    s = b.Settings(rounds=6, depth=4)
    one = b.fit(table(spark).coalesce(1), COLUMNS, [0, 1, 2], settings=s)[0]
    monkeypatch.setattr(b, "BLOCK_ROWS", 50)
    many = b.fit(table(spark).repartition(7, "x"), COLUMNS, [0, 1, 2], settings=s)[0]
    assert np.array_equal(one.value, many.value) and np.array_equal(one.code, many.code)
    used = [set(one.feature[r, c][one.feature[r, c] >= 0].tolist()) for r in range(6) for c in range(3)]
    assert all(len(u) <= 2 for u in used)  # 0.8 of three features


def test_edges_are_quantiles_or_all_values(spark):
    df = spark.range(1000).select((F.col("id") % 5).cast("double").alias("few"), F.col("id").cast("double").alias("many"), F.lit(None).cast("double").alias("none"))
    few, many, none = b.value_edges(df, ["few", "many", "none"], 10)
    assert few.tolist() == [0, 1, 2, 3, 4] and none.tolist() == [0]
    assert many.tolist() == [float(100 * k) for k in range(10)]
    assert b.coded(np.array([[-3, 99, 0], [2.5, 100, 1], [9, 5000, -1]]), [few, many, none]).tolist() == [[0, 0, 0], [2, 1, 0], [4, 9, 0]]


def test_probabilities_and_their_loss(spark):
    df = table(spark)
    few, more = (mo.fit_boosting(df, COLUMNS, rounds=r, key="id") for r in (2, 40))
    def loss(model):
        rows = model.proba(df).select("class_id", "proba").collect()
        assert len(rows) == 400 and all(abs(sum(r["proba"]) - 1) < 1e-9 and len(r["proba"]) == 3 for r in rows)
        return -np.mean([np.log(r["proba"][r["class_id"]]) for r in rows])
    assert loss(more) < loss(few) < np.log(3)
    two = mo.fit_boosting(df.where("class_id <> 1"), COLUMNS, rounds=5)
    assert {r["proba"][1] for r in two.proba(df).collect()} == {0.0}
    assert two.proba(df.limit(0)).collect() == []


def test_ensemble_end_to_end(spark):
    """The real path on small rows: both base models, their folds and calibrations, against the boosted folds fitted one by one."""
    df = table(spark, 300)
    model = mo.fit_ensemble(df, "id", trees=5, rounds=10, columns=COLUMNS)
    rows = mo.predicted(model.predict(df)).select("class_id", "proba", "predicted").collect()
    assert len(rows) == 300 and all(abs(sum(r["proba"]) - 1) < 1e-9 for r in rows)
    assert np.mean([r["class_id"] == r["predicted"] for r in rows]) > 0.9
    alone = b.fit(df, COLUMNS, [0, 1, 2], settings=b.Settings(rounds=10), key="id")[0]
    assert np.array_equal(alone.value, model.boosting.value)


@pytest.mark.parametrize("most", [1, 40, 1 << 13])
def test_joint_counts_are_those_of_each_feature(monkeypatch, most):
    monkeypatch.setattr(b, "JOINT_CELLS", most)
    rng = np.random.default_rng(4)
    codes = np.stack([rng.integers(0, k, 3000) for k in (9, 1, 5, 30, 2)], axis=1).astype(np.uint8)
    block = b.Block(codes, rng.integers(0, 3, 3000).astype(np.int16), np.full(3000, -1, np.int32), rng.integers(0, 1 << 62, 3000).astype(np.uint64), rng.normal(size=(3000, 1, 3)))
    s, feature, code = b.Settings(depth=2), np.full((1, 3, 7), -1, np.int16), np.zeros((1, 3, 7), np.int16)
    feature[:, :, 0], code[:, :, 0], feature[:, :2, 1], code[:, :2, 1] = 3, 11, 0, 4
    (mine, each), = block.slopes(2, s)
    for level, nodes in ((0, 1), (1, 1), (2, 2)):
        found = block.histogram(2, level, (feature, code), s, 30)
        for c in range(3):
            node = b.leaves(codes[mine], feature[0, c], code[0, c], level)
            for slot in range(nodes):
                at = np.flatnonzero(node == (1 << level) - 1 + 2 * slot)
                for k in range(5):
                    for j in range(2):
                        assert (found[0, c, slot, k, :, j] == np.bincount(codes[mine][at, k], each[c][j][at], 30)).all()


def test_small_tables_take_no_job_a_level_and_large_ones_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(b, "BLOCK_ROWS", 64)
    df, s, sc = table(spark).repartition(5).cache(), b.Settings(rounds=6, depth=3), spark.sparkContext
    edges = b.value_edges(df, COLUMNS)

    def grown(group):
        sc.setJobGroup(group, group)
        models = b.fit(df, COLUMNS, [0, 1, 2], settings=s, fold="fold", folds=3, key="id", edges=edges)
        sc.setLocalProperty("spark.jobGroup.id", None)
        return models, len(sc.statusTracker().getJobIdsForGroup(group))

    few, jobs = grown("boosting in tasks")
    assert jobs < s.rounds * s.depth
    for name, value in (("TASK_ROWS", 1), ("CHECKPOINT_ROUNDS", 3), ("TREE_FROM", 3)):
        monkeypatch.setattr(b, name, value)
    many, _ = grown("boosting over partitions")
    for one, other in zip(few, many):
        assert (one.feature == other.feature).all() and (one.code == other.code).all() and np.array_equal(one.value, other.value)


def test_the_child_of_less_weight_is_counted():
    rng = np.random.default_rng(8)
    n = 4000
    codes = np.stack([rng.integers(0, k, n) for k in (9, 30, 5)], axis=1).astype(np.uint8)
    y = (codes[:, 0] == 8).astype(np.int16) + (codes[:, 1] < 6)
    block = b.Block(codes, y, (np.arange(n) % 2).astype(np.int32), rng.integers(0, 1 << 62, n).astype(np.uint64), np.zeros((n, 2, 3)))
    s, counted = b.Settings(depth=4, features=1.0), []
    work = block.work(5, s)

    def total(level, trees):
        found = work.histogram(level, trees, 30)
        if level:
            feature, code, side = trees
            for m, (mine, each) in enumerate(work.each):
                for c in range(3):
                    at = b.leaves(codes[mine], feature[m, c], code[m, c], level) - ((1 << level) - 1)
                    for k in np.flatnonzero(feature[m, c, (1 << (level - 1)) - 1:(1 << level) - 1] >= 0):
                        weights = [each[c][1][at == 2 * k + j].sum() for j in (0, 1)]
                        assert found[m, c, k, 0, :, 1].sum() == weights[side[m, c, k]] == min(weights)
                        counted.append(int(side[m, c, k]))
        return found

    feature, code, value = b.grown(total, 5, (2, 3, 3, 30), s)
    assert set(counted) == {0, 1}
    after = block.advanced((feature, code, value)).margins
    for m in range(2):
        for c in range(3):
            leaf = b.leaves(codes, feature[m, c], code[m, c])
            assert np.array_equal(after[:, m, c], block.margins[:, m, c] + value[m, c][leaf])


def test_blocks_are_kept_as_they_are(spark, monkeypatch):
    """Blocks in memory are bytes already; written into a stream of Java objects once more, each pass over them costs more than its sums."""
    seen, grown = [], b.grown

    def watched(total, *rest):
        out = grown(total, *rest)
        seen.extend(rdd.getStorageLevel().deserialized() for rdd in spark.sparkContext._jsc.getPersistentRDDs().values())
        return out

    monkeypatch.setattr(b, "TASK_ROWS", 0)
    monkeypatch.setattr(b, "grown", watched)
    b.fit(table(spark), COLUMNS, [0, 1, 2], settings=b.Settings(rounds=2, depth=2), key="id")
    assert seen and all(seen)


def test_edges_of_several_sizes_at_once(spark):
    df = table(spark)
    both = b.edges_for(df, COLUMNS, [16, 5])
    for found, bins in zip(both, (16, 5)):
        assert all(np.array_equal(x, y) for x, y in zip(found, b.value_edges(df, COLUMNS, bins)))
