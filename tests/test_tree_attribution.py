import itertools
from math import factorial

import numpy as np
import pytest

from paramo.operators import boosting, forest
from paramo.operators import tree_attribution as ta

COLUMNS = ("a", "b", "c", "d")


def table(spark, n, seed, **more):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (n, 4)).astype(float)
    y = ((x[:, 0] > 2).astype(int) + (x[:, 1] * x[:, 2] > 8)).tolist()
    rows = [(i, *r, c, float(1 + i % 3)) for i, (r, c) in enumerate(zip(x.tolist(), y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double, class_id int, weight double"), x


def enumerated(value, x, others, weights):
    """Shapley values by all subsets of the features."""
    n = len(x)
    worth = {}
    for size in range(n + 1):
        for s in itertools.combinations(range(n), size):
            mixed = others.copy()
            mixed[:, list(s)] = x[list(s)]
            worth[s] = np.average(value(mixed), weights=weights)
    out = np.zeros(n)
    for j in range(n):
        for s in worth:
            if j not in s:
                w = factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n)
                out[j] += w * (worth[tuple(sorted((*s, j)))] - worth[s])
    return out


@pytest.fixture(scope="module")
def models(spark):
    df, _ = table(spark, 200, 1)
    grove = forest.fit(df, COLUMNS, [0, 1, 2], settings=forest.Settings(trees=7, depth=5), key="id")[0]
    boost = boosting.fit(df, COLUMNS, [0, 1, 2], settings=boosting.Settings(rounds=6, depth=4), key="id")[0]
    return grove, boost


@pytest.mark.parametrize("kind", [0, 1])
@pytest.mark.parametrize("weighted", [False, True])
def test_equals_enumeration_over_all_subsets(spark, models, kind, weighted):
    model = models[kind]
    value = (lambda x: model.probabilities(x)[:, 1]) if kind == 0 else (lambda x: model.margins(x)[:, 1])
    rows, x = table(spark, 12, 2)
    others, z = table(spark, 40, 3)
    weights = np.array([1 + i % 3 for i in range(40)]) if weighted else np.ones(40)
    got = ta.tree_shapley(rows, others if weighted else others.drop("weight"), "id", model, 1).toPandas().pivot(index="id", columns="feature", values="contribution")
    want = np.stack([enumerated(value, r, z, weights) for r in x])
    assert np.allclose(got[list(COLUMNS)].to_numpy(), want, atol=1e-12)
    base = np.average(value(z), weights=weights)
    assert np.allclose(got.sum(axis=1).to_numpy(), value(x) - base, atol=1e-9)


def test_does_not_depend_on_partitioning(spark, models):
    rows, _ = table(spark, 30, 4)
    a = ta.tree_shapley(rows, rows, "id", models[0]).orderBy("id", "feature").toPandas()
    b = ta.tree_shapley(rows.repartition(5, "id"), rows.repartition(7, "id"), "id", models[0]).orderBy("id", "feature").toPandas()
    assert a.equals(b)


def test_nulls_repeats_blocks_and_empty_tables(spark, models, monkeypatch):
    rows = spark.createDataFrame([(1, None, 2.0, 3.0, None, "x"), (1, None, 2.0, 3.0, None, "y"), (None, 0.0, 2.0, 3.0, 0.0, "z")],
                                 "id int, a double, b double, c double, d double, feature string")
    others, _ = table(spark, 20, 5)
    out = ta.tree_shapley(rows, others, "id", models[0]).toPandas()
    assert len(out) == 12 and out["id"].isna().sum() == 4
    # a null counts as 0, so all three rows have the same contributions
    assert (out.groupby("feature")["contribution"].nunique() == 1).all()
    whole = ta.tree_shapley(others, others, "id", models[1]).orderBy("id", "feature").toPandas()
    monkeypatch.setattr(ta, "ROWS", 3)
    assert np.allclose(ta.tree_shapley(others, others, "id", models[1]).orderBy("id", "feature").toPandas().contribution, whole.contribution, atol=1e-12)
    assert ta.tree_shapley(others.limit(0), others, "id", models[0]).count() == 0
    with pytest.raises(ValueError, match="background"):
        ta.tree_shapley(others, others.limit(0), "id", models[0])


def test_a_tree_without_splits_gives_nothing(spark):
    df = spark.createDataFrame([(i, 1.0, i % 2) for i in range(20)], "id int, a double, class_id int")
    model = forest.fit(df, ["a"], [0, 1], settings=forest.Settings(trees=2), key="id")[0]
    assert {r["contribution"] for r in ta.tree_shapley(df, df, "id", model, 1).collect()} == {0.0}


def test_rows_are_looked_up_leaf_by_leaf_and_weights_of_one_are_counts():
    rng = np.random.default_rng(5)
    feature, code, value = np.full((1, 2, 15), -1, np.int16), np.zeros((1, 2, 15), np.int16), rng.normal(size=(1, 2, 15))
    feature[0, 1, [0, 1, 2, 4]], code[0, 1, [0, 1, 2, 4]] = [2, 0, 2, 1], [3, 1, 5, 2]
    model = boosting.Boosting(("a", "b", "c"), [np.arange(8.0)] * 3, (0, 1), feature, code, value)
    trees, masks = ta.paths(model, 1)
    codes, share, out = rng.integers(0, 8, (300, 3)).astype(np.uint8), rng.random(masks), np.ones((3, 300))
    given, first = ta.table(trees[0], share, 3)
    trees[0].add(out, given, codes)
    there = trees[0].masks(codes) + trees[0].start - first
    wanted = np.array([[1 + sum(given[f, i] for i in row) for row in there] for f in range(3)])
    assert np.allclose(out, wanted, atol=1e-12)
    one, other = np.zeros(masks), np.zeros(masks)
    ta.tallied(one, trees, codes, np.ones(300))
    ta.tallied(other, trees, codes, np.where(np.arange(300) < 100, 2.0, 0.5))
    ta.tallied(other, trees, codes[:100], np.full(100, -1.0))
    ta.tallied(other, trees, codes[100:], np.full(200, 0.5))
    assert (one == np.bincount(there.ravel(), minlength=masks)).all() and np.allclose(one, other)


def test_leaves_are_looked_up_in_groups(monkeypatch):
    rng = np.random.default_rng(9)
    feature, code = np.full((1, 1, 63), -1, np.int16), np.zeros((1, 1, 63), np.int16)
    for node in [0, 1, 2, 3, 5, 6, 8, 12, 13, 14, 17]:
        feature[0, 0, node], code[0, 0, node] = rng.integers(0, 4), rng.integers(0, 7)
    model = boosting.Boosting(("a", "b", "c", "d"), [np.arange(8.0)] * 4, (0,), feature, code, rng.normal(size=(1, 1, 63)))
    codes = rng.integers(0, 8, (20000, 4)).astype(np.uint8)
    for most, least, many in ((1 << 10, 1, 1), (12, 3, 1), (12, 3, 1 << 20)):
        monkeypatch.setattr(ta, "CELLS", most)
        monkeypatch.setattr(ta, "MANY", many)
        trees, masks = ta.paths(model, 0)
        tree, = trees
        assert least <= len(tree.groups) < len(tree.value) and [k for g in tree.groups for k in g.leaves] == list(range(len(tree.value)))
        total, each = np.zeros(masks), tree.masks(codes).astype(np.int64)
        ta.tallied(total, trees, codes, np.ones(len(codes)))
        assert np.array_equal(total, np.bincount((each + tree.start).ravel(), minlength=masks))
        given, _ = ta.table(tree, total / len(codes), 4)
        out = np.zeros((4, len(codes)))
        tree.add(out, given, codes)
        assert np.allclose(out, given[:, each + tree.start].sum(axis=2), atol=1e-12)
