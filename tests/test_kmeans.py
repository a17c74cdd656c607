"""K-means whose starts share the passes over the rows."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from paramo.functions import neighbours as nb
from paramo.operators import cluster as cl

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3)) + rng.integers(0, 4, size=(3000, 1)) * np.array([6.0, -3.0, 1.0])
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double").repartition(5)


def test_starts_agree_in_tasks_and_over_partitions(rows, monkeypatch):
    near = cl.runs(cl.scaled_rows(rows, "id", COLS), COLS, [(4, s) for s in range(5)], 300)
    monkeypatch.setattr(cl, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(cl, "PASS_ROWS", 256)
    far = cl.runs(cl.scaled_rows(rows, "id", COLS), COLS, [(4, s) for s in range(5)], 300)
    for (a, p), (b, q) in zip(near, far):
        assert np.allclose(a, b) and p == pytest.approx(q)


def test_as_good_as_separate_fits(spark, rows):
    out, cost, centres = cl.kmeans(rows, "id", 4, COLS)
    data = nb.standardised(rows, COLS, ["id"]).withColumn("features", array_to_vector(F.array(*COLS)))
    assert cost <= min(KMeans(k=4, seed=s, maxIter=300).fit(data).summary.trainingCost for s in range(3)) * 1.0001
    got = {r["id"]: r["cluster"] for r in out.collect()}
    for r in data.collect():
        assert got[r["id"]] == np.argmin(((np.array([r[c] for c in COLS]) - centres) ** 2).sum(axis=1))


def test_number_of_jobs_does_not_grow_with_the_starts(spark, rows):
    def jobs(starts, group):
        spark.sparkContext.setJobGroup(group, group)
        cl.kmeans(rows, "id", 3, COLS, starts=starts)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(12, "twelve starts") == jobs(2, "two starts")


def test_fewer_rows_than_centres_and_equal_rows(spark):
    rows = spark.createDataFrame([(None, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0), (1, 2.0, None, 1.0)], "id long, a double, b double, c double")
    out, cost, centres = cl.kmeans(rows, "id", 4, COLS, starts=3)
    assert out.count() == 3 and len(centres) <= 2 and cost == pytest.approx(0)
