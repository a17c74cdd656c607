"""Packed neighbour lists: what they hold, what they leave on disk."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from paramo.functions import neighbours as nb
from paramo.operators import anomaly as an


def block(x: np.ndarray, most: int) -> nb.Points:
    leaf = nb.leaf_of(x, nb.split_tree(x, most))
    order = np.argsort(leaf, kind="stable")
    names = np.stack([np.arange(len(x)), np.arange(len(x))], axis=1).astype(">u8")
    return nb.Points(x[order], np.ones(len(x), np.int64), names, np.cumsum(np.bincount(leaf)))


def test_what_a_block_sends_back_holds_the_nearest_of_every_asker():
    rng = np.random.default_rng(1)
    p = block(rng.normal(0, 1, (1500, 3)), 16)
    near, far = rng.normal(1, 0.5, (40, 3)), rng.normal(0, 40, (10, 3))  # the latter reach nearly all leaves
    for x, reach in ((near, np.full(40, 0.3)), (far, np.full(10, 1e3))):
        sent = set(nb.wanted_of(p, x, reach, 7).tolist())
        d = nb.distances(x, p.x)
        need = {int(j) for i in range(len(x)) for j in np.argsort(d[i])[:7] if d[i, j] <= reach[i]}
        assert need <= sent and len(sent) < 300


def test_lists_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (700, 3)), rng.normal(0, 30, (20, 3)), np.repeat(rng.normal(0, 1, (5, 3)), 4, axis=0)])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(len(x))))
    points = nb.distinct_points(df, list("abc"), "id").localCheckpoint()
    lists = {r["block"]: r for r in nb.near_lists(points, 3, 6, size=64).collect()}
    assert len(lists) > 3
    v = {r["uid"]: np.array(r["v"]) for r in points.collect()}
    names = {b: [bytes(r["uid"])[i:i + 16].hex() for i in range(0, len(r["uid"]), 16)] for b, r in lists.items()}
    assert sorted(n for part in names.values() for n in part) == sorted(v)
    for b, r in lists.items():
        count, place, take = (np.frombuffer(r[c], np.int32) for c in ("count", "place", "take"))
        dist, ends = np.frombuffer(r["dist"], float), np.cumsum(count)
        others = names[b] + [names[w["origin"]][i] for w in r["wants"] for i in np.frombuffer(w["places"], np.int32)]
        for i, name in enumerate(names[b]):
            part = slice(ends[i] - count[i], ends[i])
            d = np.sort(np.sqrt(((x - v[name]) ** 2).sum(axis=1)))[1:7]  # the row itself is the first
            assert take[part].sum() == 6 and np.allclose(np.repeat(dist[part], take[part]), d)
            assert all(np.isclose(np.linalg.norm(v[others[j]] - v[name]), at) for j, at in zip(place[part], dist[part]))


def test_outlier_factors_leave_little_on_disk(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(0, 1, (4000, 4)), columns=list("abcd")).assign(id=range(4000)))

    def held():
        root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(root) for f in files)

    before = held()
    assert an.local_outlier_factor(df, "id", list("abcd"), 20, size=512).count() == 4000
    # a row for each neighbour takes some 2,000 bytes a row of the table
    assert held() - before < 100 * 4000
