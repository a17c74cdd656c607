"""Clustering: k-means with a swept k, density clusters, quality and profiles."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.functions import neighbours as nb
from paramo.functions.ranks import exact_quantiles, long_form, running_totals
from paramo.session import cut_lineage, materialise

EPS, MIN_POINTS = 0.8, 3
#: Rows of a block and, about, of a partition of many; tables of up to so many rows are broadcast, and each task runs some of the starts of k-means.
PASS_ROWS, PART_ROWS, BROADCAST_ROWS = 1 << 14, 1 << 20, 1 << 18
#: k-means ends when no centre moves further than this (the default of Spark's).
TOLERANCE = 1e-4


def scaled_rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The standardised columns, written out once, and a hash of the key that draws the first centres."""
    return materialise(nb.standardised(df, columns, [key]).withColumn("_draw", F.xxhash64(key)))


def points(data: DataFrame, columns: Sequence[str]) -> tuple[RDD, int]:
    """The columns and hashes as an RDD of blocks (rows, hashes) of PASS_ROWS rows at most, and the number of rows."""
    def pack(batches):
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)
            draws, at = batch.column("_draw").to_numpy(), range(0, len(x), PASS_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array([x[i:i + PASS_ROWS].tobytes() for i in at], pa.binary()), pa.array([draws[i:i + PASS_ROWS].tobytes() for i in at], pa.binary()),
                                              pa.array([len(x[i:i + PASS_ROWS]) for i in at], pa.int64())], names=["x", "draw", "n"])

    def unpack(found):
        held, size = [], 0
        for r in itertools.chain(found, [None]):
            if held and (r is None or size + r["n"] > PASS_ROWS):
                yield tuple(np.concatenate(c) for c in zip(*held))
                held, size = [], 0
            if r is not None:
                held.append((np.frombuffer(bytes(r["x"])).reshape(-1, len(columns)), np.frombuffer(bytes(r["draw"]), np.uint64)))
                size += r["n"]

    packed = cut_lineage(data.select(*columns, "_draw").mapInArrow(pack, "x binary, draw binary, n long"))
    n = packed.agg(F.sum("n")).first()[0] or 0
    wide = max(2 * packed.sparkSession.sparkContext.defaultParallelism, n // PART_ROWS)
    return packed.rdd.coalesce(max(1, min(packed.rdd.getNumPartitions(), wide))).mapPartitions(unpack), n


def uniform(draws: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number from 0 to 1 for each row; it depends on the row's hash alone."""
    x = draws + np.uint64((seed * 1_000_003 + turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0 ** -53


def closest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, number) of the nearest centre of each row; of equal ones the first."""
    d = (centres * centres).sum(axis=1)[:, None] - 2 * (centres @ x.T)
    least, at = d[0].copy(), np.zeros(len(x), np.int16)
    for j in range(1, len(centres)):
        at[d[j] < least] = j
        np.minimum(least, d[j], out=least)
    return np.maximum(least + (x * x).sum(axis=1), 0), at


def sums_of(blocks, centres: Sequence[np.ndarray]) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """One pair: for each start the sums and the number (last column) of the points nearest to each centre, and its inertia."""
    sums, cost = [np.zeros((len(c), c.shape[1] + 1)) for c in centres], np.zeros(len(centres))
    for x, _ in blocks:
        for i, c in enumerate(centres):
            least, at = closest(x, c)
            cost[i] += least.sum()
            sums[i][:, :-1] += (at == np.arange(len(c))[:, None]).astype(float) @ x
            sums[i][:, -1] += np.bincount(at, minlength=len(c))
    return [(sums, cost)]


def added(each, centres: Sequence[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """(sums and numbers, inertia) of every start over all rows."""
    found = each(lambda blocks: sums_of(blocks, centres))
    return [(sum(sums[i] for sums, _ in found), float(sum(cost[i] for _, cost in found))) for i in range(len(centres))]


def seeds(each, starts: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """The first centres of each start (k, seed) by k-means||: two rounds that draw some 2k rows each by their distance,
    then k-means++ over what was drawn, weighted by the rows next to it."""
    def lowest(blocks):
        best = [None] * len(starts)
        for x, draws in blocks:
            for i, (_, seed) in enumerate(starts):
                u = uniform(draws, seed, 0)
                at = u.argmin()
                best[i] = min([b for b in (best[i], (u[at], tuple(x[at]))) if b is not None])
        return [best]

    found = each(lowest)
    drawn = [np.array([min(best[i] for best in found if best[i] is not None)[1]]) for i in range(len(starts))]
    for turn in (1, 2):
        cost = [c for _, c in added(each, drawn)]

        def more(blocks, drawn=drawn, cost=cost, turn=turn):
            out = [[c[:0]] for c in drawn]
            for x, draws in blocks:
                for i, (k, seed) in enumerate(starts):
                    out[i].append(x[uniform(draws, seed, turn) * cost[i] < 2 * k * closest(x, drawn[i])[0]])
            return [[np.unique(np.concatenate(o), axis=0) for o in out]]

        found = each(more)  # some 2k rows for each start
        drawn = [np.unique(np.concatenate([c, *[f[i] for f in found]]), axis=0) for i, c in enumerate(drawn)]
    return [plus_plus(c, sums[:, -1], k, seed) for (k, seed), c, (sums, _) in zip(starts, drawn, added(each, drawn))]


def plus_plus(rows: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of a few weighted rows: k-means++ and up to 30 steps of k-means; all rows if there are no more than k."""
    if len(rows) <= k:
        return rows
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), 1, p=weights / weights.sum())]
    while len(centres) < k:
        far = weights * closest(rows, centres)[0]
        if not far.sum() > 0:
            break
        centres = np.concatenate([centres, rows[rng.choice(len(rows), 1, p=far / far.sum())]])
    for _ in range(30):
        hot = (closest(rows, centres)[1] == np.arange(len(centres))[:, None]) * weights
        centres, still = moved(centres, np.concatenate([hot @ rows, hot.sum(axis=1, keepdims=True)], axis=1))
        if still:
            break
    return centres


def moved(centres: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, bool]:
    """The means of the points, and whether no centre went further than TOLERANCE; a centre without points stays."""
    n = sums[:, -1:]
    new = np.where(n > 0, sums[:, :-1] / np.maximum(n, 1), centres)
    return new, bool((((new - centres) ** 2).sum(axis=1) <= TOLERANCE ** 2).all())


def settled(each, starts: Sequence[tuple[int, int]], max_iter: int) -> list[tuple[np.ndarray, float]]:
    """(centres, inertia of the last assignment) of every start (k, seed); all that still move share a pass.

    ``each(fn)`` lists what ``fn`` finds in the blocks of every part of the table."""
    centres, costs, live = seeds(each, starts), [0.0] * len(starts), list(range(len(starts)))
    for _ in range(max_iter):
        still = []
        for i, (sums, costs[i]) in zip(live, added(each, [centres[i] for i in live])):
            centres[i], stays = moved(centres[i], sums)
            if not stays:
                still.append(i)
        live = still
        if not live:
            break
    return list(zip(centres, costs))


def runs(data: DataFrame, columns: Sequence[str], starts: Sequence[tuple[int, int]], max_iter: int) -> list[tuple[np.ndarray, float]]:
    """``settled`` over all rows: a small table goes to every task, which runs some of the starts to their end; else every pass is a job."""
    blocks, n = points(data, columns)
    if not n:
        raise ValueError("k-means needs rows")
    if n > BROADCAST_ROWS:
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return settled(lambda fn: blocks.mapPartitions(fn).collect(), starts, max_iter)
        finally:
            blocks.unpersist()
    sc = blocks.context
    held = sc.broadcast(blocks.collect())  # BROADCAST_ROWS rows at most

    def run(numbered):
        for number, start in numbered:
            yield number, settled(lambda fn: fn(held.value), [start], max_iter)[0]

    done = sc.parallelize(list(enumerate(starts)), min(len(starts), 2 * sc.defaultParallelism)).mapPartitions(run).collect()
    return [found for _, found in sorted(done, key=lambda d: d[0])]


def nearest(centres: np.ndarray, columns: Sequence[str]) -> Column:
    """The number of the centre a row is nearest to; of equal ones the first."""
    gaps = [sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, centre)), F.lit(0.0)) for centre in centres]
    return F.array_min(F.array(*[F.struct(g.alias("d2"), F.lit(i).alias("id")) for i, g in enumerate(gaps)]))["id"]


def kmeans(df: DataFrame, key: str, k: int, columns: Sequence[str] = tuple(fv.MEASURES), starts: int = 20,
           max_iter: int = 500, seed: int = 2026):
    """Best of several k-means runs on standardised features: (assignment, inertia, centres)."""
    data = scaled_rows(df, key, columns)
    centres, cost = min(runs(data, columns, [(k, seed + i) for i in range(starts)], max_iter), key=lambda m: m[1])
    return cut_lineage(data.select(key, nearest(centres, columns).alias("cluster"))), cost, centres


def best_k(df: DataFrame, key: str, columns: Sequence[str] = tuple(fv.MEASURES), highest: int = 7, starts: int = 10,
           max_iter: int = 300, seed: int = 2026) -> DataFrame:
    """(k, silhouette, inertia, chosen) for k = 2 up to min(highest, n/3).

    The silhouette is the squared-Euclidean one, which needs one pass and no pairs.
    """
    data = scaled_rows(df, key, columns)
    tried = range(2, max(2, min(highest, data.count() // 3)) + 1)
    found = runs(data, columns, [(k, seed + i) for k in tried for i in range(starts)], max_iter)
    judge, rows = ClusteringEvaluator(distanceMeasure="squaredEuclidean"), []
    points_ = data.withColumn("features", array_to_vector(F.array(*columns)))
    for n, k in enumerate(tried):
        centres, cost = min(found[n * starts:(n + 1) * starts], key=lambda m: m[1])
        rows.append((k, float(judge.evaluate(points_.withColumn("prediction", nearest(centres, columns).cast("double")))), cost))
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "k int, silhouette double, inertia double, chosen boolean")


def quality(df: DataFrame, columns: Sequence[str], cluster: str = "cluster", exact: bool = True, size: int = nb.BLOCK) -> DataFrame:
    """One row: silhouette, Davies-Bouldin and Calinski-Harabasz of an assignment.

    ``df`` holds the (already scaled) columns and the cluster.  The last two need only sums per cluster.
    The exact Euclidean silhouette needs every distance: blocks are compared in pairs and only sums per
    point and cluster leave a task.  With ``exact=False`` the squared-Euclidean form takes one pass.
    """
    dims = len(columns)
    cents = df.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])
    cents = cents.select(cluster, "n", F.array(*columns).alias("centre"))
    grand = df.agg(*[F.avg(c).alias(c) for c in columns]).select(F.array(*columns)).scalar()

    def gap2(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)

    # one row per cluster, so the list of centres is as short as the list of clusters
    off = df.select(cluster, F.array(*columns).alias("v")).join(cents, cluster).withColumn("d2", gap2(F.col("v"), F.col("centre")))
    per = off.groupBy(cluster).agg(F.avg(F.sqrt("d2")).alias("spread"), F.sum("d2").alias("within"), F.first("n").alias("n"), F.first("centre").alias("centre"))
    per = per.withColumns({"_every": per.agg(F.collect_list(F.struct(F.col(cluster).alias("id"), "spread", "centre"))).scalar(), "_grand": grand})
    ratios = F.transform(F.filter("_every", lambda o: o["id"] != F.col(cluster)),
                         lambda o: (F.col("spread") + o["spread"]) / F.sqrt(gap2(F.col("centre"), o["centre"])))
    k, n = F.count("*"), F.sum("n")
    between = F.sum(F.col("n") * gap2(F.col("centre"), F.col("_grand")))
    totals = per.withColumn("worst", F.array_max(ratios)).agg(
        F.avg("worst").alias("davies_bouldin"), ((between / (k - 1)) / (F.sum("within") / (n - k))).alias("calinski_harabasz"))
    if not exact:
        data = df.select(F.col(cluster).alias("prediction"), array_to_vector(F.array(*columns)).alias("features"))
        return totals.withColumn("silhouette", F.lit(float(ClusteringEvaluator().evaluate(data))))
    ids = df.withColumn("_id", F.monotonically_increasing_id())
    # written out before use, so that the ids stay what they are
    points = materialise(ids.select(F.col("_id").cast("string").alias("uid"), F.array(*columns).alias("v"),
                                    F.lit(1).cast("long").alias("w"), F.col("_id").alias("first"), F.col(cluster).cast("long").alias("c")))
    pts = nb.blocked(points, dims, size)
    inner = nb.boxes(pts, dims).withColumn("reach", F.lit(float("inf")))
    pairs = nb.block_pairs(inner, nb.outer_pairs(nb.outer_boxes(inner, dims), F.lit(float("inf"))), "reach")

    def sums(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if len(p) == 0 or len(q) == 0:
            return pd.DataFrame({"uid": [], "c": [], "other": [], "total": []})
        d, labels = nb.distances(nb.matrix(p), nb.matrix(q)), q["c"].to_numpy()
        return pd.concat([pd.DataFrame({"uid": p["uid"], "c": p["c"], "other": o, "total": d[:, labels == o].sum(axis=1)})
                          for o in np.unique(labels)])

    dist = nb.paired(pts.select("uid", "v", "c", "block"), pts.select("v", "c", "block"), pairs, sums, "uid string, c long, other long, total double")
    sizes = pts.groupBy(F.col("c").alias("other")).agg(F.count("*").alias("n"))
    mine = F.col("c") == F.col("other")
    ab = dist.groupBy("uid", "c", "other").agg(F.sum("total").alias("total")).join(sizes, "other").groupBy("uid").agg(
        F.max(F.when(mine, F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1)))).alias("a"),
        F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"))
    width = F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    return totals.withColumn("silhouette", ab.agg(F.avg(width)).scalar())


def dbscan(df: DataFrame, key: str, columns: Sequence[str], eps: float = EPS, min_points: int = MIN_POINTS,
           size: int = nb.BLOCK, scale: bool = True) -> DataFrame:
    """(key, cluster, is_core): density clusters, -1 for noise; clusters are numbered by their lowest core key.

    A pair of boxes that lies wholly within ``eps`` is settled from its weights alone, at the level of outer
    boxes where possible, so a region that holds a third of all points costs no distances at all.
    """
    dims = len(columns)
    z = materialise(nb.standardised(df, columns, [key]) if scale else df.select(key, *columns))
    pts = nb.blocked(nb.distinct_points(z, columns, key), dims, size)
    inner = nb.boxes(pts, dims).withColumn("reach", F.lit(float(eps)))
    outer = nb.outer_boxes(inner, dims)
    wide = cut_lineage(nb.outer_pairs(outer, F.lit(float(eps))))
    near = cut_lineage(nb.block_pairs(inner, wide.where(F.col("most") > eps), "reach"))
    wide_done, done, todo = wide.where(F.col("most") <= eps), near.where(F.col("most") <= eps), near.where(F.col("most") > eps)
    home = inner.select("block", "outer")

    # neighbours of every point, itself included
    def within(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if len(p) == 0 or len(q) == 0:
            return pd.DataFrame({"uid": [], "n": []})
        hit = nb.distances(nb.matrix(p), nb.matrix(q)) <= eps
        return pd.DataFrame({"uid": p["uid"], "n": hit @ q["w"].to_numpy()})

    counted = nb.paired(pts.select("uid", "v", "block"), pts.select("v", "w", "block"), todo, within, "uid string, n long")
    counted = counted.groupBy("uid").agg(F.sum("n").alias("n"))
    from_outer = wide_done.groupBy(F.col("outer_a").alias("outer")).agg(F.sum("w_b").alias("n_outer"))
    from_block = done.groupBy(F.col("a").alias("block")).agg(F.sum("w_b").alias("n_block"))
    base = home.join(from_outer, "outer", "left").join(from_block, "block", "left").select(
        "block", "outer", (F.coalesce("n_outer", F.lit(0)) + F.coalesce("n_block", F.lit(0))).alias("n_base"))
    state = cut_lineage(pts.join(base, "block").join(counted, "uid", "left").withColumn(
        "core", F.col("n_base") + F.coalesce("n", F.lit(0)) >= min_points).drop("n", "n_base"))
    cores = state.where("core")

    # links between core points: a spanning set per open pair, one link per settled pair
    def spanning(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if len(p) == 0 or len(q) == 0:
            return pd.DataFrame({"u": [], "v": []})
        hit = nb.distances(nb.matrix(p), nb.matrix(q)) <= eps
        left, right = np.arange(len(p)), np.full(len(q), len(p))
        while True:
            to_right = np.where(hit, left[:, None], len(p)).min(axis=0)
            to_left = np.minimum(left, np.where(hit, to_right[None, :], len(p)).min(axis=1))
            if (to_right == right).all() and (to_left == left).all():
                break
            left, right = to_left, to_right
        heads = p["uid"].to_numpy()
        u = np.concatenate([p["uid"].to_numpy(), q["uid"].to_numpy()[right < len(p)]])
        return pd.DataFrame({"u": u, "v": heads[np.concatenate([left, right[right < len(p)]])]})

    side = cores.select("uid", "v", "block")
    links = nb.paired(side, side, todo.where("a <= b"), spanning, "u string, v string")
    with_core = cores.select("block", "outer").distinct()

    def settled(pairs: DataFrame, a: str, b: str, level: str, mark: str) -> DataFrame:
        """Links of settled pairs with core points on both sides, by way of one node per box."""
        live = with_core.select(level).distinct()
        both = (pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
                .join(live.select(F.col(level).alias("_a")), "_a").join(live.select(F.col(level).alias("_b")), "_b"))
        node = lambda c: F.concat(F.lit(mark), F.col(c).cast("string"))
        inside = cores.join(both.select(F.col("_a").alias(level)).distinct(), level).select(F.col("uid").alias("u"), node(level).alias("v"))
        return inside.unionByName(both.where("_a < _b").select(node("_a").alias("u"), node("_b").alias("v")))

    links = links.unionByName(settled(done, "a", "b", "block", "~b")).unionByName(settled(wide_done, "outer_a", "outer_b", "outer", "~s"))
    linked = nb.components(links)
    roots = cores.select("uid", "first").join(linked.select(F.col("node").alias("uid"), "component"), "uid", "left").withColumn(
        "component", F.coalesce("component", "uid"))
    heads = roots.groupBy("component").agg(F.min("first").alias("head"))
    numbers = running_totals(heads, "head", {"c": F.lit(1)}).select("head", F.col("c_before").alias("cluster"))
    labelled = cut_lineage(cores.join(roots.select("uid", "component"), "uid").join(heads, "component").join(numbers, "head")
                           .select("uid", "v", "block", "outer", "cluster"))

    # border points take the lowest cluster among the core points in reach
    def lowest(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if len(p) == 0 or len(q) == 0:
            return pd.DataFrame({"uid": [], "cluster": []})
        hit = nb.distances(nb.matrix(p), nb.matrix(q)) <= eps
        best = np.where(hit, q["cluster"].to_numpy()[None, :], np.iinfo(np.int64).max).min(axis=1)
        return pd.DataFrame({"uid": p["uid"], "cluster": best})[hit.any(axis=1)]

    rim = state.where("NOT core")
    open_rim = nb.paired(rim.select("uid", "v", "block"), labelled.select("v", "cluster", "block"), todo, lowest, "uid string, cluster long")
    by_block = labelled.groupBy(F.col("block").alias("b")).agg(F.min("cluster").alias("cluster"))
    by_outer = labelled.groupBy(F.col("outer").alias("outer_b")).agg(F.min("cluster").alias("cluster"))
    block_rim = rim.join(done.select(F.col("a").alias("block"), "b"), "block").join(by_block, "b").select("uid", "cluster")
    outer_rim = rim.join(wide_done.select(F.col("outer_a").alias("outer"), "outer_b"), "outer").join(by_outer, "outer_b").select("uid", "cluster")
    rims = open_rim.unionByName(block_rim).unionByName(outer_rim).groupBy("uid").agg(F.min("cluster").alias("cluster"))
    marks = labelled.select("uid", "cluster", F.lit(True).alias("is_core")).unionByName(rims.withColumn("is_core", F.lit(False)))
    rows = z.select(key, nb.point_key(columns).alias("uid")).join(marks, "uid", "left")
    return rows.select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))


def outlier_summary(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    noise = F.col(cluster) == -1
    return df.agg(F.count("*").alias("rows"), F.count_if(noise).alias("outliers"),
                  (F.count_if(noise) * 100.0 / F.count("*")).alias("outlier_pct"),
                  F.countDistinct(F.when(~noise, F.col(cluster))).alias("clusters"))


def profiles(df: DataFrame, columns: Sequence[str] = tuple(fv.MEASURES), cluster: str = "cluster",
             price: str = "upra_indice_total", rain: str = "ideam_precipitacion_anomalia") -> DataFrame:
    """Per cluster: exact medians, size and the risk they stand for."""
    data = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    rows = long_form(data, columns, [cluster])
    medians = exact_quantiles(rows, "value", {"median": 0.5}, [cluster, "feature"])
    wide = medians.groupBy(cluster).agg(F.max("n").alias("rows"), *[
        F.max(F.when(F.col("feature") == c, F.col("median"))).alias(c) for c in columns])
    line = exact_quantiles(data, price, {"line": 0.6}).select("line").scalar()
    dear = F.col(price) > line
    risk = (F.when(dear & (F.col(rain) < -20), "ALTA").when(dear, "MEDIA-ALTA").when(F.col(rain) > 20, "MEDIA").otherwise("BAJA"))
    name = (F.when(dear & (F.col(rain) < -20), "Precios altos con falta de lluvia").when(dear, "Presión de precios")
            .when(F.col(rain) > 20, "Exceso de lluvia").otherwise("Condiciones favorables"))
    return wide.withColumns({"risk": risk, "profile": name})


def assign(df: DataFrame, centres: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Nearest centre of each row (lowest cluster wins ties); one row per cluster in ``centres``."""
    every = centres.agg(F.collect_list(F.struct(F.col(cluster).alias("id"), F.array(*columns).alias("centre")))).scalar()
    point = F.array(*columns)
    df = df.withColumn("_every", every)
    ranked = F.transform("_every", lambda c: F.struct(
        F.aggregate(F.zip_with(point, c["centre"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x).alias("d2"),
        c["id"].alias("id")))
    out = df.withColumn("_best", F.array_min(ranked))
    return out.withColumns({cluster: F.col("_best")["id"], "distance": F.sqrt(F.col("_best")["d2"])}).drop("_every", "_best")


def periods(df: DataFrame, new: DataFrame, key: str, k: int, columns: Sequence[str] = tuple(fv.MEASURES), starts: int = 20,
            max_iter: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole path: (assigned new rows, profiles, quality).

    K-means groups the rows of ``df``; quality and profiles describe the groups; rows of ``new`` are scaled like
    ``df`` and get the nearest centre with the name and risk of its profile.
    """
    groups, _, _ = kmeans(df, key, k, columns, starts, max_iter)
    scaled = cut_lineage(nb.standardised(df, columns, [key]).join(groups, key))
    named = cut_lineage(profiles(df.join(groups, key), columns))
    centres = cut_lineage(scaled.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in columns]))
    nearest = assign(nb.standardised(new, columns, [key], like=df), centres, columns).select(key, "cluster", "distance")
    found = nearest.join(named.select("cluster", "profile", "risk"), "cluster")
    return found.select(key, "cluster", "distance", "profile", "risk"), named, quality(scaled, columns, exact=False)
