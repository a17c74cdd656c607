"""Exact neighbour search by bounded blocks.

Equal points are collapsed into one weighted point first, so copies of one row never meet each
other.  The distinct points are laid out along a Z-order curve (each axis cut at approximate
quantiles, so a crowded region gets as many cells as it has points) and cut into blocks of a fixed
size.  Blocks carry their bounding box; about sqrt(m) consecutive blocks share an outer box.  Box
distances decide which pairs of blocks have to be looked at, first between outer boxes, then between
blocks, always by equi-joins.  One task compares at most two blocks and returns sums or the nearest
few, never all pairs.

``nearest`` lays its blocks out by a k-d tree instead, whose boxes are tighter, and compares a point only
with the blocks that its own reach touches.  ``near_lists`` does the same for tables whose neighbours, a row each, would fill disks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paramo.functions.ranks import running_totals, with_row
from paramo.session import cut_lineage, dropped, materialise

BLOCK = 1024


def standardised(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), like: DataFrame | None = None) -> DataFrame:
    """Mean 0 and population deviation 1 per column (nulls count as 0; a constant column stays 0), as measured
    on ``like`` if given."""
    fill = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    filled = df.select(*keep, *fill)
    with_stats = with_row(filled, "_stats", filled if like is None else like.select(*fill), **{f"m_{c}": F.avg(c) for c in columns},
                          **{f"s_{c}": F.stddev_pop(c) for c in columns})
    stats = F.col("_stats")
    return with_stats.withColumns({
        c: (F.col(c) - stats[f"m_{c}"]) / F.when(stats[f"s_{c}"] > 0, stats[f"s_{c}"]).otherwise(1.0) for c in columns}).drop("_stats")


def point_key(columns: Sequence[str]) -> Column:
    # adding 0.0 turns -0.0 into 0.0, so that equal points get equal keys
    return F.md5(F.concat_ws("|", *[(F.col(c) + F.lit(0.0)).cast("string") for c in columns]))


def distinct_points(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """(uid, v, w, first): distinct points with their count and lowest ``order`` value."""
    return df.groupBy(point_key(columns).alias("uid")).agg(
        F.first(F.array(*columns)).alias("v"), F.count("*").alias("w"), F.min(order).alias("first"))


def blocked(points: DataFrame, dims: int, size: int = BLOCK) -> DataFrame:
    """Add ``block``: runs of ``size`` points along the Z-order curve (the last run is longer)."""
    points = cut_lineage(points)
    bits = max(1, min(7, 62 // dims))
    probs = [i / 2 ** bits for i in range(1, 2 ** bits)]
    with_cuts = with_row(points, "_cuts", points, **{f"c{j}": F.percentile_approx(F.col("v")[j], probs, 1000) for j in range(dims)})
    cuts = F.col("_cuts")
    levels = {}
    for j in range(dims):
        x = F.col("v")[j]
        levels[f"_l{j}"] = F.size(F.filter(cuts[f"c{j}"], lambda c: c < x)).cast("long")
    # interleave the bits of the levels
    z = " | ".join(f"shiftleft(shiftright(_l{j}, {bit}) & 1L, {bit * dims + j})" for j in range(dims) for bit in range(bits))
    placed = cut_lineage(with_cuts.withColumns(levels).withColumn("z", F.expr(z)).drop("_cuts", *levels))
    starts = running_totals(placed, "z", {"n": F.lit(1)}).select("z", F.col("n_before").alias("_start"))
    inside = F.row_number().over(W.partitionBy("z").orderBy(F.col("v")[0], "uid")) - 1
    total = points.agg(F.count("*")).scalar()
    last = F.greatest(F.floor(total / size) - 1, F.lit(0))
    out = placed.join(starts, "z").withColumn(
        "block", F.least(F.floor((F.col("_start") + inside) / size), last)).drop("z", "_start")
    return cut_lineage(out)


def boxes(points: DataFrame, dims: int, **extra: Column) -> DataFrame:
    """(block, outer, lo, hi, w, ...): bounding box and weight per block."""
    count = points.agg(F.max("block")).first()[0]
    group = max(1, math.isqrt(int(count or 0)))
    out = points.groupBy("block").agg(
        F.array(*[F.min(F.col("v")[j]) for j in range(dims)]).alias("lo"),
        F.array(*[F.max(F.col("v")[j]) for j in range(dims)]).alias("hi"),
        F.sum("w").alias("w"), *[c.alias(n) for n, c in extra.items()])
    return cut_lineage(out.withColumn("outer", F.floor(F.col("block") / group)))


def outer_boxes(inner: DataFrame, dims: int, **extra: Column) -> DataFrame:
    return inner.groupBy("outer").agg(
        F.array(*[F.min(F.col("lo")[j]) for j in range(dims)]).alias("lo"),
        F.array(*[F.max(F.col("hi")[j]) for j in range(dims)]).alias("hi"),
        F.sum("w").alias("w"), *[c.alias(n) for n, c in extra.items()])


def _norm(parts: Column) -> Column:
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x * x))


def least_distance(lo_a, hi_a, lo_b, hi_b) -> Column:
    gaps = F.zip_with(F.zip_with(lo_b, hi_a, lambda x, y: x - y), F.zip_with(lo_a, hi_b, lambda x, y: x - y),
                      lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return _norm(gaps)


def most_distance(lo_a, hi_a, lo_b, hi_b) -> Column:
    spans = F.zip_with(F.zip_with(hi_b, lo_a, lambda x, y: F.abs(x - y)), F.zip_with(hi_a, lo_b, lambda x, y: F.abs(x - y)),
                       lambda x, y: F.greatest(x, y))
    return _norm(spans)


def outer_pairs(outer: DataFrame, reach: Column) -> DataFrame:
    """Pairs of outer boxes no further apart than ``reach``.

    There are about sqrt(m) outer boxes for m blocks, so their list is small and the pairs number at most m."""
    outer = outer.withColumn("_every", outer.agg(F.collect_list(F.struct("outer", "lo", "hi", "w"))).scalar())
    near = F.filter("_every", lambda b: least_distance(F.col("lo"), F.col("hi"), b["lo"], b["hi"]) <= reach)
    pairs = outer.select(F.col("outer").alias("outer_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.explode(near).alias("b"))
    return pairs.select("outer_a", F.col("b.outer").alias("outer_b"), F.col("b.w").alias("w_b"),
                        most_distance(F.col("lo_a"), F.col("hi_a"), F.col("b.lo"), F.col("b.hi")).alias("most"))


def block_pairs(inner: DataFrame, pairs: DataFrame, reach: str) -> DataFrame:
    """Pairs of blocks below the given outer pairs and no further apart than block a's ``reach``."""
    a = inner.select(F.col("outer").alias("outer_a"), F.col("block").alias("a"), F.col("lo").alias("lo_a"),
                     F.col("hi").alias("hi_a"), F.col(reach).alias("_reach"))
    b = inner.select(F.col("outer").alias("outer_b"), F.col("block").alias("b"), F.col("lo").alias("lo_b"),
                     F.col("hi").alias("hi_b"), F.col("w").alias("w_b"))
    box = [F.col(c) for c in ("lo_a", "hi_a", "lo_b", "hi_b")]
    return (pairs.select("outer_a", "outer_b").join(a, "outer_a").join(b, "outer_b")
            .where(least_distance(*box) <= F.col("_reach"))
            .select("a", "b", "w_b", most_distance(*box).alias("most")))


def matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["v"].tolist(), dtype=float)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, axis by axis (no cancellation from the expanded square)."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - y[None, :, j]) ** 2
    return np.sqrt(out)


def paired(left: DataFrame, right: DataFrame, pairs: DataFrame, fn, schema: str) -> DataFrame:
    """Run ``fn(points of a, points of b)`` for every pair of blocks; a task holds one pair."""
    keys = pairs.select("a", "b")
    def side(df: DataFrame, name: str) -> DataFrame:
        # new column identities: both sides may come from the same points
        return df.select(*[F.col(c).alias(name if c == "block" else c) for c in df.columns]).join(
            keys.select(F.col("a").alias("a"), F.col("b").alias("b")), name)

    x, y = side(left, "a"), side(right, "b")

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = fn(p, q)
        # an empty frame has float columns, which cannot be handed back as text
        return out if len(out) else out.astype(object)

    return x.groupBy("a", "b").cogroup(y.groupBy("a", "b")).applyInPandas(run, schema)


#: Points of the sample that lays out the blocks of ``nearest``: so many for each block, and so many at most.
LEAF, SAMPLE = 64, 1 << 17
#: Points that ask a block in one task, in blocks.
ASKING = 16


def split_tree(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(axis, cut, low child) of the nodes of a k-d tree whose leaves hold at most ``most`` rows; axis -1 and the number of the leaf at leaves.

    A node is cut near the median of its widest axis that parts it well; the high child follows the low one."""
    axis, cut, low = [-1], [0.0], [0]
    todo, leaves = [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        best = (0.0, -1, 0.0)
        if len(rows) > most:
            part = x[rows]
            for j in np.argsort(-part.std(axis=0), kind="stable"):
                v = np.sort(part[:, j])
                middle = v[(len(v) - 1) // 2]
                below = np.searchsorted(v, middle, "left")
                for n_low, at in ((np.searchsorted(v, middle, "right"), middle), (below, v[below - 1] if below else middle)):
                    if (share := min(n_low, len(v) - n_low) / len(v)) > best[0]:
                        best = (share, int(j), float(at))
                if best[0] >= 0.25:
                    break
        if best[1] < 0:
            low[node] = leaves
            leaves += 1
            continue
        axis[node], cut[node], low[node] = best[1], best[2], len(axis)
        goes_low = x[rows, best[1]] <= best[2]
        todo += [(len(axis) + 1, rows[~goes_low]), (len(axis), rows[goes_low])]
        axis += [-1, -1]
        cut += [0.0, 0.0]
        low += [0, 0]
    return np.array(axis), np.array(cut), np.array(low)


def leaf_of(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    axis, cut, low = tree
    node = np.zeros(len(x), np.int64)
    open_ = np.arange(len(x))
    while len(open_ := open_[axis[node[open_]] >= 0]):
        at = node[open_]
        node[open_] = low[at] + ~(x[open_, axis[at]] <= cut[at])
    return low[node]


def laid_out(points: DataFrame, dims: int, size: int, written: bool = False) -> DataFrame:
    """Add ``block``: the leaf of a k-d tree of ``size`` points a leaf, about; points that are ``written`` are not written again.

    The tree comes from a sample by hash of the points, which is all the driver sees; every point goes down the tree, so the
    sample decides the shape of the blocks and nothing else."""
    points = points if written else cut_lineage(points)
    n = points.count()
    blocks = max(1, -(-n // size))
    wanted = min(n, LEAF * blocks, SAMPLE)
    span = 2 ** 32
    some = points.where(F.pmod(F.xxhash64("uid"), F.lit(span)) < int(span * wanted / max(n, 1))).select("v") if blocks > 1 else points.select("v").limit(0)
    sample = some.toArrow().column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    tree = split_tree(sample, max(1, -(-len(sample) // blocks)))
    held = points.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf("long")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(leaf_of(np.stack(v.to_numpy()), held.value) if len(v) else [], dtype="int64")

    placed = points.withColumn("block", place("v"))
    return placed if written else cut_lineage(placed)


def outside(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Distances of points (rows) from boxes; summed axis by axis as ``distances`` does, so never more than the distance of a point in the box."""
    out = np.zeros((len(x), len(lo)))
    for j in range(x.shape[1]):
        out += np.maximum(np.maximum(lo[None, :, j] - x[:, j, None], x[:, j, None] - hi[None, :, j]), 0) ** 2
    return np.sqrt(out)


def nearest(points: DataFrame, dims: int, k: int, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The k nearest other rows of every distinct point, copies counted.

    Returns the blocked points, with the blocks each ``asks``, and (uid, other, dist, take): ``take`` copies of ``other`` belong to the
    k nearest.  Ties in distance go to the lower uid.

    The k-th distance within a point's own block is its reach.  A point asks the blocks whose bounding box lies within its reach and no
    others, so a point of a crowded region asks few.  The boxes (two vectors a block, at most SAMPLE * 2 / LEAF blocks or so) go to
    every task.  A task answers the points that ask one block, ``ASKING`` blocks' worth of them at most, about.
    """
    size = max(size, k + 1)
    pts = laid_out(points, dims, size)
    sides = [f(F.col("v")[j]).alias(f"{name}{j}") for name, f in (("lo", F.min), ("hi", F.max)) for j in range(dims)]
    boxes_ = pts.groupBy("block").agg(*sides).toPandas()
    sides_ = boxes_[[f"lo{j}" for j in range(dims)]].to_numpy(float), boxes_[[f"hi{j}" for j in range(dims)]].to_numpy(float)
    held = pts.sparkSession.sparkContext.broadcast((boxes_["block"].to_numpy(), *sides_))

    def asking(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w, own = matrix(pdf), pdf["w"].to_numpy(), int(pdf["block"].iloc[0])
        names, lo, hi = held.value
        few = min(k + 1, len(x))
        reach, asks = np.empty(len(x)), []
        for at in range(0, len(x), size):
            part = np.arange(at, min(at + size, len(x)))
            d = distances(x[part], x)
            near = np.argpartition(d, few - 1, axis=1)[:, :few]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)
            enough = np.cumsum(w[near] - (near == part[:, None]), axis=1) >= k
            hit = near[np.arange(len(part)), enough.argmax(axis=1)]
            reach[part] = np.where(enough.any(axis=1), d[np.arange(len(part)), hit], np.inf)
        # boxes that some point may ask, then each point's own
        widest = np.nanmax(reach) if (~np.isnan(reach)).any() else -1.0
        gaps = np.zeros(len(names))
        for j in range(dims):
            gaps += np.maximum(np.maximum(lo[:, j] - x[:, j].max(), x[:, j].min() - hi[:, j]), 0) ** 2
        maybe = np.flatnonzero((np.sqrt(gaps) <= widest) & (names != own))
        step = max(1, (1 << 20) // max(1, len(maybe)))
        for at in range(0, len(x), step):
            hits = outside(x[at:at + step], lo[maybe], hi[maybe]) <= reach[at:at + step, None]
            asks += [[own, *names[maybe[h]].tolist()] for h in hits]
        return pdf.assign(reach=reach, asks=asks)

    pts = cut_lineage(pts.groupBy("block").applyInPandas(
        asking, "uid string, v array<double>, w long, first long, block long, reach double, asks array<long>"))
    asked = pts.select("uid", "v", "reach", F.explode("asks").alias("b"))
    shares = asked.groupBy("b").agg(F.ceil(F.count("*") / (ASKING * size)).alias("shares"))
    asked = asked.join(shares, "b").withColumn("share", F.pmod(F.xxhash64("uid"), "shares")).drop("shares")
    # new column identities: both sides come from the same points
    offered = pts.select(*[F.col(c).alias(c) for c in ("uid", "v", "w")], F.col("block").alias("b")).join(shares, "b").withColumn(
        "share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")

    def best(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        # rows in order of uid, so that the place of a row decides between equal distances
        q = q.sort_values("uid", kind="stable")
        y, other, w = matrix(q), q["uid"].to_numpy(), q["w"].to_numpy()
        x, uid, reach = matrix(p), p["uid"].to_numpy(), p["reach"].to_numpy()
        out = []
        for at in range(0, len(p), size):
            d = distances(x[at:at + size], y)
            i, j = np.nonzero(d <= reach[at:at + size, None])
            dist = d[i, j]
            order = np.lexsort((j, dist, i))
            i, j, dist = i[order], j[order], dist[order]
            weight = w[j] - (other[j] == uid[at + i])
            before = np.cumsum(weight) - weight
            first = np.searchsorted(i, i, "left")
            good = (before - before[first] < k) & (weight > 0)
            out.append((uid[at + i[good]], other[j[good]], dist[good], weight[good]))
        found = [np.concatenate(c) for c in zip(*out)] if out else [[], [], [], []]
        frame = pd.DataFrame(dict(zip(("uid", "other", "dist", "w"), found)))
        return frame if len(frame) else frame.astype(object)

    found = asked.groupBy("b", "share").cogroup(offered.groupBy("b", "share")).applyInPandas(
        best, "uid string, other string, dist double, w long")
    before = F.coalesce(F.sum("w").over(W.partitionBy("uid").orderBy("dist", "other").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = found.withColumn("_before", before).where(F.col("_before") < k)
    return pts, cut_lineage(ranked.select("uid", "other", "dist", F.least(F.col("w"), k - F.col("_before")).alias("take")))


#: Points of a leaf of a block, and of a block at most: larger blocks have fewer points near their sides, but are no task's whole work.
LEAF_POINTS, BLOCK_POINTS = 256, 1 << 15
#: A point whose ball touches more leaves of a foreign block than this looks for its nearest there before it names any.
TOUCHED = 16
#: Relative error that squared distances by products of vectors may have, amply; such distances only choose candidates.
LOOSE = 1e-12


@dataclass
class Points:
    """The points of a block in the order of its leaves: coordinates, copies and names, and where the leaves end."""

    x: np.ndarray
    w: np.ndarray
    uid: np.ndarray  # (points, 2), big-endian words
    ends: np.ndarray

    @classmethod
    def read(cls, row, dims: int) -> Points:
        return cls(np.frombuffer(row["x"], float).reshape(dims, -1).T, np.frombuffer(row["w"], np.int64), np.frombuffer(row["uid"], ">u8").reshape(-1, 2),
                   np.frombuffer(row["ends"], np.int64) if "ends" in row else np.zeros(0, np.int64))

    def leaves(self) -> list[np.ndarray]:
        return [np.arange(a, b) for a, b in zip([0, *self.ends[:-1].tolist()], self.ends.tolist())]

    def taken(self, rows: np.ndarray) -> dict:
        return {"x": np.ascontiguousarray(self.x[rows].T).tobytes(), "w": self.w[rows].tobytes(), "uid": self.uid[rows].tobytes()}


def squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(squared distances, how far they may be off)."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = x @ (-2 * y.T)
    out += xx[:, None]
    out += yy[None, :]
    return out, LOOSE * float(max(xx.max(initial=0), yy.max(initial=0)))


def box_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.min(axis=0), x.max(axis=0)


def gaps(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray) -> np.ndarray:
    """Distances of a box from many."""
    return np.sqrt((np.maximum(np.maximum(los - hi, lo - his), 0) ** 2).sum(axis=1)) * (1 - 1e-9)


def own_reach(p: Points, k: int) -> np.ndarray:
    """A distance for each point within which there are k others of its block; without end where the block has fewer."""
    leaves = p.leaves()
    sides = [box_of(p.x[rows]) for rows in leaves]
    los, his = np.array([s[0] for s in sides]), np.array([s[1] for s in sides])
    out = np.empty(len(p.x))
    for at, rows in enumerate(leaves):
        away = gaps(*sides[at], los, his)
        away[at] = -1
        order = np.argsort(away, kind="stable")
        best, reach, done, step = np.full((len(rows), k), np.inf), np.inf, 0, 1
        while done < len(order) and away[order[done]] <= reach:
            others = np.concatenate([leaves[i] for i in order[done:done + step].tolist()])
            d, off = squares(p.x[rows], p.x[others])
            d += off
            if not done:
                np.fill_diagonal(d, np.inf)  # a point is no neighbour of itself; its copies are told apart later
            both = np.concatenate([best, d], axis=1)
            best = np.partition(both, k - 1, axis=1)[:, :k]
            reach = np.sqrt(np.maximum(best[:, -1].max(), 0))
            done, step = done + step, 8
        out[rows] = np.sqrt(np.maximum(best[:, -1], 0)) * (1 + 1e-9)
    return out


def wanted_of(p: Points, x: np.ndarray, reach: np.ndarray, k: int) -> np.ndarray:
    """Places of the points of a block that are within the reach of any of the given foreign ones, or, where that is far, among its k nearest."""
    leaves = p.leaves()
    sides = [box_of(p.x[rows]) for rows in leaves]
    los, his = np.array([s[0] for s in sides]), np.array([s[1] for s in sides])
    hit = np.zeros(len(p.x), bool)
    step = max(1, (1 << 21) // len(leaves))
    for at in range(0, len(x), step):
        q, r = x[at:at + step], reach[at:at + step].copy()
        touched = outside(q, los, his) <= r[:, None]
        wide = np.flatnonzero(touched.sum(axis=1) > TOUCHED)
        for some in range(0, len(wide), 64) if len(p.x) > k else ():
            w = wide[some:some + 64]
            d, off = squares(q[w], p.x)
            r[w] = np.minimum(r[w], np.sqrt(np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1] + off, 0)) * (1 + 1e-9))
            touched[w] = outside(q[w], los, his) <= r[w, None]
        for j, rows in enumerate(leaves):
            ask, open_ = np.flatnonzero(touched[:, j]), rows[~hit[rows]]
            for some in range(0, len(ask), 4096):
                if not len(open_):
                    break
                d, off = squares(q[ask[some:some + 4096]], p.x[open_])
                found = (d <= (r[ask[some:some + 4096]] ** 2)[:, None] + 2 * off).any(axis=0)
                hit[open_[found]] = True
                open_ = open_[~found]
    return np.flatnonzero(hit)


def lists_of(p: Points, reach: np.ndarray, halo: Points, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(count, place, distance, copies) of the k nearest rows of each point, nearest first, equal distances in order of the names.

    Places from len(p.x) on are those of the ``halo``; ``reach`` is no less than the distance of the k-th."""
    n, leaves = len(p.x), p.leaves()
    x, w, uid = np.concatenate([p.x, halo.x]), np.concatenate([p.w, halo.w]), np.concatenate([p.uid, halo.uid])
    rank = np.empty(len(x), np.int64)
    rank[np.lexsort((uid[:, 1], uid[:, 0]))] = np.arange(len(x))
    sides = [box_of(p.x[rows]) for rows in leaves]
    los, his = np.array([s[0] for s in sides]), np.array([s[1] for s in sides])
    each, counts = [], np.zeros(n, np.int64)
    for at, rows in enumerate(leaves):
        r = reach[rows]
        if np.isnan(r).any():
            r = np.where(np.isnan(r), -1.0, r)
        widest = r.max()
        lo, hi = sides[at]
        near = np.concatenate([leaves[i] for i in np.flatnonzero(gaps(lo, hi, los, his) <= widest).tolist()] or [rows[:0]])
        if len(halo.x):
            beside = np.sqrt((np.maximum(np.maximum(lo - halo.x, halo.x - hi), 0) ** 2).sum(axis=1)) * (1 - 1e-9) <= widest
            near = np.concatenate([near, n + np.flatnonzero(beside)])
        for some in range(0, len(rows), step := max(1, (1 << 22) // max(1, len(near)))):
            part = rows[some:some + step]
            d, off = squares(p.x[part], x[near])
            i, j = np.nonzero(d <= (r[some:some + step] ** 2 * (1 + 1e-9))[:, None] + 2 * off)
            j = near[j]
            dist = np.zeros(len(i))
            for axis in range(x.shape[1]):
                dist += (p.x[part[i], axis] - x[j, axis]) ** 2
            dist = np.sqrt(dist)
            order = np.lexsort((rank[j], dist, i))
            i, j, dist = i[order], j[order], dist[order]
            copies = w[j] - (j == part[i])
            before = np.cumsum(copies) - copies
            before -= before[np.searchsorted(i, i, "left")] if len(i) else 0
            good = (before < k) & (copies > 0)
            counts[part] = np.bincount(i[good], minlength=len(part))
            each.append((j[good], dist[good], np.minimum(copies, k - before)[good]))
    return counts, *[np.concatenate(c) for c in zip(*each)]


def near_lists(points: DataFrame, dims: int, k: int, size: int = BLOCK) -> DataFrame:
    """The k nearest other rows of every distinct point, copies counted, as one record for each block of points.

    The answer is that of ``nearest``; (block, uid, w, count, place, dist, take, kdist, wants) hold it as bytes, as a row for each neighbour takes
    ten times the room.  ``kdist`` is the distance of the last.  A neighbour's place is that of a point of the block or, after those, of the points of other blocks that the block
    ``wants``: (their block, their places) one after another.

    Blocks are leaves of a k-d tree.  A point asks those whose box its ball touches, where the ball holds k others of its own block.  What an
    asked block sends back are the points that any of the asking ones may need, each once."""
    spark = points.sparkSession
    points = materialise(points.select("uid", "v", "w"))
    cores = spark.sparkContext.defaultParallelism
    n = points.count()
    size = max(size, k + 1, min(BLOCK_POINTS, n // (4 * cores)))
    placed = laid_out(points, dims, size, written=True)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable")
        x = matrix(pdf)
        leaf = leaf_of(x, split_tree(x, max(k + 1, LEAF_POINTS)))
        order = np.argsort(leaf, kind="stable")
        p = Points(x[order], pdf["w"].to_numpy(np.int64)[order], np.frombuffer(bytes.fromhex("".join(pdf["uid"])), ">u8").reshape(-1, 2)[order],
                   np.cumsum(np.bincount(leaf)).astype(np.int64))
        lo, hi = box_of(p.x)
        return pd.DataFrame([{"block": int(pdf["block"].iloc[0]), **p.taken(np.arange(len(x))), "ends": p.ends.tobytes(), "reach": own_reach(p, k).tobytes(),
                              "lo": lo, "hi": hi}])

    packed = materialise(placed.groupBy("block").applyInPandas(
        pack, "block long, x binary, w binary, uid binary, ends binary, reach binary, lo array<double>, hi array<double>"))
    boxes_ = packed.select("block", "lo", "hi").toPandas()  # two vectors a block
    held = spark.sparkContext.broadcast((boxes_["block"].to_numpy(np.int64), np.array(boxes_["lo"].tolist(), float).reshape(-1, dims), np.array(boxes_["hi"].tolist(), float).reshape(-1, dims)))

    def ask(frames):
        names, los, his = held.value
        for row in (r for f in frames for r in f.to_dict("records")):
            p, reach, found = Points.read(row, dims), np.frombuffer(row["reach"], float), {}
            for rows in p.leaves():
                maybe = np.flatnonzero((gaps(*box_of(p.x[rows]), los, his) <= np.nanmax(reach[rows], initial=-1.0)) & (names != row["block"]))
                touched = outside(p.x[rows], los[maybe], his[maybe]) <= reach[rows, None]
                for j in np.flatnonzero(touched.any(axis=0)).tolist():
                    found.setdefault(int(names[maybe[j]]), []).append(rows[touched[:, j]])
            out = []
            for b, rows in found.items():
                # half as long, and the reach longer by what that moves a point
                rows = np.concatenate(rows)
                short = p.x[rows].astype(np.float32)
                longer = (reach[rows] + np.sqrt(((p.x[rows] - short) ** 2).sum(axis=1))) * (1 + 1e-6)
                out.append({"block": b, "origin": row["block"], "x": np.ascontiguousarray(short.T).tobytes(), "reach": longer.astype(np.float32).tobytes()})
            if out:
                yield pd.DataFrame(out)

    asked = packed.select("block", "x", "w", "uid", "ends", "reach").mapInPandas(ask, "block long, origin long, x binary, reach binary")

    def answer(own: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(questions):
            p = Points.read(own.iloc[0], dims)
            for q in questions.to_dict("records"):
                places = wanted_of(p, np.frombuffer(q["x"], np.float32).reshape(dims, -1).T.astype(float), np.frombuffer(q["reach"], np.float32).astype(float), k)
                if len(places):
                    out.append({"block": q["origin"], "origin": own.iloc[0]["block"], "places": places.astype(np.int32).tobytes(), **p.taken(places)})
        return pd.DataFrame(out, columns=["block", "origin", "places", "x", "w", "uid"])

    halo_type = "block long, origin long, places binary, x binary, w binary, uid binary"
    halos = materialise(packed.select("block", "x", "w", "uid", "ends").groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(answer, halo_type))

    def lists(own: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        p, sent = Points.read(own.iloc[0], dims), sent.sort_values("origin").to_dict("records")
        parts = [Points.read(s, dims) for s in sent]
        none = np.zeros(0)
        halo = Points(*[np.concatenate([getattr(h, f) for h in [Points(p.x[:0], p.w[:0], p.uid[:0], none), *parts]]) for f in ("x", "w", "uid")], none)
        counts, place, dist, take = lists_of(p, np.frombuffer(own.iloc[0]["reach"], float), halo, k)
        # the foreign points that are among the nearest of some point, numbered anew
        used = np.unique(place[place >= len(p.x)])
        place = np.where(place < len(p.x), place, len(p.x) + np.searchsorted(used, place))
        wants, first = [], len(p.x)
        for s, h in zip(sent, parts):
            mine = used[(used >= first) & (used < first + len(h.x))] - first
            if len(mine):
                wants.append({"origin": s["origin"], "places": np.frombuffer(s["places"], np.int32)[mine].tobytes()})
            first += len(h.x)
        return pd.DataFrame([{"block": own.iloc[0]["block"], "uid": own.iloc[0]["uid"], "w": own.iloc[0]["w"], "count": counts.astype(np.int32).tobytes(),
                              "place": place.astype(np.int32).tobytes(), "dist": dist.tobytes(), "take": take.astype(np.int32).tobytes(),
                              "kdist": np.where(counts > 0, np.append(dist, np.nan)[np.cumsum(counts) - 1], np.nan).tobytes(), "wants": wants}])

    out = materialise(packed.select("block", "x", "w", "uid", "ends", "reach").groupBy("block").cogroup(halos.groupBy("block")).applyInPandas(
        lists, "block long, uid binary, w binary, count binary, place binary, dist binary, take binary, kdist binary, wants array<struct<origin: bigint, places: binary>>"))
    for table in (points, packed, halos):
        dropped(table)
    return out


def with_values(lists: DataFrame, values: DataFrame, fn, schema: str) -> DataFrame:
    """Run ``fn(record of a block, values of its points and of those it wants)`` for each block; ``values`` has (block, value, own) as bytes: a
    number for each point, and what the block itself gets in their place."""
    wants = lists.select(F.col("block").alias("asker"), F.inline("wants"))

    def answer(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        known = np.frombuffer(own.iloc[0]["value"], float)
        return pd.DataFrame({"block": asked["asker"], "origin": asked["origin"], "got": [known[np.frombuffer(p, np.int32)].tobytes() for p in asked["places"]]},
                            columns=["block", "origin", "got"])

    origin = values.select(F.col("block").alias("origin"), "value")
    sent = origin.groupBy("origin").cogroup(wants.groupBy("origin")).applyInPandas(answer, "block long, origin long, got binary")
    # a block's own values come first, those it wants in the order of its list
    sent = sent.unionByName(values.select("block", F.lit(-1).cast("long").alias("origin"), F.col("own").alias("got")))

    def run(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        return fn(own.iloc[0], np.concatenate([np.frombuffer(g, float) for g in got.sort_values("origin")["got"]]))

    return lists.drop("wants").groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(run, schema)


#: A node with over 1/HUBS of all edge ends is a hub; there are at most HUBS of them.
HUBS = 1000


def _beside(edges: DataFrame, low: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Every edge (u, v) with m, the least neighbour of u.

    Edges at a hub meet a broadcast list of at most HUBS rows, all others a shuffled join, so no
    task receives all edges of one node."""
    if hubs is None:
        return edges.join(low, "u")
    marked = edges.join(F.broadcast(hubs), "u", "left")
    return marked.where("hub IS NOT NULL").select("u", "v", F.col("hub").alias("m")).unionByName(
        marked.where("hub IS NULL").select("u", "v").join(low, "u"))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the least node of each connected component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round is two groupings
    by node, and the number of rounds grows with the logarithm of the graph.  Rounds end when the
    set of edges, compared by count and hash sums, stays as it was.
    """
    now = cut_lineage(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct())
    nodes = now.select(F.col("u").alias("node")).unionByName(now.select(F.col("v").alias("node"))).distinct()

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()

    was = state(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("ends")))
        hubs = stars.where(F.col("ends") > 2 * was[0] / HUBS).select("u", F.col("m").alias("hub"))
        # below this many edges a shuffled join has no large partition
        large = _beside(both.where("v > u"), stars.select("u", "m"), hubs if was[0] > 100 * HUBS else None)
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        # every u here is the larger end, and the large star has left it few smaller neighbours
        small = (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = cut_lineage(small)
        if (after := state(now)) == was:
            break
        was = after
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
