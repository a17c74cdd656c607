"""Exact Shapley values of forests and boosted trees, against a whole background."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramo.operators.boosting import Boosting, coded, filled
from paramo.operators.forest import Forest

#: Rows that a task takes at a time, of these the rows that are looked up side by side, and those whose masks are worked out side by side.
ROWS, EXPLAINED, TALLIED = 1 << 16, 1 << 13, 1 << 11
#: Cells of a group of leaves at most, and rows from which groups are worth their tables.
CELLS, MANY = 1 << 10, 1 << 14


@dataclass
class Group:
    """Neighbouring leaves of a tree that are looked up as one.

    Codes of a feature that the same conditions of these leaves let pass are one class, so a row's classes give its mask of every leaf.  ``at``
    are the classes' shares of the number of a cell by feature and code, ``sizes`` how many classes there are, and ``passes`` by leaf
    the features on the way, by their place in ``features``, and a bit for each class that passes."""

    leaves: range
    features: list[int]
    at: np.ndarray
    sizes: list[int]
    passes: list[list[tuple[int, int]]]

    @property
    def cells(self) -> int:
        return int(np.prod(self.sizes, dtype=np.int64))

    def cell(self, columns: np.ndarray) -> np.ndarray:
        """The cell of each row; ``columns`` are the codes by feature, as places."""
        out = np.zeros(columns.shape[1], np.intp)
        for f, at in zip(self.features, self.at):
            out += at.take(columns[f])
        return out

    def masks(self) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, the leaf's mask in each cell)."""
        strides = np.cumprod([1, *self.sizes])[:-1].tolist()
        every = np.arange(self.cells)
        classes = [(every // stride % n).astype(np.uint64) for stride, n in zip(strides, self.sizes)]
        for leaf, ways in zip(self.leaves, self.passes):
            mask = np.zeros(len(every), np.uint64)
            for i, (f, bits) in enumerate(ways):
                mask |= (np.uint64(bits) >> classes[f] & np.uint64(1)) << np.uint64(i)
            yield leaf, mask.astype(np.intp)


def grouped(ways: list[dict[int, np.ndarray]]) -> list[Group]:
    """Leaves, from the left, in groups of at most CELLS cells each (one leaf may have more)."""
    out: list[Group] = []
    first, signs, known = 0, {}, {}

    def close(end: int) -> None:
        at, sizes, passing, features = [], [], {}, sorted(signs)
        for f in features:
            found, number = np.unique(signs[f], return_inverse=True)
            at.append(number * int(np.prod(sizes, dtype=np.int64)))
            sizes.append(len(found))
            passing[f] = found.tolist()

        def bits(f: int, passes: np.ndarray) -> int:
            at_ = known[f, passes.tobytes()]
            return sum((sign >> at_ & 1) << i for i, sign in enumerate(passing[f]))

        out.append(Group(range(first, end), features, np.array(at, np.intp) if at else np.zeros((0, 1), np.intp), sizes,
                         [[(features.index(f), bits(f, ways[k][f])) for f in sorted(ways[k])] for k in range(first, end)]))

    for k, way in enumerate(ways):
        while True:
            more, names, bits = dict(signs), dict(known), {f: sum(1 for g, _ in known if g == f) for f in way}
            for f, passes in way.items():
                if (f, passes.tobytes()) not in names:
                    names[f, passes.tobytes()] = bits[f]
                    more[f] = more.get(f, np.zeros(len(passes), np.int64)) | passes.astype(np.int64) << bits[f]
            cells = 1
            for sign in more.values():
                cells *= len(set(sign.tolist()))
            if k == first or cells <= CELLS and max(bits.values(), default=0) < 60:
                signs, known = more, names
                break
            close(k)
            first, signs, known = k, {}, {}
    close(len(ways))
    return out


@dataclass
class Paths:
    """The leaves of one tree as conditions on features.

    A row's mask of a leaf has a bit for each feature on the way to it, set where the row's codes let it pass.  ``bits`` are
    the masks' parts by (feature, code, leaf); the masks of leaf i are numbered from ``start[i]`` in the tables of the model.
    """

    bits: np.ndarray
    features: list[np.ndarray]
    users: dict[int, np.ndarray]  # leaves with a condition on a feature
    value: np.ndarray
    start: np.ndarray
    groups: list[Group]

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """(rows, leaves): each row's mask of each leaf."""
        masks = np.zeros((len(codes), len(self.value)), self.bits.dtype)
        for f in self.users:
            masks |= self.bits[f].take(codes[:, f], axis=0)
        return masks

    def add(self, out: np.ndarray, given: np.ndarray, codes: np.ndarray) -> None:
        """Adds to ``out`` (features, rows) what the leaves give each row, by ``table``.

        A leaf's part of the table is short, so it is looked up for all rows before the next leaf's.  Of many rows, what the leaves of a group
        give is added up by cell first and looked up once, a stretch of rows at a time."""
        if len(codes) < MANY:
            by_leaf, found = np.ascontiguousarray(self.masks(codes).T), np.empty(len(codes))
            for k, features in enumerate(self.features):
                first, mask = int(self.start[k] - self.start[0]), by_leaf[k].astype(np.intp)
                for f in features.tolist():
                    out[f] += given[f, first:first + (1 << len(features))].take(mask, out=found, mode="clip")
            return
        columns, found = np.ascontiguousarray(codes.T).astype(np.intp), np.empty(min(EXPLAINED, len(codes)))
        for group in self.groups:
            sums: dict[int, np.ndarray] = {}
            for leaf, mask in group.masks():
                mask += int(self.start[leaf] - self.start[0])
                for f in self.features[leaf].tolist():
                    sums[f] = sums[f] + given[f].take(mask) if f in sums else given[f].take(mask)
            for at in range(0, len(codes) if sums else 0, EXPLAINED):
                cell = group.cell(columns[:, at:at + EXPLAINED])
                for f, each in sums.items():
                    out[f, at:at + EXPLAINED] += each.take(cell, out=found[:len(cell)], mode="clip")


def _leaves(feature: np.ndarray, code: np.ndarray, n_features: int, bins: int) -> Iterator[tuple[int, dict[int, np.ndarray]]]:
    """(node, {feature: codes that pass}) of each leaf, from the left."""
    todo: list[tuple[int, dict[int, np.ndarray]]] = [(0, {})]
    every = np.arange(bins)
    while todo:
        node, way = todo.pop()
        f = int(feature[node])
        if f < 0:
            yield node, way
            continue
        held = way.get(f, np.ones(bins, bool))
        todo.append((2 * node + 2, {**way, f: held & (every > code[node])}))
        todo.append((2 * node + 1, {**way, f: held & (every <= code[node])}))


def paths(model: Forest | Boosting, output: int) -> tuple[list[Paths], int]:
    """The trees of class ``output`` as paths, their values summing to the model's, and how many masks there are in all."""
    at = model.classes.index(output)
    if isinstance(model, Forest):
        trees = [(f, c, v[:, at] / len(model.feature)) for f, c, v in zip(model.feature, model.code, model.share)]
    else:
        trees = [(model.feature[r, at], model.code[r, at], model.value[r, at]) for r in range(len(model.feature))]
    n, bins, first, out = len(model.columns), max(len(e) for e in model.edges), 0, []
    for feature, code, value in trees:
        found = list(_leaves(feature, code, n, bins))
        narrow = max(len(way) for _, way in found) <= 8
        bits = np.zeros((n, bins, len(found)), np.uint8 if narrow else np.int32)
        names, start = [], []
        for k, (_, way) in enumerate(found):
            names.append(np.array(sorted(way), np.int64))
            for i, f in enumerate(names[-1]):
                bits[f, :, k] = way[int(f)].astype(bits.dtype) << i
            start.append(first)
            first += 1 << len(way)
        users = {f: np.array([k for k, (_, way) in enumerate(found) if f in way], np.int64) for f in range(n)}
        out.append(Paths(bits, names, {f: k for f, k in users.items() if len(k)}, value[[node for node, _ in found]], np.array(start, np.int64), grouped([way for _, way in found])))
    return out, first


@lru_cache(maxsize=None)
def kernel(d: int) -> np.ndarray:
    """(row's mask, background's mask, feature): what a leaf of value 1 on ``d`` features gives each of them.

    A set of features taken from the row, all others from the background, reaches the leaf if it has all features that only the
    row passes (a of them) and none that only the background passes (b), and if there is none that neither passes.  By the
    closed form one of the first gets (a-1)! b! / (a+b)!, one of the second loses a! (b-1)! / (a+b)!.
    """
    out = np.zeros((1 << d, 1 << d, d))
    for x in range(1 << d):
        for z in range(1 << d):
            if x | z != (1 << d) - 1:
                continue
            mine, theirs = x & ~z, z & ~x
            a, b = mine.bit_count(), theirs.bit_count()
            for j in range(d):
                if mine >> j & 1:
                    out[x, z, j] = factorial(a - 1) * factorial(b) / factorial(a + b)
                elif theirs >> j & 1:
                    out[x, z, j] = -factorial(a) * factorial(b - 1) / factorial(a + b)
    return out


def table(tree: Paths, share: np.ndarray, n_features: int) -> tuple[np.ndarray, int]:
    """(feature, mask) contributions of the leaves of a tree, and the number of its first mask; ``share`` is the part of the
    background that has each mask of the model."""
    first = int(tree.start[0])
    sizes = np.array([len(f) for f in tree.features])
    out = np.zeros((int(tree.start[-1]) + (1 << int(sizes[-1])) - first, n_features))
    for d in np.unique(sizes[sizes > 0]):
        which = np.nonzero(sizes == d)[0]
        rows = tree.start[which][:, None] + np.arange(1 << d)  # leaves of equal size side by side
        given = np.tensordot(share[rows] * tree.value[which][:, None], kernel(int(d)), (1, 1))  # (leaves, masks, d)
        columns = np.stack([tree.features[k] for k in which])
        out[rows[:, :, None] - first, columns[:, None, :]] = given
    return np.ascontiguousarray(out.T), first


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores is dealt out: a row is far less than the work on it."""
    width = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(width) if df.rdd.getNumPartitions() < width else df


def tallied(total: np.ndarray, trees: list[Paths], codes: np.ndarray, weights: np.ndarray) -> None:
    """Adds the weights of rows to ``total`` by mask of each leaf; many rows are counted by cell of a group of leaves, and cells by mask."""
    even = bool((weights == 1).all())
    if len(codes) < MANY:
        for at in range(0, len(codes), TALLIED):
            part, own = codes[at:at + TALLIED], weights[at:at + TALLIED]
            for tree in trees:
                first = int(tree.start[0])
                there = np.add(tree.masks(part), tree.start - first, dtype=np.int64).ravel()
                found = np.bincount(there) if even else np.bincount(there, weights=np.repeat(own, len(tree.value)))
                total[first:first + len(found)] += found
        return
    columns = np.ascontiguousarray(codes.T).astype(np.intp)
    for tree in trees:
        for group in tree.groups:
            held = np.zeros(group.cells)
            for at in range(0, len(codes), EXPLAINED):
                cell = group.cell(columns[:, at:at + EXPLAINED])
                held += np.bincount(cell, None if even else weights[at:at + EXPLAINED], len(held))
            for leaf, mask in group.masks():
                found = np.bincount(mask, held)
                total[tree.start[leaf]:tree.start[leaf] + len(found)] += found


def gathered_batches(batches, rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def background_masks(background: DataFrame, model: Forest | Boosting, trees: list[Paths], masks: int) -> np.ndarray:
    """The share of the background that has each mask of each leaf.

    A task adds its rows up by mask before anything is shuffled; what comes back has the size of the model's tables."""
    weight = F.col("weight").cast("double") if "weight" in background.columns else F.lit(1.0)
    held = background.sparkSession.sparkContext.broadcast((trees, model.edges))

    def run(batches):
        paths_, edges = held.value
        total, seen = np.zeros(masks), False
        for batch in gathered_batches(batches, ROWS):
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            tallied(total, paths_, coded(x, edges), batch.column("w").to_numpy(zero_copy_only=False))
            seen = True
        if seen:
            some = np.nonzero(total)[0]
            for at in range(0, len(some), 1 << 16):
                take = some[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(take), pa.array(total[take])], names=["mask", "w"])

    given = background.select(filled(model.columns).alias("x"), weight.alias("w")).where("w > 0")
    given = spread(given).mapInArrow(run, "mask long, w double")
    sums = given.groupBy("mask").agg(F.sum("w").alias("w")).toArrow()  # at most ``masks`` rows
    out = np.zeros(masks)
    out[sums["mask"].to_numpy()] = sums["w"].to_numpy()
    first = trees[0]
    total = out[first.start[0]:first.start[0] + (1 << len(first.features[0]))].sum()  # every row has one mask of a leaf
    if not total > 0:
        raise ValueError("an attribution needs a background of one row at least")
    return out / total


def tree_shapley(rows: DataFrame, background: DataFrame, key: str, model: Forest | Boosting, output: int = 2) -> DataFrame:
    """(key, feature, contribution): exact interventional Shapley values of the probability (forest) or the margin (boosted
    trees) of class ``output``.

    A row's contributions add up to its value less the mean of the background's, for any number of background rows; these may
    carry a ``weight`` (of at most 0 or null: left out).  Row and background meet in the leaves only.  The background is reduced
    to the share of its rows that pass a given set of the features on the way to each leaf.  From that the contributions of a
    leaf follow for each set a row can pass, in closed form.  So the work is (rows + background) x leaves, and the table of
    shares, which goes to every task, has at most leaves x 2^depth entries.  Null features count as 0, as in the model; rows
    that share a key have lines of their own; no rows give none.
    """
    trees, masks = paths(model, output)
    share = background_masks(background, model, trees, masks)
    held = rows.sparkSession.sparkContext.broadcast((trees, model.edges, share))
    n = len(model.columns)

    def run(batches):
        paths_, edges, share_ = held.value
        for batch in gathered_batches(batches, ROWS):
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes, out = coded(x, edges), np.zeros((n, batch.num_rows))
            for tree in paths_:
                given, _ = table(tree, share_, n)
                tree.add(out, given, codes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, n, dtype=np.int32)), pa.array(out.T.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_k"), lists], names=["_k", "_c"])

    asked = spread(rows.select(F.col(key).alias("_k"), filled(model.columns).alias("_x")))
    schema = asked.select("_k", F.array(F.lit(0.0)).alias("_c")).schema
    found = asked.mapInArrow(run, schema)
    names = F.array(*[F.struct(F.lit(c).alias("feature"), F.get("_c", F.lit(j)).alias("contribution")) for j, c in enumerate(model.columns)])
    return found.select(F.col("_k").alias(key), F.inline(names))
