"""Embedding near-duplicates by spherical-cap filters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramo.functions.neighbours import components
from paramo.llm.simhash import Forest
from paramo.session import cut_lineage, materialise

#: Parts of a filter direction, each from a random block code of its own, and independent product codes.
PARTS, CODES = 2, 4
#: Filters of each code that a vector exceeds on average, and how many nearest ones it takes at least.  How many a
#: product code gives a vector varies much; several codes and the nearest filters even that out.
PER_CODE, NEAREST = 5, 3
#: Least number of filters of a code; there are more if there are many vectors.
FILTERS = 1024
#: Rows of a bucket that are compared at once, and rows that one task group takes.
TILE, GROUP = 1024, 8192
#: Fewer dimensions are padded with zeros, so that projections spread alike.
LEAST_DIMS = 24


@dataclass
class Code:
    """A random rotation, PARTS block codes of unit vectors, and the least sum of block products."""

    rotation: np.ndarray
    blocks: list[np.ndarray]
    least: float

    def products(self, x: np.ndarray) -> list[np.ndarray]:
        padded = np.zeros((len(x), len(self.rotation)))
        padded[:, :x.shape[1]] = x
        parts = np.split(padded @ self.rotation, len(self.blocks), axis=1)
        return [p @ b.T for p, b in zip(parts, self.blocks)]

    def exceeded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter direction that a unit vector exceeds, and of its NEAREST nearest ones.

        List decoding block by block: a prefix is followed only while the best that later blocks can add
        may still reach the threshold."""
        products = self.products(x)
        best = [p.max(axis=1) for p in products]
        rest = np.cumsum([np.zeros(len(x)), *best[::-1]], axis=0)[::-1]
        # the nearest filters are made of the nearest words of each block
        near = np.zeros((len(x), 1))
        for p in products:
            top = np.partition(p, -min(NEAREST, p.shape[1]), axis=1)[:, -NEAREST:]
            near = (near[:, :, None] + top[:, None, :]).reshape(len(x), -1)
        near = np.partition(near, -min(NEAREST, near.shape[1]), axis=1)[:, -min(NEAREST, near.shape[1])]
        rows, code, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        least = np.minimum(self.least, near - 1e-12)
        for k, p in enumerate(products):
            sums = total[:, None] + p[rows]
            i, c = np.nonzero(sums + rest[k + 1][rows][:, None] >= least[rows][:, None])
            rows, code, total = rows[i], code[i] * p.shape[1] + c, sums[i, c]
        return rows, code


def random_code(dims: int, filters: int, per_vector: float, seed: int) -> Code:
    """A code of at least ``filters`` directions of which a random vector exceeds ``per_vector`` on average."""
    size = -(-max(dims, LEAST_DIMS) // PARTS) * PARTS
    rng = np.random.default_rng([seed, size])
    rotation, _ = np.linalg.qr(rng.normal(size=(size, size)))
    width = int(np.ceil(filters ** (1 / PARTS) - 1e-9))
    blocks = []
    for _ in range(PARTS):
        b = rng.normal(size=(width, size // PARTS))
        blocks.append(b / np.linalg.norm(b, axis=1, keepdims=True))
    code = Code(rotation, blocks, 0.0)
    trial = rng.normal(size=(200, size))
    trial /= np.linalg.norm(trial, axis=1, keepdims=True)
    low, high = 0.0, float(PARTS)
    for _ in range(30):
        code.least = (low + high) / 2
        low, high = (code.least, high) if beyond(code, trial) > per_vector * len(trial) else (low, code.least)
    return code


def beyond(code: Code, x: np.ndarray) -> int:
    """How many sums of block products reach the threshold, over all rows."""
    total = np.zeros((len(x), 1))
    for p in code.products(x):
        total = (total[:, :, None] + p[:, None, :]).reshape(len(x), -1)
    return int((total >= code.least).sum())


def unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """A vector without nulls, NaN and infinities that is not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def postings(classes: DataFrame, codes: dict[int, list[Code]]) -> DataFrame:
    """(label, filter, key, w, v, filters): one row per class of equal vectors and filter it exceeds.

    Filters of several codes are numbered one after another."""
    label_type = classes.schema["label"].dataType.simpleString()
    item = classes.schema["v"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sizes = part.column("dims").to_numpy()
                for d in np.unique(sizes):
                    rows = np.nonzero(sizes == d)[0]
                    own = part.take(pa.array(rows))
                    x = unit(own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                    of, found, first = [], [], 0
                    for code in codes[int(d)]:
                        rows_, filters = code.exceeded(x)
                        of.append(rows_)
                        found.append(filters + first)
                        first += int(np.prod([len(b) for b in code.blocks]))
                    of, found = np.concatenate(of), np.concatenate(found)
                    order = np.lexsort((found, of))
                    of, found = of[order], found[order]
                    counts = np.bincount(of, minlength=len(rows))
                    lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), pa.array(found))
                    at_row = pa.array(of)
                    out = own.take(at_row)
                    yield pa.RecordBatch.from_arrays(
                        [out.column("label"), out.column("dims"), pa.array(found), out.column("key"), out.column("w"), out.column("v"),
                         lists.take(at_row)], names=["label", "dims", "filter", "key", "w", "v", "filters"])

    return classes.select("label", "dims", "key", "w", "v").mapInArrow(
        run, f"label {label_type}, dims int, filter long, key string, w long, v {item}, filters array<long>")


def first_meeting(filters: list[np.ndarray], here: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of rows of the bucket ``here``: whether they share no filter below it."""
    rows = np.unique(np.concatenate([a, b]))
    local = {r: i for i, r in enumerate(rows.tolist())}
    below = [filters[r][filters[r] < here] for r in rows.tolist()]
    flat = np.concatenate(below) if below else np.zeros(0, np.int64)
    known, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # columns only for filters that two rows have
    held = np.zeros((len(rows), max(int((times > 1).sum()), 1)), np.float32)
    of = np.repeat(np.arange(len(rows)), [len(x) for x in below])
    kept = times[place] > 1
    held[of[kept], shared[place[kept]]] = 1
    i, j = np.array([local[r] for r in a.tolist()]), np.array([local[r] for r in b.tolist()])
    return (held @ held.T)[i, j] == 0


def bucket_links(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Verified links of the bucket tiles in one group: a row (u, null, n) per vector with links, and
    spanning links (u, v, 0)."""
    us, vs, ns = [], [], []
    for (_, _, here, ta, tb), part in pdf.groupby(["label", "dims", "filter", "ta", "tb"], sort=False):
        x = unit(np.array(part["v"].tolist()))
        keys, w = part["key"].to_numpy(), part["w"].to_numpy()
        filters = part["filters"].tolist()
        left = np.nonzero(part["t"].to_numpy() == ta)[0]
        right = left if ta == tb else np.nonzero(part["t"].to_numpy() == tb)[0]
        close = x[left] @ x[right].T >= least
        if ta == tb:
            close &= np.arange(len(left))[:, None] < np.arange(len(left))[None, :]
        i, j = np.nonzero(close)
        if not len(i):
            continue
        a, b = left[i], right[j]
        new = first_meeting(filters, here, a, b)
        a, b = a[new], b[new]
        if not len(a):
            continue
        n = np.bincount(a, weights=w[b], minlength=len(x)) + np.bincount(b, weights=w[a], minlength=len(x))
        some = np.nonzero(n)[0]
        forest = Forest(len(x))
        forest.link(a, b)
        kept = np.array(forest.kept).reshape(-1, 2)
        us += [keys[some], keys[kept[:, 0]]]
        vs += [np.full(len(some), None, object), keys[kept[:, 1]]]
        ns += [n[some].astype(np.int64), np.zeros(len(kept), np.int64)]
    if not us:
        return pd.DataFrame({"u": [], "v": [], "n": []}).astype({"u": object, "v": object, "n": np.int64})
    return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs), "n": np.concatenate(ns)})


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93,
                    per_code: float = PER_CODE, seed: int = 42, tile: int = TILE) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per row of ``df``.

    Vectors of equal non-null label (and dimension) with a cosine of ``least`` or more are linked.  Every
    vector is decoded to all filter directions it exceeds, about ``per_code`` in each of CODES structured random
    product codes; vectors that share a filter are compared in double precision.  A link is found if the two share a
    filter; a pair of cosine 0.93 shares about twelve, and of such random pairs 999 in 1000 are found.  None below
    ``least`` is made.  A pair is counted in the least filter it shares.  Buckets are compared in tiles, so a common direction is spread
    over tasks; of a bucket's links only counts and a spanning set leave the task.  Equal vectors are one class.

    ``n_links`` counts other vectors linked directly, ``component_id`` is the least id reachable and ``kept`` says
    that it is the row's own.  Vectors that are null, empty, zero or hold nulls or non-finite parts, and
    those with a null label, link with nothing.  A row with a null id links with nothing, has a null component and
    is kept.  Rows that share id, label and vector are one vector.  Other columns are not read.  An empty table
    gives an empty one.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    key = F.md5(F.concat_ws("|", F.col("label").cast("string"), F.col("v").cast("string")))
    rows = materialise(rows.withColumn("key", F.when(good, key)))
    members = rows.where("key IS NOT NULL").select("key", "label", "v", "id").distinct()
    classes = materialise(members.groupBy("key", "label", "v").agg(F.min("id").alias("first"), F.count("*").alias("w")).withColumn("dims", F.size("v")))
    sizes = classes.groupBy("label", "dims").agg(F.count("*").alias("n")).groupBy("dims").agg(F.max("n").alias("n"))
    # one row per dimension that occurs
    codes = {r["dims"]: [random_code(r["dims"], max(FILTERS, int(r["n"] * per_code / tile)), per_code, seed + k) for k in range(CODES)]
             for r in sizes.collect()}
    posted = materialise(postings(classes, codes))
    bucket = ["label", "dims", "filter"]
    tiles = posted.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile)).drop("n")
    groups = max(1, posted.count() // GROUP)
    sent = posted.join(tiles, bucket).withColumn("t", F.pmod(F.xxhash64("key"), F.col("tiles")))
    sent = sent.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    sent = sent.withColumns({"ta": F.least("t", "o"), "tb": F.greatest("t", "o")}).drop("o", "tiles")
    sent = sent.withColumn("group", F.pmod(F.xxhash64(*bucket, "ta", "tb"), F.lit(groups)))
    found = materialise(sent.groupBy("group").applyInPandas(lambda pdf: bucket_links(pdf, least), "u string, v string, n long"))
    counted = found.where("v IS NULL").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("links"))
    grouped = components(found.where("v IS NOT NULL").select("u", "v")).withColumnRenamed("node", "key")
    named = classes.select("key", "first", "w").join(grouped, "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = named.join(named.groupBy("component").agg(F.min("first").alias("component_id")), "component").join(counted, "key", "left")
    named = cut_lineage(named.select("key", "component_id", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = rows.select("id", "key").join(named, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
