"""SimHash near-duplicates: fingerprints, and an exact tiled search within a Hamming radius."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramo.functions.neighbours import components
from paramo.llm.common import per_text
from paramo.session import cut_lineage, materialise

#: Shingles hashed at a time; bounds the memory of a very long text.
BLOCK = 1 << 16
#: A tile aims at this many fingerprints and holds at most about this many.
TILE = 32768
#: Ways to cut the 64 bits into parts whose population counts are compared, coarse to fine.
PARTS = (1, 2, 4, 8)


def fingerprint(text: bytes | None, shingle: int, seed: int) -> int:
    """The signed 64-bit fingerprint of one text (0 without words)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at:at + BLOCK].tolist(), ends[at:at + BLOCK].tolist())])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of every text, as a signed long."""
    def run(texts):
        return [[fingerprint(t, shingle, seed) for t in texts]]

    return per_text(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", run, "fp long")


def offsets(parts: int, radius: int) -> list[tuple[int, ...]]:
    """All integer steps between count vectors whose absolute values sum to ``radius`` at most, one of each +/- pair."""
    found = [()]
    for _ in range(parts):
        found = [f + (d,) for f in found for d in range(-radius, radius + 1) if sum(map(abs, f)) + abs(d) <= radius]
    return [f for f in found if f >= (0,) * parts]


class Forest:
    """Union-find that keeps only the links that joined two trees."""

    def __init__(self, n: int):
        self.up, self.kept = np.arange(n), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            # one link per left node at a time, then forget what is joined already
            _, first = np.unique(a, return_index=True)
            for i, j in zip(a[first].tolist(), b[first].tolist()):
                x, y = self.root(i), self.root(j)
                if x != y:
                    self.up[max(x, y)] = min(x, y)
                    self.kept.append((i, j))
            while not np.array_equal(up := self.up[self.up], self.up):
                self.up = up
            open_ = self.up[a] != self.up[b]
            a, b = a[open_], b[open_]


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the pairs within ``radius`` bits: exclusive-or of all against all, then bit counts.
    ``right`` None compares the tile with itself."""
    a = np.ascontiguousarray(left).view(np.uint64)
    b = a if right is None else np.ascontiguousarray(right).view(np.uint64)
    values = a if right is None else np.concatenate([a, b])
    shift = 0 if right is None else len(a)
    forest = Forest(len(values))
    rows = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), rows):
        near = np.bitwise_count(a[at:at + rows, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i += at
        if right is None:
            i, j = i[j > i], j[j > i]
        forest.link(i, j + shift)
    kept = np.array(forest.kept, np.int64).reshape(-1, 2)
    signed = values.view(np.int64)
    return signed[kept[:, 0]], signed[kept[:, 1]]


def links(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(u, v): pairs of fingerprints of ``distinct`` (column fp) within ``radius`` bits that connect all such pairs.

    Fingerprints are grouped into cells by the population counts of their parts and cells into tiles
    of about ``tile`` rows.  Counts that differ by more than the radius in sum mean more differing bits
    than the radius, so only tiles of cells that near each other are compared.  The more fingerprints
    there are, the finer the parts; the result does not depend on it.
    """
    rows = distinct.count()
    # a cell of `parts` counts holds about rows * (expected collision)^parts fingerprints
    parts = max([p for p in PARTS if rows * (0.56 / (64 / p) ** 0.5) ** p >= tile / 8], default=1)
    width = 64 // parts
    mask = (1 << width) - 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1))) for k in range(parts)]
    cells = distinct.select("fp", F.array(*[c.cast("int") for c in counts]).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    sizes = cut_lineage(sizes)
    placed = cells.join(sizes, "cell").withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles"))).select("cell", "t", "fp")
    steps = F.array(*[F.array(*[F.lit(d) for d in step]) for step in offsets(parts, radius)])
    around = sizes.select(F.col("cell").alias("cell_a"), F.col("tiles").alias("tiles_a"), F.explode(steps).alias("step"))
    around = around.select("cell_a", "tiles_a", F.zip_with("cell_a", "step", lambda x, d: x + d).alias("cell_b"))
    pairs = around.join(sizes.select(F.col("cell").alias("cell_b"), F.col("tiles").alias("tiles_b")), "cell_b")
    pairs = (pairs.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("tiles_a") - 1)))
             .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("tiles_b") - 1)))
             .where("cell_a <> cell_b OR a <= b"))
    pairs = cut_lineage(pairs.withColumn("pair", F.xxhash64("cell_a", "a", "cell_b", "b")).select(
        "pair", "cell_a", "a", "cell_b", "b", (F.expr("cell_a = cell_b AND a = b")).alias("same")))

    def sent(side: str) -> DataFrame:
        keys = pairs.select("pair", F.col(f"cell_{side}").alias("cell"), F.col(side).alias("t"), "same", F.lit(side == "b").alias("is_b"))
        if side == "b":
            keys = keys.where("NOT same")
        return placed.join(keys, ["cell", "t"]).select("pair", "same", "is_b", "fp")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, is_b = pdf["fp"].to_numpy(), pdf["is_b"].to_numpy()
        # should two pairs share a hash, the larger comparison finds the links of both
        u, v = tile_links(np.unique(fp), None, radius) if pdf["same"].any() else tile_links(fp[~is_b], fp[is_b], radius)
        return pd.DataFrame({"u": u, "v": v})

    return sent("a").unionByName(sent("b")).groupBy("pair").applyInPandas(run, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 3, seed: int = 42, tile: int = TILE) -> DataFrame:
    """(id_col, fingerprint, component_id), one row per row of ``df``.

    Texts are lower-cased (A-Z), cut into words at white space and into runs of ``shingle`` words,
    repeats included; a bit of the fingerprint is set if it is set in over half of the XXH64 hashes.
    Fingerprints that differ in ``radius`` bits at most are linked; ``component_id`` is the least id
    reachable.  Equal fingerprints are one node, so copies never meet each other.

    Null and empty texts have no words and the fingerprint 0.  Rows with a null id take part;
    their group's ``component_id`` is the least non-null id, or null if there is none.  Repeated
    rows get equal results.  Other columns of ``df`` are not read.  An empty table gives an empty one.
    """
    prints = materialise(fingerprints(df, id_col, text_col, shingle, seed))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("first")))
    groups = components(links(distinct.select("fp"), radius, tile))
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near-duplicates, the least id.

    Rows that share an id are one document, which joins the groups of all its texts; where it stays, its row with
    the least text does.  A row without an id cannot be told apart from others; it stays unless a document with an id is in its group.
    """
    found = cut_lineage(near_duplicates(docs, id_col, text_col, **how))
    named = found.where(F.col(id_col).isNotNull())
    ids = named.groupBy(id_col).agg(F.min("component_id").alias("_group"), F.max("component_id").alias("_last"), F.count("*").alias("_rows"))
    shared = cut_lineage(ids.where("_group <> _last").select(id_col, "_group"))
    if not shared.isEmpty():
        joined = components(named.join(shared, id_col).select(F.col("_group").alias("u"), F.col("component_id").alias("v")))
        ids = ids.join(joined, F.col("_group") == F.col("node"), "left").withColumn("_group", F.coalesce("component", "_group"))
    ids = ids.where(F.col("_group") == F.col(id_col))
    single = docs.join(ids.where("_rows = 1").select(id_col), id_col, "left_semi")
    several = docs.join(ids.where("_rows > 1").select(id_col), id_col, "left_semi")
    row, text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    least = several.select(F.col(id_col).alias("_id_"), row.alias("_row_"), text.alias("_text_")).groupBy("_id_").agg(F.min_by("_row_", "_text_").alias("_row_"))
    out = single.unionByName(least.select("_row_.*")) if not ids.where("_rows > 1").isEmpty() else single
    if not docs.where(F.col(id_col).isNull()).isEmpty():
        # fingerprints of groups that have no id at all
        alone = found.where(F.col(id_col).isNull() & F.col("component_id").isNull()).select("fingerprint").distinct()
        # the text is the only handle: fingerprint it again beside the row, which is one column so that no name clashes
        unnamed = docs.where(F.col(id_col).isNull()).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
        again = per_text(unnamed, "_text", lambda texts: [[fingerprint(t, how.get("shingle", 3), how.get("seed", 42)) for t in texts]], "_fp long")
        again = again.withColumn("fingerprint", F.lower(F.lpad(F.hex("_fp"), 16, "0"))).join(alone, "fingerprint", "left_semi")
        out = out.unionByName(again.select("_row.*"))
    return out
