"""Exact substring dedup: suffix arrays of candidate segments by two-stage sorting."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramo.llm.common import give_back, slices
from paramo.session import materialise

#: Bytes of the grams whose least hash in a window places the window in a group.
GRAM = 32
#: Bytes of distinct segments per suffix array, about.
ARRAY_BYTES = 1 << 19
#: A group of more distinct segments is not put into one array; its windows are counted by hash.
WIDE = 1000
#: Windows of a text that are looked at together; bounds the memory of a very long text.
STRETCH = 1 << 22


def words_at(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte on, as big-endian numbers; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    out = np.empty(len(raw) + 8, np.uint64)
    for o in range(8):
        part = padded[o:o + (len(padded) - o) // 8 * 8].view(">u8")
        out[o::8] = part[:len(out[o::8])]
    return out[:len(raw)]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    words = words_at(raw)
    n = len(raw) - GRAM + 1
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(0, GRAM, 8):
        h ^= words[k:k + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def window_runs(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, n, hash): runs of window starts whose windows of ``length`` bytes pick the same gram.

    A window picks its gram of least hash, the leftmost if several; equal windows pick alike.
    """
    width = length - GRAM + 1
    h = gram_hashes(raw)
    bits = np.uint64(24)  # the place breaks ties of the other bits
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(key) // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:len(key)] = key
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(key) - width + 1
    picked = (np.minimum(back[:starts], ahead[width - 1:width - 1 + starts]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.concatenate(([0], np.nonzero(np.diff(picked))[0] + 1))
    return first, np.diff(np.append(first, starts)), h[picked[first]]


def runs_of(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, n, gram hash, 128-bit hash of the run's bytes) for a text of at least ``length`` bytes."""
    parts = []
    for at in range(0, len(text) - length + 1, STRETCH):
        raw = np.frombuffer(text, np.uint8, min(STRETCH + length - 1, len(text) - at), at)
        first, n, h = window_runs(raw, length)
        parts.append((first + at, n, h))
    first, n, h = (np.concatenate(x) for x in zip(*parts))
    digest = xxhash.xxh3_128_digest
    whole = b"".join([digest(text[a:a + c + length - 1]) for a, c in zip(first.tolist(), n.tolist())])
    return first, n, h.view(np.int64), np.frombuffer(whole, "<i8").reshape(-1, 2)


def all_runs(docs: DataFrame, length: int) -> DataFrame:
    """(id, th, first, n, h, s1, s2): every run of every text."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            rows, found = [], []
            for i, t in enumerate(texts):
                if t is not None and len(t) >= length:
                    found.append(runs_of(t, length))
                    rows.append(np.full(len(found[-1][0]), i))
            if not found:
                continue
            own = batch.select(["id", "th"]).take(pa.array(np.concatenate(rows)))
            first, n, h, s = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([
                own.column("id"), own.column("th"), pa.array(first, pa.int64()), pa.array(n, pa.int32()), pa.array(h),
                pa.array(s[:, 0]), pa.array(s[:, 1])], names=["id", "th", "first", "n", "h", "s1", "s2"])

    return docs.mapInArrow(give_back(run), f"id {id_type}, th long, first long, n int, h long, s1 long, s2 long")


def suffix_order(text: bytes, wanted: np.ndarray, length: int) -> np.ndarray:
    """The positions of ``wanted`` (a mask) in order of the first ``length`` bytes from them on.

    Two-stage sorting: only suffixes smaller than their successors are sorted directly.  The others are
    induced by one scan over the buckets of first bytes: the predecessor of a suffix in place, if it is larger
    than that, comes next among those of its own first byte.
    """
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    step = np.sign(np.append(raw[1:].astype(np.int16), -1) - raw)  # the last suffix is larger than nothing
    change = np.where(step != 0, np.arange(n), n)
    change = np.minimum.accumulate(change[::-1])[::-1]
    small = step[change] > 0  # smaller than its successor
    # a larger suffix is placed from its successor, so the chain to the next small one is needed
    next_small = np.minimum.accumulate(np.where(small, np.arange(n), n - 1)[::-1])[::-1]
    ends = next_small[wanted]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, np.nonzero(wanted)[0], 1)
    np.add.at(cover, ends + 1, -1)
    needed = np.cumsum(cover[:-1]) > 0
    direct = np.nonzero(needed & small)[0].tolist()
    direct.sort(key=lambda p: text[p:p + length])
    direct = np.array(direct, np.int64)
    firsts = raw[direct]
    borders = np.searchsorted(firsts, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger = needed & ~small
    if needed[n - 1]:
        pending[raw[n - 1]].append(np.array([n - 1]))  # the shortest suffix is the least of its bucket
    out = []

    def induce(at: np.ndarray, c: int) -> np.ndarray:
        """Place the larger predecessors of suffixes in bucket c; returns those that stay in c."""
        before = at[at > 0] - 1
        before = before[larger[before]]
        if not len(before):
            return before
        heads = raw[before]
        stay = before[heads == c]
        onward, heads = before[heads > c], heads[heads > c]
        by = np.argsort(heads, kind="stable")
        onward, heads = onward[by], heads[by]
        cuts = np.nonzero(np.diff(heads))[0] + 1
        if len(onward):
            for d, part in zip(heads[np.concatenate(([0], cuts))].tolist(), np.split(onward, cuts)):
                pending[d].append(part)
        return stay

    for c in range(256):
        now = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        while len(now):
            out.append(now)
            now = induce(now, c)
        sorted_here = direct[borders[c]:borders[c + 1]]
        if len(sorted_here):
            out.append(sorted_here)
            induce(sorted_here, c)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def equal_neighbours(raw: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each two adjacent suffixes: whether their common prefix has ``length`` bytes or more."""
    words = words_at(raw)
    alive = np.arange(len(order) - 1)
    for k in [*range(0, length - 7, 8), length - 8]:
        alive = alive[words[order[alive] + k] == words[order[alive + 1] + k]]
    out = np.zeros(max(len(order) - 1, 0), bool)
    out[alive] = True
    return out


def repeated_windows(segments: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(segment, from, to): ranges of window starts whose window occurs at another start of the segments."""
    sizes = np.array([len(s) for s in segments])
    text = b"".join(segments)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    wanted = np.zeros(len(text), bool)
    for b, e in zip(begins.tolist(), ends.tolist()):
        wanted[b:e - length + 1] = True
    order = suffix_order(text, wanted, length)
    same = equal_neighbours(np.frombuffer(text, np.uint8), order, length)
    marked = np.zeros(len(text) + 1, bool)
    marked[order[:-1][same]] = True
    marked[order[1:][same]] = True
    edges = np.nonzero(np.diff(np.concatenate(([False], marked)).astype(np.int8)))[0]
    # a window that starts in a segment ends in it, so marked starts of two segments never touch
    of = np.searchsorted(ends, edges[::2], "right")
    return list(zip(of.tolist(), (edges[::2] - begins[of]).tolist(), (edges[1::2] - begins[of]).tolist()))


KEY = ["h", "s1", "s2", "n"]


def fetched(docs: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """``reps`` (KEY, id, th, first) with the bytes of each run."""
    wanted = reps.groupBy("id", "th").agg(F.collect_list(F.struct("first", *KEY)).alias("runs"))
    joined = docs.join(wanted.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "runs"),
                       F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("text", "runs")

    def run(batches):
        for batch in slices(batches, "text"):
            out = [(r["h"], r["s1"], r["s2"], r["n"], t[r["first"]:r["first"] + r["n"] + length - 1])
                   for t, rs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist()) for r in rs]
            for at in range(0, len(out), 1000):
                h, s1, s2, n, seg = zip(*out[at:at + 1000])
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(n, pa.int32()),
                                                  pa.array(seg, pa.binary())], names=[*KEY, "seg"])

    # rows of one document are joined once each; their runs are the same
    return joined.mapInArrow(give_back(run), "h long, s1 long, s2 long, n int, seg binary").dropDuplicates(KEY)


def by_arrays(segs: DataFrame, length: int) -> DataFrame:
    """(KEY, lo, hi): repeated windows among the segments of each array."""
    arrays = F.lit(max(1, int((segs.agg(F.sum(F.length("seg"))).first()[0] or 0) // ARRAY_BYTES)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows(pdf["seg"].tolist(), length)
        of = [f[0] for f in found]
        return pdf[KEY].iloc[of].assign(lo=np.array([f[1] for f in found], np.int64), hi=np.array([f[2] for f in found], np.int64))

    return segs.withColumn("_array", F.pmod(F.xxhash64("h"), arrays)).groupBy("_array").applyInPandas(
        run, "h long, s1 long, s2 long, n int, lo long, hi long")


def by_counts(segs: DataFrame, length: int) -> DataFrame:
    """The same for segments of groups too wide for one array: windows counted by 128-bit hash over all tasks."""
    def run(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                counts = part.column("n").to_numpy()
                raw = b"".join([digest(s[i:i + length]) for s, n in zip(part.column("seg").to_pylist(), counts.tolist()) for i in range(n)])
                w = np.frombuffer(raw, "<i8").reshape(-1, 2)
                rows = part.select(KEY).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                at_ = np.concatenate([np.arange(n) for n in counts]) if len(counts) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(at_, pa.int64())],
                                                 names=[*KEY, "w1", "w2", "lo"])

    windows = segs.mapInArrow(give_back(run), "h long, s1 long, s2 long, n int, w1 long, w2 long, lo long")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2")
    return windows.join(twice, ["w1", "w2"], "left_semi").select(*KEY, "lo", (F.col("lo") + 1).alias("hi"))


def covered(docs: DataFrame, length: int) -> DataFrame:
    """(id, th, ranges): byte ranges [lo, hi) of each text that repeated windows cover; they may overlap."""
    runs = materialise(all_runs(docs, length).distinct())
    shared = runs.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    some = materialise(runs.join(shared, "h", "left_semi"))
    segs = materialise(some.groupBy(*KEY).agg(F.count("*").alias("copies"), F.min(F.struct("id", "th", "first")).alias("rep")))
    kinds = segs.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = segs.join(kinds, "h")
    bytes_of = materialise(fetched(docs, several.select(*KEY, "rep.*"), length).join(kinds, "h"))
    marks = (by_arrays(bytes_of.where(F.col("kinds") <= WIDE), length)
             .unionByName(by_counts(bytes_of.where(F.col("kinds") > WIDE), length))
             .unionByName(segs.where("copies > 1").select(*KEY, F.lit(0).cast("long").alias("lo"), F.col("n").cast("long").alias("hi"))))
    marked = some.join(marks, KEY)
    return marked.groupBy("id", "th").agg(F.collect_list(F.struct(
        (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") - 1 + length).alias("hi"))).alias("ranges"))


def cut(text: bytes, ranges: list) -> tuple[bytes, list[dict]]:
    """The text without the ranges, and the ranges as maximal runs."""
    spans: list[list[int]] = []
    for r in sorted((r["lo"], r["hi"]) for r in ranges):
        if spans and r[0] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], r[1])
        else:
            spans.append(list(r))
    edges = [0, *[e for s in spans for e in s], len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])]), [{"lo": a, "hi": b} for a, b in spans]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(id_col, n_bytes, spans, kept), one row per row of ``df``.

    Every byte that lies in a string of ``length`` bytes that also starts anywhere else, in the same text or
    another, is removed; all occurrences go, and overlaps count.  ``spans`` are the maximal removed runs [lo, hi) in
    bytes and ``kept`` (binary) is what remains.  Strings never cross texts.

    Windows of ``length`` bytes are grouped by the gram they pick, so equal windows meet.  Runs of windows
    with equal bytes are one segment.  The distinct segments of a group are put into a suffix array,
    sorted in two stages; adjacent suffixes with ``length`` common bytes are repeated windows.  Groups of more than
    WIDE distinct segments are counted window by window instead, spread over all tasks, with the same result.

    Null and empty texts have 0 bytes and keep nothing; texts below ``length`` stay whole.  Rows equal in id and
    text are one document; rows with equal ids and different texts are different ones; a null id is an
    id.  Other columns are not read.  An empty table gives an empty one.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    found = covered(docs, length).select(F.col("id").alias("_id"), F.col("th").alias("_th"), "ranges")
    joined = docs.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").select("id", "text", "ranges")
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out = [cut(t, r or []) for t, r in zip(texts, batch.column("ranges").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([o[1] for o in out], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                pa.array([o[0] for o in out], pa.binary())], names=[id_col, "n_bytes", "spans", "kept"])

    return joined.mapInArrow(give_back(run), f"`{id_col}` {id_type}, n_bytes long, spans array<struct<lo: long, hi: long>>, kept binary")
