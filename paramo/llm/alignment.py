"""Which tokens of two tokenizers cover the same bytes, and in how many documents each pair does."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramo.llm.bpe import PIECES, byte_letters
from paramo.llm.common import give_back, slices
from paramo.session import materialise

#: A text is aligned segment by segment.  A segment starts at a blank that follows a character that is no white space;
#: see ``Tokens`` for why no token of either tokenizer crosses such a place.
SEGMENT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
#: A task forgets the segments it knows beyond this many, and beyond these bytes of them.
KNOWN, KNOWN_BYTES = 300_000, 16 << 20
#: New segments that are tokenized together, at most, and about this many characters.
NEW, NEW_CHARS = 8192, 1 << 20
#: Longer segments are left to the library whose patterns do not recurse.
LONG = 50_000
#: Distinct pairs that a task holds before it collapses them, and entries of a block of a count vector.
HELD, BLOCK = 1 << 20, 1 << 16
#: Pairs of one hash function: with their counts about 34 MB, which is what is broadcast at a time.  Tables of more are
#: split by the id of A, and documents pass one part after another.
PART = 1 << 21
#: Links of one group beyond which equal ids of the group are counted before they are paired.
WIDE = 1 << 16


class Tokens:
    """Both tokenizers, and the bytes of each of their ids.

    The byte-level one cuts texts into pieces before it merges; no piece goes on over a blank after a character that is no
    white space.  In the other one no piece has its mark of a blank after another character (checked here), so no merge crosses
    such a place either.  Hence both encode a text as the segments between such places one by one.  Where the check
    fails, a whole text is one segment.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken

        self.path_a = path_a
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("A must be a plain byte-level BPE file")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ranks = [vocab[a + b] for a, b in merges]
        # special tokens have no bytes: plain text never gives them
        self.bytes_a = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.bytes_a[i] = b"" if token in special else bytes(byte_of[c] for c in token)
        # where ids follow the order of the merges they are ranks, and the faster library gives the same ids
        ordered = ranks == sorted(set(ranks)) and all(len(x) == 1 for x in self.bytes_a[:256]) and ranks[0] == 256
        self.ranked = tiktoken.Encoding("a", pat_str=PIECES, special_tokens={},
                                        mergeable_ranks={x: i for i, x in enumerate(self.bytes_a) if x}) if ordered else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_segment = not any(re.search("[^▁]▁", p) for p in pieces)
        self.lengths_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.lengths_b = np.array([len(x) for x in self.bytes_b], np.int64)

    @functools.cached_property
    def whole(self):
        """The library whose file A is; it also takes segments of any length."""
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(self.path_a)
        a.no_truncation()
        a.no_padding()
        a.encode_special_tokens = True
        return a

    def ids_a(self, segments: list[str]) -> list[list[int]]:
        if self.ranked is None:
            return [e.ids for e in self.whole.encode_batch_fast(segments, add_special_tokens=False)]
        encode = self.ranked.encode_ordinary
        return [encode(s) if len(s) <= LONG else self.whole.encode(s, add_special_tokens=False).ids for s in segments]

    def ids_b(self, segments: list[str]) -> list[list[int]]:
        """The library adds the first blank itself, but to nothing where nothing follows, as in the last blank of a text."""
        found = self.b.encode([s[1:] for s in segments], num_threads=1)
        return [x if s != " " else [self.b.piece_to_id("▁")] for s, x in zip(segments, found)]

    def segments(self, text: str) -> list[str]:
        """The segments of a blank and the text."""
        return SEGMENT.findall(" " + text) if self.by_segment else [" " + text]


@functools.lru_cache(2)
def tokens(path_a: str, path_b: str) -> Tokens:
    """Read once in a worker."""
    return Tokens(path_a, path_b)


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.all, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.all):
            self.all = np.concatenate([self.all[:self.n], np.zeros(max(self.n, len(values)), self.all.dtype)])
        self.all[self.n:self.n + len(values)] = values
        self.n += len(values)


class Aligner:
    """Aligns texts; what is known of a segment is kept between texts."""

    def __init__(self, t: Tokens, with_groups: bool, with_pairs: bool, rate=None):
        """``rate`` maps keys to (count, whether it is the best of its id of A); with it links are rated as segments are met."""
        self.t, self.with_groups, self.with_pairs, self.rate = t, with_groups, with_pairs, rate
        self.width = len(t.bytes_b)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(itertools.count().__next__)
        self.known = self.chars = 0
        #: per segment: whether its tokens are its bytes, tokens of A, of B, groups, links, best links, sum of counts
        self.facts = [Grown(np.int64) for _ in range(7)]
        self.ends = Grown(np.int64)  # where the pairs of a segment end
        self.pairs = Grown(np.int64)
        self.groups: list[str] = []

    def meet(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(segment numbers of all texts, where each text starts, and the end)."""
        if len(self.number) > KNOWN or self.chars > KNOWN_BYTES:
            self.forget()
        number, flat = self.number, []
        for text in texts:
            flat.append(np.array([number[s] for s in self.t.segments(text)], np.int64))
        new = list(itertools.islice(number, self.known, None))
        self.known = len(number)
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and end - at < NEW and (end == at or size + len(new[end]) <= NEW_CHARS):
                size += len(new[end])
                end += 1
            self._learn(new[at:end])
            self.chars += size
            at = end
        starts = np.concatenate(([0], np.cumsum([len(x) for x in flat]))).astype(np.int64)
        return np.concatenate(flat) if flat else np.zeros(0, np.int64), starts

    def _learn(self, new: list[str]) -> None:
        t = self.t
        ids_a = t.ids_a(new)
        ids_b = t.ids_b(new)
        good = np.array([b"".join([t.bytes_a[i] for i in a]) == b"".join([t.bytes_b[i] for i in b]) == s.encode()
                         for a, b, s in zip(ids_a, ids_b, new)], bool)
        if not good.all():
            ids_a = [a if g else [] for a, g in zip(ids_a, good)]
            ids_b = [b if g else [] for b, g in zip(ids_b, good)]
        n_a, n_b = np.array([len(x) for x in ids_a]), np.array([len(x) for x in ids_b])
        a = np.fromiter(itertools.chain.from_iterable(ids_a), np.int64)
        b = np.fromiter(itertools.chain.from_iterable(ids_b), np.int64)
        end_a, end_b = np.cumsum(t.lengths_a[a]), np.cumsum(t.lengths_b[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        last = np.cumsum(n_a)
        owner = np.repeat(np.arange(len(new)), n_a)[np.cumsum(in_a) - 1] if len(cuts) else np.zeros(0, np.int64)
        n_groups = np.bincount(owner, minlength=len(new))
        n_links = np.bincount(owner, weights=in_a * in_b, minlength=len(new)).astype(np.int64)
        seg, key, times = self._links(a, b, group_a, group_b, in_a, in_b, owner)
        best = total = np.zeros(len(new), np.int64)
        if self.rate is not None:
            count, top = self.rate(key)
            best = summed(seg, np.where(top, times, 0), len(new))
            total = summed(seg, times * count, len(new))
        for column, values in zip(self.facts, (good, n_a, n_b, n_groups, n_links, best, total)):
            column.add(values)
        if self.with_pairs:
            self.ends.add(self.pairs.n + np.cumsum(np.bincount(seg, minlength=len(new))))
            self.pairs.add(key)
        if self.with_groups:
            order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
            of = np.concatenate([2 * group_a, 2 * group_b + 1])[order]
            final = np.append(of[1:] != of[:-1], True)
            shown = [f"{i}{',' if not f else ';' if g & 1 else '|'}" for i, g, f in
                     zip(np.concatenate([a, b])[order].tolist(), of.tolist(), final.tolist())]
            to = (last + np.cumsum(n_b)).tolist()
            self.groups += ["".join(shown[i:j]) for i, j in zip([0, *to[:-1]], to)]

    def _links(self, a, b, group_a, group_b, in_a, in_b, owner):
        """(segment, key, times) of the distinct pairs of each segment; a key is id of A * width + id of B."""
        seg, key, times = [], [], []
        wide = in_a * in_b > WIDE
        first_b = np.cumsum(in_b) - in_b
        usual = np.nonzero(~wide[group_a])[0] if len(wide) else np.zeros(0, np.int64)
        per = in_b[group_a[usual]] if len(usual) else usual
        left = np.repeat(usual, per)
        right = np.arange(len(left)) - np.repeat(np.cumsum(per) - per, per) + first_b[group_a[left]] if len(left) else left
        seg.append(owner[group_a[left]] if len(left) else left)
        key.append(a[left] * self.width + b[right])
        times.append(np.ones(len(left), np.int64))
        for g in np.nonzero(wide)[0].tolist():
            x, nx = np.unique(a[group_a == g], return_counts=True)
            y, ny = np.unique(b[group_b == g], return_counts=True)
            key.append((x[:, None] * self.width + y).ravel())
            times.append((nx[:, None] * ny).ravel())
            seg.append(np.full(len(key[-1]), owner[g]))
        seg, key, times = np.concatenate(seg), np.concatenate(key), np.concatenate(times)
        order = np.lexsort((key, seg))
        seg, key, times = seg[order], key[order], times[order]
        new = np.append(True, (seg[1:] != seg[:-1]) | (key[1:] != key[:-1])) if len(seg) else np.zeros(0, bool)
        at = np.nonzero(new)[0]
        return seg[at], key[at], np.add.reduceat(times, at) if len(at) else times

    def distinct(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(key, number of texts that have it)."""
        flat, starts = self.meet(texts)
        sizes = np.diff(starts)
        of = np.repeat(np.arange(len(texts)), sizes)
        bad = np.bincount(of, weights=1 - self.facts[0].all[flat], minlength=len(texts)) > 0
        both = np.unique(of[~bad[of]] * max(len(self.number), 1) + flat[~bad[of]])
        of, seg = both // max(len(self.number), 1), both % max(len(self.number), 1)
        ends = self.ends.all[:self.ends.n]
        begin = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        per = ends[seg] - begin[seg]
        place = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + np.repeat(begin[seg], per)
        room = len(self.t.bytes_a) * self.width
        held = np.unique(np.repeat(of, per) * room + self.pairs.all[place])
        return np.unique(held % room, return_counts=True)

    def facts_of(self, texts: list[str]):
        """Per text: whether it has tokens, the sums of the six numbers of its segments, and its groups' hash."""
        flat, starts = self.meet(texts)
        of = np.repeat(np.arange(len(texts)), np.diff(starts))
        good = np.bincount(of, weights=1 - self.facts[0].all[flat], minlength=len(texts)) == 0
        sums = [np.where(good, summed(of, c.all[flat], len(texts)), 0) for c in self.facts[1:]]
        shas = []
        if self.with_groups:
            for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                shas.append(hashlib.sha256("".join([self.groups[s] for s in flat[a:b].tolist()])[:-1].encode()).hexdigest() if good[i] else "")
        return good, sums, shas


def summed(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of 64-bit integers by number; ``of`` ascends."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.searchsorted(of, np.arange(n + 1))
    return total[ends[1:]] - total[ends[:-1]]


def spread(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mix of every key."""
    x = keys.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps each of n distinct keys to a place of its own below n.

    In each level a key that is alone at its position of a bitmap stays there, and the rest go to the next level with a new
    hash.  The place of a key is the number of bits set before its own.
    """

    def __init__(self, bitmaps: list[tuple[int, bytes]]):
        self.bitmaps = bitmaps
        bits = [np.unpackbits(np.frombuffer(raw, np.uint8), count=m) for m, raw in bitmaps]
        self.sizes = [m for m, _ in bitmaps]
        self.starts = np.concatenate(([0], np.cumsum(self.sizes))).astype(np.int64)
        self.bits = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
        self.rank = np.cumsum(self.bits, dtype=np.int32) - 1
        self.n = int(self.bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 1.5) -> PerfectHash:
        """``keys`` are distinct."""
        bitmaps, level = [], 0
        while len(keys):
            m = max(int(len(keys) * room), 8)
            at = (spread(keys, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            bitmaps.append((m, np.packbits(alone).tobytes()))
            keys = keys[~alone[at]]
            level += 1
        return cls(bitmaps)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key; of one that was not among the n, any place or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            if not len(left):
                break
            at = (spread(keys[left], level) % np.uint64(m)).astype(np.int64) + self.starts[level]
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out


@dataclass
class Table:
    """A part of the pairs: their hash function, and by place the key, the number of documents, and whether that is its id's highest."""

    bitmaps: list[tuple[int, bytes]]
    keys: np.ndarray
    counts: np.ndarray
    top: np.ndarray


def rater(table: Table):
    """Looks keys up; keys of other parts, found by comparing the key kept at the place, have count 0."""
    found = PerfectHash(table.bitmaps)

    def rate(keys: np.ndarray):
        if not found.n:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = found.places(keys)
        own = (at >= 0) & (table.keys[at] == keys)
        return np.where(own, table.counts[at], 0), own & table.top[at]

    return rate


def task_counts(df: DataFrame, text_col: str, paths: tuple[str, str]) -> DataFrame:
    """(key, docs): per task, each pair it met and in how many documents (a pair may come more than once from one task)."""
    def run(batches):
        aligner = Aligner(tokens(*paths), with_groups=False, with_pairs=True)
        keys, counts, n = [], [], 0

        def collapsed():
            every, at = np.unique(np.concatenate(keys), return_inverse=True)
            return [every], [np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)]

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))], names=["key", "docs"])

        for batch in slices(batches, "text"):
            found, times = aligner.distinct([t for t in batch.column("text").to_pylist() if t])
            keys.append(found)
            counts.append(times)
            n += len(found)
            if n > HELD:
                keys, counts = collapsed()
                n = len(keys[0])
            if n > HELD // 2:
                yield out()
                keys, counts, n = [], [], 0
        if keys:
            keys, counts = collapsed()
            yield out()

    return df.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(give_back(run), "key long, docs long")


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the vectors of one block."""
    first, total = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            v = np.frombuffer(batch.column("vector")[i].as_buffer(), np.int64)
            total = v.copy() if total is None else total + v
            first = first if first is not None else batch.slice(i, 1)
    yield pa.RecordBatch.from_arrays([first.column("block"), first.column("task"), pa.array([total.tobytes()], pa.binary())],
                                     names=["block", "task", "vector"])


def dense_counts(found: DataFrame, hashed: PerfectHash, part: int, parts: int, width: int, fan: int = 16) -> np.ndarray:
    """The documents of every key by place: each task adds its counts into one dense vector, and vectors are summed block by block,
    first those of a few tasks, then those sums."""
    held = found.sparkSession.sparkContext.broadcast(hashed.bitmaps)
    n = hashed.n

    def run(batches):
        own = PerfectHash(held.value)
        vector = np.zeros(n, np.int64)
        for batch in batches:
            key = batch.column("key").to_numpy()
            docs = batch.column("docs").to_numpy()
            mine = part_of(key // width, parts) == part
            np.add.at(vector, own.places(key[mine]), docs[mine])
        blocks = [(at // BLOCK, vector[at:at + BLOCK]) for at in range(0, n, BLOCK)]
        blocks = [(b, v) for b, v in blocks if v.any()]
        if blocks:
            task = int(np.random.default_rng(int(vector.sum()) % (1 << 32)).integers(fan))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([task] * len(blocks), pa.int32()),
                                              pa.array([v.tobytes() for _, v in blocks], pa.binary())], names=["block", "task", "vector"])

    schema = "block int, task int, vector binary"
    vectors = found.mapInArrow(give_back(run), schema)
    some = vectors.groupBy("block", "task").applyInArrow(added, schema)
    total = np.zeros(n, np.int64)
    # at most PART entries of 8 bytes in all
    for row in some.groupBy("block").applyInArrow(added, schema).toLocalIterator():
        v = np.frombuffer(bytes(row["vector"]), np.int64)
        total[row["block"] * BLOCK:row["block"] * BLOCK + len(v)] = v
    return total


def part_of(a: np.ndarray, parts: int) -> np.ndarray:
    """The part of each id of A; all pairs of an id are in one part, so that its highest count is known there."""
    return (spread(a, 77) % np.uint64(parts)).astype(np.int64)


def tables(found: DataFrame, width: int, most: int = PART):
    """Yields the tables of all distinct keys of ``found`` (key, docs), of about ``most`` keys each."""
    distinct = materialise(found.select("key").distinct())
    total = distinct.count()
    parts = max(1, -(-total // most))

    def keyed(batches):
        for batch in batches:
            key = batch.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(part_of(key // width, parts).astype(np.int32))], names=["key", "part"])

    def build(table):
        hashed = PerfectHash.build(np.sort(table.column("key").to_numpy()))
        keys = np.zeros(hashed.n, np.int64)
        keys[hashed.places(table.column("key").to_numpy())] = table.column("key").to_numpy()
        return pa.table({"sizes": pa.array([hashed.sizes], pa.list_(pa.int64())), "bits": pa.array([[raw for _, raw in hashed.bitmaps]], pa.list_(pa.binary())),
                         "keys": pa.array([keys.tobytes()], pa.binary())})

    placed = distinct.mapInArrow(keyed, "key long, part int") if parts > 1 else distinct.withColumn("part", F.lit(0))
    for part in range(parts):
        row = placed.where(F.col("part") == part).groupBy("part").applyInArrow(build, "sizes array<long>, bits array<binary>, keys binary").first()
        hashed = PerfectHash([(m, bytes(raw)) for m, raw in zip(row["sizes"], row["bits"])] if row else [])
        keys = np.frombuffer(bytes(row["keys"]), np.int64) if row else np.zeros(0, np.int64)
        counts = dense_counts(found, hashed, part, parts, width)
        best = np.zeros(int((keys // width).max(initial=0)) + 1, np.int64)
        np.maximum.at(best, keys // width, counts)
        yield Table(hashed.bitmaps, keys, counts, counts == best[keys // width])


def align(df: DataFrame, path_a: str, path_b: str, text_col: str = "text", most: int = PART) -> DataFrame:
    """The columns of ``df`` without its text, and what two tokenizers make of it.

    A byte-level tokenizer file (A) encodes a blank and the text, a sentencepiece model (B) the text, to which it adds the blank; no
    special tokens are added or recognised.  Byte offsets at which tokens of both end cut the tokens into groups; a link is
    a token of A and a token of B in one group.  ``n_a``, ``n_b``, ``n_groups``, ``n_links`` (long) count them.  The count of a pair of
    ids is the number of rows of ``df`` that hold it linked; ``n_best`` (long) are the links whose count is
    the highest of their id of A, ties included, and ``count_sum`` (long) is the sum of the counts of all links.  ``groups_sha256`` is
    the SHA-256 of all groups as ``a1,a2|b1;a3|b2``.

    The texts are aligned twice.  First each task collects its distinct pairs; a minimal perfect hash function of them all is
    built, and the counts, summed as dense vectors in its order, are broadcast with the keys, at most ``most`` pairs at a time.
    Then the documents are aligned again and look their pairs up, once per part of the table; a key is compared before its count is used.

    Texts that are null or empty, or that either tokenizer changes, have no tokens: zeros, and '' for the hash.  Repeated
    rows each count as a document.  Columns of ``df`` named as the results are replaced.  An empty table gives an empty one.
    """
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    keep = [f for f in df.schema.fields if f.name.lower() not in (*names, "groups_sha256")]
    if text_col not in [f.name for f in keep]:
        raise ValueError("the text column has the name of a result")
    df = df.select(*[F.col(f"`{f.name}`") for f in keep])
    paths = (path_a, path_b)
    width = len(tokens(*paths).bytes_b)
    found = materialise(task_counts(df, text_col, paths))
    parts = list(tables(found, width, most))
    for i, table in enumerate(parts):
        df = _looked_up(df, text_col, paths, table, names, first=i == 0, last=i + 1 == len(parts))
    return df


def _looked_up(df: DataFrame, text_col: str, paths: tuple[str, str], table: Table, names: list[str], first: bool, last: bool) -> DataFrame:
    """One part of the table: what it adds to ``n_best`` and ``count_sum``; the first part sets the other columns."""
    held = df.sparkSession.sparkContext.broadcast(table)
    sums = names[4:]
    passed = [f for f in df.schema.fields if f.name not in sums and not (last and f.name == text_col)]
    new = names[:4] if first else []
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in passed] + [f"{n} long" for n in new]
                       + (["groups_sha256 string"] if first else []) + [f"{n} long" for n in sums])

    def run(batches):
        aligner = Aligner(tokens(*paths), with_groups=first, with_pairs=False, rate=rater(held.value))
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            full = [i for i, t in enumerate(texts) if t]
            _, facts, shas = aligner.facts_of([texts[i] for i in full])
            columns = []
            for values in facts:
                out = np.zeros(len(texts), np.int64)
                out[full] = values
                columns.append(out)
            added = [c if first else c + batch.column(n).to_numpy() for c, n in zip(columns[4:], sums)]
            hashes = [""] * len(texts)
            for i, s in zip(full, shas):
                hashes[i] = s
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in passed] + [pa.array(c) for c in columns[:len(new)]] + ([pa.array(hashes, pa.string())] if first else [])
                + [pa.array(c) for c in added], names=[f.name for f in passed] + new + (["groups_sha256"] if first else []) + sums)

    return df.mapInArrow(give_back(run), schema)
