"""Byte-pair encoding and decoding with a public vocabulary, by a pair occurrence index."""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramo.llm import common

#: Text that is merged at once; new pieces of many texts share one pass over the ranks.
MERGE_BYTES = 8 << 20
#: Positions that enter the pair index together at first.
ENTER = 1 << 18
#: A task forgets its known pieces beyond this many.
KNOWN = 250_000
#: How byte-level vocabularies of this family split text before merging (a fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A cheap first cut at places where no piece can cross, so that the pieces of a word are looked up once.
CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: Characters that count as white space in CHUNKS but not in PIECES.
ODD = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: the byte itself where
    Latin-1 prints it, else the next letter from U+0100 on."""
    spare = itertools.count(256)
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) \
                or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in white space or need word ends are not supported")
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        ids = model["vocab"]
        self.bytes_of = [b""] * (1 + max(max(ids.values()), *[t["id"] for t in spec["added_tokens"]], 0))
        for token, i in ids.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        # longest first, so that of two added tokens at one place the longer is taken
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.byte_id = np.array([ids[c] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        self.width = len(self.bytes_of)
        keys = self.left * self.width + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 where they do not merge."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of every piece, as the bytes of 32-bit integers.

        All pieces are laid out one after another as linked symbols.  An index maps every rank to all
        positions whose pair has it.  Active ranks are applied in ascending order, each at all its
        positions at once, and the pairs left and right of a merge enter the index under their ranks.
        """
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        ends = np.cumsum([len(p) for p in pieces])
        sym = np.append(self.byte_id[raw], -1)
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        before = np.append(before, -1)[:n + 1]
        after[ends - 1] = n  # n: nothing follows
        before[np.concatenate(([0], ends[:-1]))] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            at = at[after[at] < n]
            rank = self.ranks(sym[at], sym[after[at]])
            found = rank >= 0
            at, rank = at[found], rank[found]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.nonzero(np.diff(rank))[0] + 1
            for r, p in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)

        for at in range(0, n, ENTER):
            enter(np.arange(at, min(at + ENTER, n)))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (sym[after[at]] == b)]
            if not len(at):
                continue
            if a == b:
                # in a row of equal symbols every other pair from the left merges
                at = np.sort(at)
                i = np.arange(len(at))
                begins = np.append(True, after[at[:-1]] != at[1:])
                at = at[(i - np.maximum.accumulate(np.where(begins, i, 0))) % 2 == 0]
            gone = after[at]
            sym[at], sym[gone] = self.merged[r], -2
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            near = np.concatenate([left[left >= 0], at])
            near.sort()
            enter(near[np.append(True, near[1:] != near[:-1])])
        alive = sym[:n] >= 0
        flat = sym[:n][alive].astype("<i4").tobytes()
        to = np.cumsum(alive)[ends - 1] * 4
        return [flat[i:j] for i, j in zip([0, *to[:-1].tolist()], to.tolist())]


class Encoder:
    """Encodes texts; known chunks and pieces are kept between calls."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(itertools.count().__next__)  # of chunks
        self.ids: list[bytes] = []  # by number of the chunk
        self.pieces: dict[str, bytes] = {}

    def _chunks(self, text: str) -> list[str]:
        return self.v.pieces.findall(text) if ODD.search(text) else CHUNKS.findall(text)

    def _numbers(self, text: str) -> list[np.ndarray | bytes]:
        """The chunks of a text by number; an added token as its id's bytes."""
        number = self.number
        if self.v.split is None:
            return [np.array([number[c] for c in self._chunks(text)], np.int32)]
        out, at = [], 0
        for m in itertools.chain(self.v.split.finditer(text), [None]):
            part = text[at:m.start() if m else len(text)]
            out.append(np.array([number[c] for c in self._chunks(part)], np.int32))
            if m:
                out.append(np.array([self.v.special[m.group()]], "<i4").tobytes())
                at = m.end()
        return out

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if len(self.number) > KNOWN:
            self.forget()
        parts = [self._numbers((t or b"").decode()) for t in texts]
        split, known = self.v.pieces.findall, self.pieces
        new = [[c] if c.isascii() and (c[1:] if c[0] == " " else c).isalpha() else split(c) for c in itertools.islice(self.number, len(self.ids), None)]
        unseen = list(dict.fromkeys(p for pieces in new for p in pieces if p not in known))
        if unseen:
            known.update(zip(unseen, self.v.merge([p.encode() for p in unseen])))
        self.ids += [b"".join([known[p] for p in pieces]) for pieces in new]
        ids = self.ids
        return [np.frombuffer(b"".join([x if isinstance(x, bytes) else b"".join([ids[i] for i in x.tolist()]) for x in text]), "<i4")
                for text in parts]


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col`` (array<int>) for its text column, which goes.

    The ids are those of the tokenizer file at ``path`` (byte-level BPE; every executor reads it) without
    added special tokens, truncation or padding; added tokens that stand in a text are recognised.  Null
    and empty texts have no ids.  Rows are encoded on their own, so repeated rows and ids do not matter; a
    column of ``df`` named like ``ids_col`` is replaced.  An empty table gives an empty one.
    """
    keep = [f for f in df.schema.fields if f.name not in (text_col, ids_col)]
    source = df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text_col}`").alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{ids_col}` array<int>"])

    def run(batches):
        encoder = Encoder(Vocabulary(path))
        for batch in merged(common.slices(batches, "_text")):
            found = encoder.encode(batch.column("_text").cast(pa.binary()).to_pylist())
            at = 0
            while at < len(found):  # lists go out in parts of bounded size
                end, size = at, 0
                while end < len(found) and (end == at or size + len(found[end]) <= 1 << 20):
                    size += len(found[end])
                    end += 1
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found[at:end]]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found[at:end]), pa.int32()))
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in keep] + [lists], names=[f.name for f in keep] + [ids_col])
                at = end

    return source.mapInArrow(common.give_back(run), schema)


def merged(batches, most: int = MERGE_BYTES):
    """Neighbouring small batches as one of about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with ``text_col`` (string) for its ids, which go: the bytes of all ids, as UTF-8 in which
    invalid parts become U+FFFD.  Null ids give null, an id that is null or not in the vocabulary gives nothing."""
    keep = [f for f in df.schema.fields if f.name not in (text_col, ids_col)]
    source = df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{ids_col}`").alias("_ids"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{text_col}` string"])

    def run(batches):
        known = Vocabulary(path).bytes_of
        size = len(known)
        for batch in batches:
            texts = []
            for ids in batch.column("_ids"):
                if not ids.is_valid:
                    texts.append(None)
                    continue
                values = ids.values.drop_null().to_numpy()
                if len(values) and (values.min() < 0 or values.max() >= size):
                    values = values[(values >= 0) & (values < size)]
                texts.append(b"".join([known[i] for i in values.tolist()]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [pa.array(texts, pa.string())],
                                             names=[f.name for f in keep] + [text_col])

    return source.mapInArrow(common.give_back(run), schema)
