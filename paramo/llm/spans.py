"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramo.llm.common import give_back, slices, unused
from paramo.session import materialise

#: A sentence ends after a terminator that white space follows, after a wide terminator, or at a line end.
END = re.compile(rb"(?<=[.!?])[\x20\x09-\x0D]+|(?<=\xe3\x80\x82)|(?<=\xef\xbc\x81)|(?<=\xef\xbc\x9f)|[\n\r][\x20\x09-\x0D]*")
#: Within a sentence, the word of least CRC-32 (the first, if equal) of every WINDOW consecutive words ends a
#: piece.  Only words near by decide, so two copies of a passage are cut alike but for the WINDOW words at its ends:
#: LEAST_WORDS of 51 words are common at least, in 3 pieces or more, wherever the passage stands: the last pick that both copies
#: share is the twelfth word of the passage or before, the first one that they share again the twelfth from its end or after.
WINDOW = 12
LEAST_WORDS = 51 - 2 * WINDOW + 1
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def starts_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each sentence, or piece of a sentence of WINDOW words or more, starts, and how many words each has.

    It reaches to the start of the next, white space after it included.  Two wide letters (U+3000 to U+D7FF), which stand
    without blanks, count as one word more."""
    marks = np.array([m.end() for m in END.finditer(text)], np.int64)
    blank = BLANK[np.frombuffer(text, np.uint8)]
    fresh = ~blank
    fresh[1:] &= blank[:-1]
    inner = marks[marks < len(text)]
    fresh[inner] |= ~blank[inner]  # a wide terminator ends a word too
    begins = np.nonzero(fresh)[0]
    n = len(begins)
    if not n:
        return begins, begins
    of = np.searchsorted(marks, begins, "right")
    new = np.ones(n, bool)
    new[1:] = of[1:] != of[:-1]
    if n >= WINDOW and (of[:n - WINDOW + 1] == of[WINDOW - 1:]).any():
        words = text.split()
        if len(words) != n:
            words = [text[i:j].rstrip() for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(text)])]
        key = np.array(list(map(zlib.crc32, words)), np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64)
        least, size = key, 1
        while size < WINDOW:
            step = min(size, WINDOW - size)
            least, size = np.minimum(least[:-step], least[step:]), size + step
        picked = least[of[:n - WINDOW + 1] == of[WINDOW - 1:]] & np.uint64(0xFFFFFFFF)
        new[picked[picked < n - 1].astype(np.int64) + 1] = True
    starts = begins[new]
    counts = np.diff(np.append(np.nonzero(new)[0], n))
    raw = np.frombuffer(text, np.uint8)
    wide = (raw >= 0xE3) & (raw <= 0xED)
    if wide.any():
        counts = counts + np.add.reduceat(wide, starts, dtype=np.int64) // 2
    return starts, counts


def sentences(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of each sentence or piece, joined by one space, and how many there are."""
    starts, counts = starts_of(text)
    at = starts.tolist()
    return [b" ".join(text[i:j].split()) for i, j in zip(at, [*at[1:], len(text)])], counts


def runs(bodies: list[bytes], words: np.ndarray, least_sentences: int, least_words: int):
    """(first sentence, sentences, 128-bit hash as two longs) of every shortest run of consecutive
    sentences that has ``least_sentences`` sentences and ``least_words`` words."""
    counts = np.concatenate(([0], np.cumsum(words)))
    n = len(bodies)
    first = np.arange(n)
    last = np.maximum(np.searchsorted(counts, counts[:-1] + least_words, "left"), first + least_sentences)
    first = first[last <= n]
    last = last[:len(first)]
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(b"\n".join(bodies[i:j])) for i, j in zip(first.tolist(), last.tolist())])
    return first, last - first, np.frombuffer(raw, "<i8").reshape(-1, 2)


def all_runs(df: DataFrame, id_col: str, text_col: str, least_sentences: int, least_words: int) -> DataFrame:
    """(id, pos, n, h1, h2): every run of every text."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [runs(*sentences(t), least_sentences, least_words) if t else None for t in texts]
            rows = [0 if f is None else len(f[0]) for f in found]
            if not sum(rows):
                continue
            full = [f for f in found if f is not None]
            hashes = np.concatenate([f[2] for f in full])
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(np.repeat(np.arange(len(rows)), rows))),
                pa.array(np.concatenate([f[0] for f in full]).astype(np.int32)),
                pa.array(np.concatenate([f[1] for f in full]).astype(np.int32)),
                pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], names=["id", "pos", "n", "h1", "h2"])

    return source.mapInArrow(give_back(run), f"id {id_type}, pos int, n int, h1 long, h2 long")


def repeated(df: DataFrame, id_col: str, text_col: str, least_sentences: int, least_words: int) -> DataFrame:
    """(id, covers): per document the runs (pos, n) that occurred before, in order of (id, pos).

    Texts are cut and hashed once and the runs written out; their hashes are counted first, and only those that occur twice or more
    are looked at again."""
    every = materialise(all_runs(df, id_col, text_col, least_sentences, least_words))
    # two rows of one id are one document; a run is counted once per place
    twice = materialise(every.groupBy("h1", "h2").agg(F.count("*").alias("places")).where("places > 1").select("h1", "h2"))
    places = materialise(every.join(twice, ["h1", "h2"], "left_semi"))
    # written out, so that the join below has a shuffle of its own, which AQE splits where a span is very common
    first = materialise(places.groupBy("h1", "h2").agg(F.min(F.struct("id", "pos")).alias("first")))
    later = places.where("id IS NOT NULL").join(first, ["h1", "h2"]).where("NOT (struct(id, pos) <=> first)")
    return later.groupBy("id").agg(F.collect_set(F.struct("pos", "n")).alias("covers"))


def cut(text: bytes, covers: list) -> tuple[bytes, int, bool]:
    """The text without the covered sentences, how many these are, and whether they are all."""
    starts = starts_of(text)[0].tolist()
    gone = np.zeros(len(starts) + 1, np.int32)
    for c in covers:
        gone[c["pos"]] += 1
        gone[min(c["pos"] + c["n"], len(starts))] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    edges = starts + [len(text)]
    kept = text[:edges[0]] + b"".join([text[edges[i]:edges[i + 1]] for i in np.nonzero(~gone)[0].tolist()])
    return kept, int(gone.sum()), bool(gone.all())


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   least_sentences: int = 3, least_words: int = LEAST_WORDS) -> DataFrame:
    """The columns of ``df`` with sentences removed from the text, and ``n_removed`` and ``emptied`` (all sentences went).

    A span is the shortest run of consecutive sentences from a sentence on that has ``least_sentences``
    sentences and ``least_words`` words; white space within does not matter.  Every span that
    occurs in several places stays where it occurs first, in order of id and position; sentences
    that any other occurrence covers go.  Sentences end as END says; those of WINDOW words or more are
    cut into pieces, which count as sentences here, at words that their content picks.  With the ``least_words`` given here
    every passage of 51 words shares a span with its copies, wherever they stand; more would miss some, fewer cut more
    that is no passage.

    Null and empty texts stay as they are.  Rows that share an id are one
    document, so a copy under the same id is no repeat.  A row without an id counts as first
    and is never changed.  A column of ``df`` named ``n_removed`` or ``emptied`` is
    replaced.  An empty table gives an empty one.
    """
    if id_col == text_col:
        raise ValueError("id and text must be different columns")
    df = df.drop("n_removed", "emptied")
    found = repeated(df, id_col, text_col, least_sentences, least_words)
    key, covers = unused("_id", df), unused("_covers", df)
    found = found.select(F.col("id").alias(key), F.col("covers").alias(covers))
    joined = df.join(found, F.col(id_col) == F.col(key), "left").drop(key)
    keep = df.columns

    def run(batches):
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            out = [cut(t, c) if t and c else (t, 0, False) for t, c in zip(texts, batch.column(covers).to_pylist())]
            columns = {n: batch.column(n) for n in keep}
            columns[text_col] = pa.array([o[0] for o in out], pa.binary()).cast(batch.column(text_col).type)
            columns["n_removed"] = pa.array([o[1] for o in out], pa.int64())
            columns["emptied"] = pa.array([o[2] for o in out], pa.bool_())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return joined.mapInArrow(give_back(run), schema + ", n_removed long, emptied boolean")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with repeated spans cut from their texts; texts that lose all sentences go."""
    columns = docs.columns
    cut_ = remove_repeats(docs, id_col, text_col, **how)
    return cut_.where("NOT emptied").select(*[F.col(f"`{c}`") for c in columns])
