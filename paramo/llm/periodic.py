"""Runs of a repeating unit of words, found by seeds on diagonals."""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramo.llm.common import give_back, slices

#: Words that an extension compares at first; each further step doubles it.
STEP = 64


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, where each text starts, and the end).  Equal words of one text share a number, words of
    different texts never do, so no match reaches from a text into another."""
    free, ids = itertools.count(), []
    for words in texts:
        number = defaultdict(free.__next__)
        ids.append(np.array([number[w] for w in words], np.int64))
    starts = np.concatenate(([0], np.cumsum([len(w) for w in texts]))).astype(np.int64)
    return np.concatenate(ids) if ids else np.zeros(0, np.int64), starts


def joined(names: np.ndarray, left: np.ndarray, gap: int) -> np.ndarray:
    """Names of longer grams: of the gram at i and the gram ``gap`` words on.  Equal grams share a name; -1 where a gram
    occurs once.  ``left`` are the places to look at."""
    out = np.full(len(names), -1, np.int64)
    left = left[left + gap < len(names)]
    right = names[left + gap]
    at = left[right >= 0]
    if not len(at):
        return out
    key = names[at] * (int(names.max()) + 1) + names[at + gap]
    _, name, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[name] > 1
    out[at[again]] = name[again]
    return out


def reach(ids: np.ndarray, at: int, lag: int, way: int) -> int:
    """How many words from ``at`` on, going ``way`` (1 or -1), equal the words ``lag`` later."""
    total, step = 0, STEP
    while True:
        if way > 0:
            a, b = at + total, min(at + total + step, len(ids) - lag)
        else:
            a, b = max(at - total - step + 1, 0), at - total + 1
        if a >= b:
            return total
        differ = np.nonzero(ids[a:b] != ids[a + lag:b + lag])[0]
        if len(differ):
            return total + int(differ[0] if way > 0 else b - a - 1 - differ[-1])
        total, step = total + b - a, step * 2


def seeds(ids: np.ndarray, longest: int, least: int, times: int):
    """(k, lag, place) arrays of the seeds: a k-gram and its next occurrence in the same text, ``lag`` words on.

    A run of period q holds at least max(least, times * q) - q words that equal the word q later.  Of all q the least such
    overlap is the first k; it serves lags up to k.  Lags of (k, 2k] overlap in 2k words or more, so each further k is twice the last.
    As k >= q, a k-gram inside a run of smallest period q cannot occur again after fewer than q words, or the run
    had a smaller period: its next occurrence is the one q words on, and neighbouring occurrences are all the pairs that are needed.
    """
    first = min(max(least - q, (times - 1) * q) for q in range(1, max(least, 2)))
    often = np.bincount(ids, minlength=1) >= times  # every word of a run occurs so often
    names = np.where(often[ids], ids, -1)
    size = 1
    while size * 2 <= first:
        names = joined(names, np.nonzero(names >= 0)[0], size)
        size *= 2
    if size < first:
        names = joined(names, np.nonzero(names >= 0)[0], first - size)
    k, low = first, 0
    while times * (low + 1) <= longest:
        at = np.nonzero(names >= 0)[0]
        if not len(at):
            return
        order = at[np.argsort(names[at], kind="stable")]
        lag = order[1:] - order[:-1]
        good = (names[order[1:]] == names[order[:-1]]) & (lag > low) & (lag <= k)
        yield k, lag[good], order[:-1][good]
        names = joined(names, at, k)
        k, low = 2 * k, k


def runs(ids: np.ndarray, starts: np.ndarray, least: int, times: int) -> np.ndarray:
    """(start, length, period) rows in order of start, then period; starts count over all texts."""
    longest = int(np.diff(starts).max()) if len(starts) > 1 else 0
    found = []
    for k, lags, places in seeds(ids, longest, least, times):
        order = np.lexsort((places, lags))
        lags, places = lags[order], places[order]
        head = np.ones(len(lags), bool)  # a seed right after one of its lag lies within that one's extension
        head[1:] = (lags[1:] != lags[:-1]) | (places[1:] != places[:-1] + 1)
        covered: dict[int, int] = {}  # per lag, the first word that no extension has reached
        for lag, at in zip(lags[head].tolist(), places[head].tolist()):
            if at < covered.get(lag, 0):
                continue
            start = at - reach(ids, at - 1, lag, -1)
            end = at + k + reach(ids, at + k, lag, 1)
            covered[lag] = end
            if end + lag - start >= max(least, times * lag):
                found.append((start, end + lag - start, lag))
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def find(df: DataFrame, text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """The columns of ``df`` with its text, and three columns on the runs of it.

    ``n_words`` (int), ``runs`` (array of struct<start, length, period>, in order of start, then period) and ``collapsed``,
    the words joined by one space without those that any run holds after its first ``period`` words.  A run is
    a stretch of words that are equal to those ``period`` words on, which is its smallest period; it cannot be made longer, and
    has ``least`` words and ``times`` (3 at least) periods or more.  Words are what white space (blank and U+0009 to U+000D) separates.

    Null and empty texts have no words, no runs and an empty ``collapsed``.  Rows are looked at on their own, so repeated rows
    and ids do not matter.  Columns of ``df`` named as the three are replaced.  A text of any length is one piece of work; memory
    is bounded by the longest.  An empty table gives an empty one.
    """
    if times < 3 or least < times:
        raise ValueError("a run needs three periods at least, and as many words")
    keep = [f for f in df.schema.fields if f.name.lower() not in ("n_words", "runs", "collapsed")]
    if text_col not in [f.name for f in keep]:
        raise ValueError("the text column has the name of a result")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    row = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("period", pa.int32())])

    def run(batches):
        for batch in slices(batches, text_col):
            texts = [(t or b"").split() for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            ids, starts = numbered(texts)
            all_runs = runs(ids, starts, least, times)
            of = np.searchsorted(starts, all_runs[:, 0], "right") - 1
            gone = np.zeros(len(ids) + 1, np.int64)
            np.add.at(gone, all_runs[:, 0] + all_runs[:, 2], 1)
            np.add.at(gone, all_runs[:, 0] + all_runs[:, 1], -1)
            stay = np.cumsum(gone[:-1]) == 0
            collapsed = []
            for i, words in enumerate(texts):
                here = stay[starts[i]:starts[i + 1]]
                collapsed.append(b" ".join(words if here.all() else itertools.compress(words, here.tolist())))
            offsets = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in
                                                 (all_runs[:, 0] - starts[of], all_runs[:, 1], all_runs[:, 2])], fields=list(row))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in keep] + [pa.array(np.diff(starts).astype(np.int32)), pa.ListArray.from_arrays(offsets, values),
                                                        pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=[f.name for f in keep] + ["n_words", "runs", "collapsed"])

    out = f"{schema}, n_words int, runs array<struct<start:int,length:int,period:int>>, collapsed string"
    return df.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(give_back(run), out)


def strongest(runs_col: str = "runs"):
    """The run of greatest length by period, compared exactly; ties go to the smaller start, then the smaller period."""
    def better(a, b):
        left, right = a["length"].cast("long") * b["period"], b["length"].cast("long") * a["period"]
        return F.when(a["period"].isNull(), True).otherwise(right > left)  # runs come in order of start and period

    none = F.lit(None).cast("struct<start:int,length:int,period:int>")
    return F.aggregate(runs_col, none, lambda a, b: F.when(better(a, b), b).otherwise(a))


def listed(runs_col: str = "runs"):
    """Every run as ``start,length,period`` and a line feed, one after another."""
    return F.array_join(F.transform(runs_col, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
