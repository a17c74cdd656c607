"""Toxic spans by a linear-chain conditional random field over words, and toxicity of documents by its marginals."""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paramo.llm.common import give_back, slices

#: Weights of word features; a feature is a hash into this table.
BUCKETS = 1 << 20
#: A word's features: the word itself, its beginnings of these lengths, and its last letters.
BEGINNINGS = range(3, 9)
ENDING = 3
#: Signs around a word that are not part of it.
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A task forgets the words it knows beyond this many.
KNOWN = 300_000
#: Sequences of words end at a word that ends so, or after so many words.
FULL_STOPS, LONGEST = b".!?", 64
#: A feature marks toxic words if its share of toxic texts is so many times that of others, with so many toxic texts (or
#: this share of them).  Features are taken until no more texts gain one of their first COVER marks.
LIFT, LEAST_TEXTS, LEAST_SHARE, COVER = 20, 3, 0.005, 3
#: A word is reported from this marginal probability on.
OFFENDING = 0.5


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, how many each word has).  Case and signs around a word do not matter; a word of signs has none."""
    plain = [w.strip(SIGNS).decode("utf-8", "replace").lower() for w in words]
    size = np.array([len(w) for w in plain], np.int64)
    letters = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    start = np.cumsum(size) - size
    ids, of = [], []

    def add(kind, code, which):
        code = (code + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        ids.append((code >> np.uint64(40)).astype(np.int64) % BUCKETS)
        of.append(which)

    full = np.nonzero(size > 0)[0]
    add(0, np.array([zlib.crc32(plain[i].encode("utf-8", "replace")) for i in full.tolist()], np.uint64) << np.uint64(8), full)
    code = np.zeros(len(plain), np.uint64)
    for n in range(1, max(BEGINNINGS) + 1):
        which = np.nonzero(size >= n)[0]
        code[which] = code[which] * np.uint64(0x100000001B3) + letters[start[which] + n - 1] + np.uint64(1)
        if n in BEGINNINGS:
            add(n, code[which], which)
    which = np.nonzero(size >= ENDING)[0]
    code = np.zeros(len(which), np.uint64)
    for n in range(ENDING):
        code = code * np.uint64(0x100000001B3) + letters[start[which] + size[which] - ENDING + n] + np.uint64(1)
    add(99, code, which)
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(ids)[order], np.bincount(of, minlength=len(words))


@dataclass
class Model:
    """Weights of word features for the toxic state against the other, of the states at a start and of steps between them, and how
    the number and the highest probability of toxic words make a score."""

    weights: np.ndarray
    start: float
    steps: np.ndarray
    score: np.ndarray


class Chains:
    """Sequences of words of equal layout, ready for passes over all of them position by position."""

    def __init__(self, stops: np.ndarray, starts: np.ndarray):
        """``stops`` marks words that end a sequence, ``starts`` where each text starts, and the end."""
        n = len(stops)
        new = np.zeros(n + 1, bool)
        new[starts] = True
        new[1:n + 1] |= stops
        begins = np.nonzero(new[:n])[0]
        size = np.diff(np.append(begins, n))
        # long ones are cut at fixed lengths from their start
        pieces = -(-size // LONGEST)
        at = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begins = np.repeat(begins, pieces) + at * LONGEST
        size = np.minimum(np.repeat(size, pieces) - at * LONGEST, LONGEST)
        order = np.argsort(-size, kind="stable")
        self.begins, self.n = begins[order], n
        longest = int(size.max()) if len(size) else 0
        self.active = len(size) - np.searchsorted(np.sort(size), np.arange(longest), "right")  # sequences longer than each position
        # words are laid out position by position, so that a pass reads them in blocks
        self.edges = np.concatenate(([0], np.cumsum(self.active))).tolist()
        self.order = np.concatenate([self.begins[:m] + k for k, m in enumerate(self.active)]) if longest else np.zeros(0, np.int64)

    def marginals(self, emit: np.ndarray, start: float, steps: np.ndarray):
        """(probability of the toxic state of each word, sum of the expected steps, expected toxic starts, log normaliser).

        ``emit`` is a word's weight for the toxic state, ``start`` that of a toxic start, ``steps[s, t]`` that of a step from s to t."""
        if not self.n:
            return np.zeros(0), np.zeros((2, 2)), 0.0, 0.0
        (a, b), (c, d) = np.exp(steps)
        e = np.exp(np.clip(emit, -30, 30))[self.order]
        edges, sizes = self.edges, self.active.tolist()
        f0, f1, scale = np.ones(self.n), np.exp(start) * e, np.ones(self.n)  # right at the first position
        for k, m in enumerate(sizes):
            x = slice(edges[k], edges[k] + m)
            if k:
                before = slice(edges[k - 1], edges[k - 1] + m)
                f0[x] = a * f0[before] + c * f1[before]
                f1[x] = (b * f0[before] + d * f1[before]) * e[x]
            scale[x] = f0[x] + f1[x]
            f0[x] /= scale[x]
            f1[x] /= scale[x]
        b0, b1 = np.ones(self.n), np.ones(self.n)
        expected = np.zeros((2, 2))
        for k in range(len(sizes) - 1, 0, -1):
            m = sizes[k]
            x, before = slice(edges[k], edges[k] + m), slice(edges[k - 1], edges[k - 1] + m)
            r0, r1 = b0[x] / scale[x], b1[x] * e[x] / scale[x]
            expected += [[a * (f0[before] @ r0), b * (f0[before] @ r1)], [c * (f1[before] @ r0), d * (f1[before] @ r1)]]
            b0[before] = a * r0 + b * r1
            b1[before] = c * r0 + d * r1
        toxic = np.empty(self.n)
        toxic[self.order] = f1 * b1
        return toxic, expected, float(toxic[self.begins].sum()), float(np.log(scale).sum())


class Reader:
    """Turns texts into word numbers; what is known of a word is kept between texts."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.known = 0
        self.stops, self.emit = np.zeros(0, bool), np.zeros(0)

    def read(self, texts: list[bytes | None]):
        """(words of all texts by number, where each text starts, and the end)."""
        if len(self.number) > KNOWN:
            self.forget()
        number = self.number
        ids = [np.array([number[w] for w in (t or b"").split()], np.int64) for t in texts]
        new = list(itertools.islice(number, self.known, None))
        self.known = len(number)
        self.stops = np.concatenate([self.stops, np.array([w[-1] in FULL_STOPS for w in new], bool)])
        if self.weights is not None and new:
            flat, sizes = word_features(new)
            # sums in the order of a word's features, so that a word weighs the same wherever it is met
            self.emit = np.concatenate([self.emit, np.bincount(np.repeat(np.arange(len(new)), sizes), weights=self.weights[flat], minlength=len(new))])
        return np.concatenate(ids) if ids else np.zeros(0, np.int64), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)


def summary(toxic: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text: the expected number of toxic words as a logarithm, and the highest probability of one."""
    out = np.zeros((len(starts) - 1, 2))
    full = np.nonzero(np.diff(starts))[0]
    if len(full):
        out[:, 0] = np.log1p(np.bincount(np.repeat(np.arange(len(out)), np.diff(starts)), weights=toxic, minlength=len(out)))
        out[full, 1] = np.maximum.reduceat(toxic, starts[full])
    return out


def marks(ids: np.ndarray, starts: np.ndarray, labels: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each known word is taken for toxic where a toxic text has it: whether it has one of the features that set toxic texts apart.

    Features are taken one after another, the one that most texts still need first, so that what merely stands beside toxic words in a few
    texts, or in copies of one, is not."""
    docs = len(labels)
    of = np.repeat(np.arange(docs), np.diff(starts))
    pairs = np.unique(of * (len(sizes) + 1) + ids)
    doc, word = pairs // (len(sizes) + 1), pairs % (len(sizes) + 1)
    ends = np.cumsum(sizes)
    place = np.arange(int(sizes[word].sum())) - np.repeat(np.cumsum(sizes[word]) - sizes[word], sizes[word]) + np.repeat((ends - sizes)[word], sizes[word])
    both = np.unique(flat[place] * docs + np.repeat(doc, sizes[word]))
    feature, doc = both // docs, both % docs
    positive = labels[doc] == 1
    n1, n0 = max(int((labels == 1).sum()), 1), max(int((labels != 1).sum()), 1)
    in1, in0 = np.bincount(feature[positive], minlength=BUCKETS), np.bincount(feature[~positive], minlength=BUCKETS)
    apart = (in1 >= max(LEAST_TEXTS, LEAST_SHARE * n1)) & (in1 * n0 >= LIFT * (in0 + 0.5) * n1)
    keep = positive & apart[feature]
    feature, doc = feature[keep], doc[keep]
    need = np.full(docs, COVER)
    taken = np.zeros(BUCKETS, bool)
    order = np.argsort(feature, kind="stable")
    names, begin = np.unique(feature[order], return_index=True)
    lists = dict(zip(names.tolist(), np.split(doc[order], begin[1:])))
    while lists:
        gain = np.bincount(feature, weights=need[doc] > 0, minlength=BUCKETS)
        # of features that gain alike, the one with the fewest other texts, then the least number
        best = max(lists, key=lambda f: (gain[f], -in0[f], -f))
        if gain[best] < 2:
            break
        taken[best] = True
        need[lists.pop(best)] -= 1
        # what is found in the same texts says nothing new
        same = [f for f in lists if len(lists[f]) and len(lists[f]) >= 0.9 * in1[best] and gain[f] >= 0.9 * gain[best] and in1[f] <= in1[best]]
        here = np.zeros(docs, bool)
        here[doc[feature == best]] = True
        for f in same:
            if here[lists[f]].mean() > 0.9:
                del lists[f]
    hit = np.concatenate(([0], np.cumsum(taken[flat])))
    return hit[ends] - hit[ends - sizes] > 0


def train(texts: list[bytes | None], labels: np.ndarray, rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> Model:
    """A field fitted to the words that ``marks`` takes for toxic, by gradient steps over all sequences."""
    seen, chosen = set(), []
    for i, text in enumerate(texts):  # copies are learnt from once
        sketches = shingle_sketches(text)
        if not sketches & seen:
            chosen.append(i)
        seen |= sketches
    texts, labels = [texts[i] for i in chosen], labels[chosen]
    reader = Reader()
    ids, starts = reader.read(texts)
    words = list(reader.number)
    flat, sizes = word_features(words)
    toxic_word = marks(ids, starts, labels, flat, sizes)
    truth = (toxic_word[ids] & np.repeat(labels == 1, np.diff(starts))).astype(float)
    chains = Chains(reader.stops[ids], starts)
    owner = np.repeat(np.arange(len(words)), sizes)
    used, feature = np.unique(flat, return_inverse=True)
    weights, steps, start = np.zeros(len(used)), np.zeros((2, 2)), 0.0
    first = np.zeros(len(ids), bool)
    first[chains.begins] = True
    inner = np.nonzero(~first)[0]
    told = np.zeros((2, 2))
    np.add.at(told, (truth[inner - 1].astype(int), truth[inner].astype(int)), 1)
    bias = 0.0
    sums = [np.zeros(len(used)), np.zeros((2, 2)), 0.0, 0.0]
    scale = 1 / max(truth.sum(), 1)  # a step is measured by the toxic words, which are few
    for r in range(rounds):
        emit = np.bincount(owner, weights=weights[feature], minlength=len(words)) + bias
        toxic, expected, toxic_starts, _ = chains.marginals(emit[ids], start, steps)
        rest = np.bincount(ids, weights=toxic - truth, minlength=len(words))
        slopes = [np.bincount(feature, weights=rest[owner], minlength=len(used)) * scale + decay * weights, (expected - told) * scale + decay * steps,
                  (toxic_starts - truth[chains.begins].sum()) * scale, rest.sum() * scale]
        moves = []
        for k, slope in enumerate(slopes):
            sums[k] = sums[k] + slope * slope
            moves.append(rate * (1 - r / rounds) * slope / np.sqrt(sums[k] + 1e-12))
        weights, steps, start, bias = weights - moves[0], steps - moves[1], start - moves[2], bias - moves[3]
    emit = np.bincount(owner, weights=weights[feature], minlength=len(words)) + bias
    toxic = chains.marginals(emit[ids], start, steps)[0]
    table = np.zeros(BUCKETS)
    table[used] = weights
    # the bias belongs to every word: a start and every step to the toxic state carry it
    steps = steps + np.array([[0, bias], [0, bias]])
    return Model(table, start + bias, steps, fitted_score(summary(toxic, starts), labels == 1))


def fitted_score(x: np.ndarray, y: np.ndarray, rounds: int = 50, decay: float = 0.05) -> np.ndarray:
    """Weights of a logistic model by Newton's steps: of 1 and of the columns of ``x``."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + decay * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w)), slope)
    return w


def shingle_sketches(text: bytes | None, k: int = 5, n: int = 4) -> set:
    """``n`` least hashes of the runs of ``k`` words; texts that share most runs share some of them."""
    words = (text or b"").split()
    hashes = np.array([zlib.crc32(b" ".join(words[i:i + k])) for i in range(max(len(words) - k + 1, 1))], np.uint64)
    return {(i, int(((hashes * np.uint64(2 * i + 0x9E3779B97F4A7C15)) >> np.uint64(20)).min())) for i in range(n)}


def held_out(id_col: Column) -> Column:
    """Every id whose CRC-32 leaves 1 when divided by 3; ids that are null are held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(True))


def training(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, most_bytes: int, seed: int) -> DataFrame:
    """(text, label, _h, id) of labelled ids that are not held out: of each label the ``most`` of least hash, as far as their texts
    are ``most_bytes`` together; a text of more than an eighth of that is left out, so that it does not take the place of all others."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(~held_out(F.col("id")) & F.col("label").isNotNull())
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most").drop("_most")
    known = known.withColumn("_h", F.xxhash64(F.lit(seed), "id"))
    few = known.where("label = 1").orderBy("_h", "id").limit(most).unionAll(known.where("label <> 1").orderBy("_h", "id").limit(most))
    # 2 * most rows of three numbers at most: safe to broadcast
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")
    own = own.withColumn("_size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    # ids and sizes of a bounded number of rows; texts stay where they are until the sizes are added up
    before = Window.partitionBy("label").orderBy("_h", "id", "_text").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.select("id", "label", "_h", "_size", F.xxhash64("text").alias("_text")).where(F.col("_size") <= most_bytes // 8)
    fits = sizes.withColumn("_sum", F.coalesce(F.sum("_size").over(before), F.lit(0))).where(F.col("_sum") + F.col("_size") <= most_bytes)
    fits = fits.select("id", "_text").distinct()
    return own.withColumn("_text", F.xxhash64("text")).join(F.broadcast(fits), ["id", "_text"]).select("id", "text", "label", "_h")


def fit(rows: DataFrame, **how) -> Model | None:
    """A model of (id, text, label, _h) rows, learnt in one task; None unless toxic and other texts occur."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_h", "ascending"), ("id", "ascending")])
        labels = np.array(table.column("label").to_pylist())
        if len({bool(x == 1) for x in labels.tolist()}) < 2:
            return pa.table({"weights": pa.array([], pa.binary()), "rest": pa.array([], pa.list_(pa.float64()))})
        m = train(table.column("text").cast(pa.binary()).to_pylist(), labels, **how)
        used = np.nonzero(m.weights)[0]
        packed = np.rec.fromarrays([used.astype("<i4"), m.weights[used].astype("<f4")]).tobytes()
        return pa.table({"weights": pa.array([packed], pa.binary()), "rest": pa.array([[m.start, *m.steps.ravel(), *m.score]], pa.list_(pa.float64()))})

    found = rows.groupBy(F.lit(0).alias("_all")).applyInArrow(run, "weights binary, rest array<double>").first()
    if found is None:
        return None
    raw = np.frombuffer(bytes(found["weights"]), np.dtype([("i", "<i4"), ("w", "<f4")]))
    weights = np.zeros(BUCKETS, np.float32)
    weights[raw["i"]] = raw["w"]
    rest = np.array(found["rest"])
    return Model(weights, rest[0], rest[1:5].reshape(2, 2), rest[5:])


def rated(reader: Reader, model: Model, texts: list[bytes | None]):
    """(score of each text, probability of each word, where each text starts)."""
    ids, starts = reader.read(texts)
    toxic = Chains(reader.stops[ids], starts).marginals(reader.emit[ids], model.start, model.steps)[0]
    return 1 / (1 + np.exp(-np.clip(model.score[0] + summary(toxic, starts) @ model.score[1:], -30, 30))), toxic, starts


def offending(text: bytes, toxic: np.ndarray) -> list[dict]:
    """Code point offsets of neighbouring words that are likelier toxic than not, and the highest probability among them."""
    words, out, at, chars = text.split(), [], 0, 0
    high = toxic >= OFFENDING
    for i, w in enumerate(words):
        if not high[i]:
            continue
        place = None
        # words between are only counted when a hit is located
        for j in range(offending_from(out), i + 1):
            place = text.index(words[j], at)
            chars += len(text[at:place].decode("utf-8", "replace"))
            at = place + len(words[j])
            begin, chars = chars, chars + len(words[j].decode("utf-8", "replace"))
        if out and out[-1]["last"] == i - 1:
            out[-1] |= {"end": chars, "probability": max(out[-1]["probability"], float(toxic[i])), "last": i}
        else:
            out.append({"start": begin, "end": chars, "probability": float(toxic[i]), "last": i})
    return [{k: s[k] for k in ("start", "end", "probability")} for s in out]


def offending_from(out: list[dict]) -> int:
    return out[-1]["last"] + 1 if out else 0


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7,
          most: int = 1500, most_bytes: int = 4 << 20, seed: int = 42, **how) -> DataFrame:
    """(id_col, held_out, score, predicted, spans), one row per row of ``df``.

    A conditional random field labels each word toxic or not, in sequences that end with a sentence or after LONGEST words.  A word's
    features are itself, its beginnings and its ending, without case and signs.  Forward and backward sums give each word's probability;
    ``score`` is a logistic function of the expected number of toxic words and the highest probability, ``spans`` (array of
    struct<start, end, probability>) the code point offsets of words likelier toxic than not.  ``predicted`` is 1 from ``threshold`` on.

    Labels are of documents, so words are labelled first: in toxic texts, those with a feature that sets toxic texts apart.  The model
    learns from the labelled rows that are not held out, at most ``most`` rows of each label and ``most_bytes`` of their texts (see
    ``training``), in one task; ids whose labels contradict each other are not learnt from, copies once.  Only the text enters a score.

    Null and empty texts have no words and so the score of the constant.  Without both labels every score is 0.5 and no
    span is given.  Repeated rows get equal scores.  Other columns are not read.  An empty table gives an empty one.
    """
    out = f"id {df.schema[id_col].dataType.simpleString()}, score double, spans array<struct<start:int,end:int,probability:double>>"
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit(training(df, labels, id_col, text_col, label_col, most, most_bytes, seed), **how)
    held = df.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches):
        reader = None if held.value is None else Reader(held.value.weights)
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            scores, spans = np.full(len(texts), 0.5), [[] for _ in texts]
            if reader is not None:
                scores, toxic, starts = rated(reader, held.value, texts)
                for i in np.unique(np.searchsorted(starts, np.nonzero(toxic >= OFFENDING)[0], "right") - 1).tolist():
                    spans[i] = offending(texts[i], toxic[starts[i]:starts[i + 1]])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores), pa.array(spans, span)], names=["id", "score", "spans"])

    found = own.mapInArrow(give_back(run), out)
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "spans")
