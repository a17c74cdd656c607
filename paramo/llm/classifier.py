"""Document quality by supervised subword embeddings."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramo.llm.common import per_text, unused

#: Rows of the embedding table; words, word pairs and character n-grams are hashed into it.
BUCKETS = 1 << 16
DIM = 16
GRAMS = (3, 4)
#: Known words a task keeps before it starts afresh.
KNOWN = 200_000
#: Words of a text that are looked at together; bounds the memory of a very long text.
BLOCK = 1 << 16
#: New words whose features are summed together.
NEW_WORDS = 8192


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how many each word has): of every word itself, which comes first, and of the character
    n-grams of ``<word>``, word after word."""
    own = np.array([zlib.crc32(w) % BUCKETS for w in words], np.int64)
    # a word holds no blank, so blanks mark where words begin
    letters = np.frombuffer((b" <" + b"> <".join(words) + b"> ").decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
    blank = letters == 32
    number = np.cumsum(blank) - 1
    blanks = np.concatenate(([0], np.cumsum(blank)))
    ids, of = [own], [np.arange(len(words))]
    for n in GRAMS:
        starts = np.nonzero(blanks[n:] == blanks[:-n])[0] if len(letters) >= n else np.zeros(0, np.int64)
        code = np.full(len(starts), n, np.uint64)
        for k in range(n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + letters[starts + k]
        code ^= code >> np.uint64(29)
        ids.append(((code * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64))
        of.append(number[starts])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(ids)[order], np.bincount(of, minlength=len(words))


@dataclass
class Model:
    """Embedding rows, output layer and bias; ``classes`` are the labels in the order of the outputs."""

    table: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    classes: np.ndarray


class Reader:
    """Turns texts into feature sums; what is known of a word is kept between texts."""

    def __init__(self, model: Model):
        self.model = model
        self.number: dict[bytes, int] = {}
        self.sums = np.zeros((0, model.table.shape[1]))
        self.counts = np.zeros(0)
        self.codes = np.zeros(0, np.uint64)

    def _learn(self, texts: list[list[bytes]]) -> None:
        if len(self.number) > KNOWN:
            self.__init__(self.model)
        new = list(dict.fromkeys(w for words in texts for w in words if w not in self.number))
        if not new:
            return
        sums, counts, codes = [self.sums], [self.counts], [self.codes]
        for at in range(0, len(new), NEW_WORDS):
            flat, sizes = features(new[at:at + NEW_WORDS])
            begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            sums.append(np.add.reduceat(self.model.table[flat].astype(float), begins, axis=0))
            counts.append(sizes)
            codes.append(flat[begins].astype(np.uint64))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.sums, self.counts, self.codes = np.concatenate(sums), np.concatenate(counts), np.concatenate(codes)

    def _mean(self, words: list[bytes]) -> np.ndarray:
        """The mean of the vectors of all features of a text; 0 without words."""
        total, n, last = np.zeros(self.model.table.shape[1]), 0, None
        for at in range(0, len(words), BLOCK):
            ids = np.array([self.number[w] for w in words[at:at + BLOCK]])
            total += self.sums[ids].sum(axis=0)
            n += self.counts[ids].sum()
            codes = self.codes[ids]
            if last is not None:
                codes = np.concatenate(([last], codes))
            if len(codes) > 1:
                total += self.model.table[pairs(codes)].sum(axis=0, dtype=float)
                n += len(codes) - 1
            last = codes[-1]
        return total / max(n, 1)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        split = [(t or b"").split() for t in texts]
        self._learn(split)
        m = self.model
        return softmax(np.array([self._mean(words) for words in split]).reshape(len(texts), -1) @ m.out + m.bias)


def pairs(codes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words.  A word beside itself has a bucket of its own, whatever the word."""
    a, b = codes[:-1], codes[1:]
    mixed = (a * np.uint64(116049371) + b) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return np.where(a == b, np.uint64(0), mixed % np.uint64(BUCKETS)).astype(np.int64)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bag(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text and their shares."""
    words = (text or b"").split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.array([number[w] for w in words])
    flat, sizes = features(list(number))
    ids, times = [flat], [np.repeat(np.bincount(at), sizes)]
    if len(words) > 1:
        codes = flat[np.concatenate(([0], np.cumsum(sizes)[:-1]))].astype(np.uint64)
        ids.append(pairs(codes[at]))
        times.append(np.ones(len(words) - 1, np.int64))
    found, place = np.unique(np.concatenate(ids), return_inverse=True)
    n = np.bincount(place, weights=np.concatenate(times))
    return found.astype(np.int32), (n / n.sum()).astype(np.float32)


def train(texts: list[bytes | None], labels: np.ndarray, epochs: int, rate: float, seed: int) -> Model:
    """Stochastic gradient descent on the softmax loss, one document at a time, the rate falling linearly.

    ``texts`` is emptied from its end; ``labels`` are in that order."""
    rng = np.random.default_rng(seed)
    classes, y = np.unique(labels, return_inverse=True)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    bags = []
    while texts:  # a text is let go once its features are known
        bags.append(bag(texts.pop()))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            ids, share = bags[i]
            hidden = share @ table[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1  # the gradient of the loss by z
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= lr * np.float32(0.1) * p
            if len(ids):
                table[ids] -= lr * np.outer(share, back) * np.float32(len(ids) ** 0.5)
    return Model(table, out, bias, classes)


def fit(labelled: DataFrame, most: int = 2000, epochs: int = 8, rate: float = 0.5, seed: int = 42) -> Model | None:
    """A model of (id, text, label) rows, or None if fewer than two labels occur.

    ``most`` bounds the rows learnt from: those of the least hashes of their ids.  One task trains; only the
    model, whose size is fixed, comes to the driver.  Rows without a label are not learnt from.
    """
    rows = labelled.where("label IS NOT NULL").withColumn("_h", F.xxhash64(F.lit(seed), "id"))
    chosen = rows.orderBy("_h", "id").limit(most)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "id"])
        texts = [None if t is None else t.encode() for t in pdf["text"]]
        labels = pdf["label"].to_numpy()[::-1].copy()  # texts are taken from the end
        del pdf
        m = train(texts, labels, epochs, rate, seed)
        return pd.DataFrame({"table": [m.table.tobytes()], "out": [m.out.tobytes()], "bias": [m.bias.tobytes()],
                             "classes": [m.classes.astype(np.int64).tolist()]})

    found = chosen.groupBy(F.lit(0).alias("_all")).applyInPandas(run, "table binary, out binary, bias binary, classes array<long>").first()
    if found is None or len(found["classes"]) < 2:
        return None
    def as_array(raw, *shape):
        return np.frombuffer(bytes(raw), np.float32).reshape(shape)

    k = len(found["classes"])
    return Model(as_array(found["table"], BUCKETS, DIM), as_array(found["out"], DIM, k), as_array(found["bias"], k), np.array(found["classes"]))


def score(df: DataFrame, model: Model | None, text_col: str, positive: int = 1, name: str = "score", keep_text: bool = False) -> DataFrame:
    """``df`` with ``name``, the probability of label ``positive`` (0.5 without a model), and without its text unless it is kept."""
    df = df.drop(name) if name in df.columns else df
    if model is None:
        return (df if keep_text else df.drop(text_col)).withColumn(name, F.lit(0.5))
    column = int(np.nonzero(model.classes == positive)[0][0]) if positive in model.classes else None
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        reader = getattr(run, "reader", None)
        if reader is None:
            reader = run.reader = Reader(held.value)
        return [[0.0] * len(texts) if column is None else reader.scores(texts)[:, column].tolist()]

    return per_text(df, text_col, run, f"`{name}` double", keep_text)


def held_out(id_col: Column) -> Column:
    """Every fifth id by CRC-32 of its text; ids that are null are held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(True))


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
            threshold: float = 0.3, **how) -> DataFrame:
    """(id_col, held_out, score, predicted), one row per row of ``df``.

    A text's feature vectors (words, neighbouring words, character n-grams, all hashed into one learned
    table) are averaged over the whole text and put through a softmax layer.  The model learns from the
    labelled rows that are not held out, at most ``most`` of them (see ``fit``); ids whose labels contradict
    each other are not learnt from.  Only the text enters a score.  ``predicted`` is 1 from ``threshold`` on.

    Null and empty texts have the zero vector and so the score of the bias.  Without two labels every score is
    0.5.  Repeated rows get equal scores.  Other columns are not read.  An empty table gives an empty one.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit(training(own, labels, id_col, label_col, **{k: how[k] for k in ("most", "seed") if k in how}), **how)
    scored = score(own, model, "text")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def training(own: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int = 2000, seed: int = 42) -> DataFrame:
    """(id, text, label) of the labelled ids that are not held out; texts are fetched for twice ``most`` ids only,
    so that enough remain where a labelled id has no text."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(~held_out(F.col("id")) & F.col("label").isNotNull())
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most").drop("_most")
    few = known.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(2 * most)
    # at most 2 * most rows of two numbers: safe to broadcast
    return own.join(F.broadcast(few), "id")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             threshold: float = 0.3, **how) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject; scoring reads the text beside the row, so nothing is joined."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit(training(own, labels, id_col, label_col, **{k: how[k] for k in ("most", "seed") if k in how}), **how)
    columns = docs.columns
    name = unused("_score", docs)
    scored = score(docs, model, text_col, name=name, keep_text=True)
    return scored.where(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in columns])
