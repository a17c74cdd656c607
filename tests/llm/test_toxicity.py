import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paramo.llm import queries, toxicity

BAD = ["vermin", "Vermin!", "verminous", "filth", "FILTH."]


def clean(rng, n):
    return [rng.choice(["of", "in", "and"]) if rng.random() < 0.4 else "".join(rng.choice("bcdgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
            + rng.choice(["", "", "", "."]) for _ in range(n)]


def corpus(rng, n):
    rows = []
    for i in range(n):
        words, toxic = clean(rng, rng.randint(5, 120)), int(rng.random() < 0.3)
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), toxic))
    return rows


def remainder(i):
    return zlib.crc32(str(i).encode()) % 3


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    n, starts = 60, np.array([0, 9, 9, 21, 34, 34, 60])
    stops = rng.random(n) < 0.25
    emit, start, steps = rng.normal(size=n) * 2, 0.4, rng.normal(size=(2, 2))
    got = toxicity.Chains(stops, starts).marginals(emit, start, steps)
    cuts = [i for i in range(n + 1) if i in (0, n) or stops[i - 1] or i in starts]
    want, pairs, first, log = np.zeros(n), np.zeros((2, 2)), 0.0, 0.0
    for a, b in itertools.pairwise(cuts):
        ways = list(itertools.product((0, 1), repeat=b - a))
        weight = np.array([np.exp(start * y[0] + sum(emit[a + k] * y[k] for k in range(b - a)) + sum(steps[p, q] for p, q in itertools.pairwise(y))) for y in ways])
        share = weight / weight.sum()
        want[a:b] = share @ np.array(ways)
        first += share @ np.array([y[0] for y in ways])
        log += np.log(weight.sum())
        for y, s in zip(ways, share):
            for p, q in itertools.pairwise(y):
                pairs[p, q] += s
    assert np.allclose(got[0], want) and np.allclose(got[1], pairs) and np.isclose(got[2], first) and np.isclose(got[3], log)


def test_long_sequences_are_cut_at_fixed_places():
    n = 3 * toxicity.LONGEST + 5
    chains = toxicity.Chains(np.zeros(n, bool), np.array([0, n]))
    assert sorted(chains.begins.tolist()) == [0, 64, 128, 192] and sorted(chains.order.tolist()) == list(range(n))
    assert toxicity.Chains(np.zeros(0, bool), np.array([0, 0])).marginals(np.zeros(0), 0.0, np.zeros((2, 2)))[0].tolist() == []


def test_features_ignore_case_and_signs():
    flat, sizes = toxicity.word_features([b"Vermin!", b"vermin", b"(VERMIN),", b"...", "É".encode(), "é".encode(), b"verminous", b"\xff\xfe"])
    rows = [set(x.tolist()) for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert rows[0] == rows[1] == rows[2] and rows[3] == set() and rows[4] == rows[5] and len(rows[4]) == 1
    assert len(rows[0] & rows[6]) == 4 and len(rows[6]) == 8  # beginnings of three to six letters


def test_copies_do_not_make_words_toxic():
    rng = random.Random(2)
    rows = corpus(rng, 300)
    copied = next(t for _, t, x in rows if x)
    texts, labels = [t for _, t, _ in rows] + [copied + f" w{i}" for i in range(80)], [x for _, _, x in rows] + [1] * 80
    model = toxicity.train([t.encode() for t in texts], np.array(labels))
    reader = toxicity.Reader(model.weights)
    rest = " ".join(w for w in copied.split() if w not in BAD)
    scores, _, _ = toxicity.rated(reader, model, [copied.encode(), rest.encode()])
    assert scores[0] > 0.7 > scores[1]


def fixture(spark, rng):
    rows = corpus(rng, 700)
    texts = [(i, t, "own", 5) for i, t, _ in rows]
    texts += [(2000, None, "own", 5), (2001, "", "own", 5), (2002, " \n ", "own", 5), (None, "vermin filth vermin", "own", 5), (3, texts[3][1], "own", 5),
              (2003, "of and in. " * 60_000 + "é vermin\tfilth of", "own", 5)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, score string, spans int")
    labels = spark.createDataFrame([(i, x, 9) for i, _, x in rows if i % 5] + [(2000, None, 9), (2001, 0, 9), (1, 0, 9), (1, 1, 9), (None, 1, 9)], "doc_id long, toxic int, text int")
    return rows, docs, labels


def test_held_out_texts_and_spans(spark):
    rows, docs, labels = fixture(spark, random.Random(7))
    found = toxicity.score(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted", "spans"]
    got = found.collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (r["doc_id"] is None or remainder(r["doc_id"]) == 1) for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    rest = [(x, by_id[i]["predicted"]) for i, _, x in rows if remainder(i) == 1]
    assert sum(x == p for x, p in rest) >= 0.98 * len(rest) and sum(x for x, _ in rest) > 40
    assert by_id[2000]["score"] == by_id[2001]["score"] == by_id[2002]["score"] < 0.3 and by_id[2000]["spans"] == []
    assert [(s["start"], s["end"]) for s in by_id[None]["spans"]] == [(0, 19)] and by_id[None]["predicted"] == 1
    at = 11 * 60_000
    assert [(s["start"], s["end"]) for s in by_id[2003]["spans"]] == [(at + 2, at + 14)]
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    for i, text, x in rows:
        if x and remainder(i) == 1 and by_id[i]["predicted"]:
            shown = [text[s["start"]:s["end"]] for s in by_id[i]["spans"]]
            assert shown and sum(w in BAD for s in shown for w in s.split()) >= 0.8 * sum(len(s.split()) for s in shown)


def test_scores_equal_a_plain_restatement(spark):
    """Every word's features by itself, every sequence by itself, state by state."""
    rows, docs, labels = fixture(spark, random.Random(7))
    model = toxicity.fit(toxicity.training(docs, labels, "doc_id", "text", "toxic", 1500, 4 << 20, 42))

    def plain(text):
        probabilities = []
        words = re.findall("[^\x20\x09-\x0D]+", text or "")
        at = 0
        while at < len(words):
            end = at
            while end < len(words) and end - at < toxicity.LONGEST and not (end > at and words[end - 1][-1] in ".!?"):
                end += 1
            emit = [sum(float(model.weights[f]) for f in toxicity.word_features([w.encode()])[0].tolist()) for w in words[at:end]]
            k = end - at
            forward, back = [np.array([1.0, np.exp(model.start + emit[0])])], [np.ones(2)]
            for t in range(1, k):
                forward.append(np.array([sum(forward[-1][s] * np.exp(model.steps[s, y]) for s in (0, 1)) * np.exp(emit[t] * y) for y in (0, 1)]))
            for t in range(k - 1, 0, -1):
                back.append(np.array([sum(np.exp(model.steps[s, y] + emit[t] * y) * back[-1][y] for y in (0, 1)) for s in (0, 1)]))
            for f, b in zip(forward, back[::-1]):
                probabilities.append((f * b)[1] / (f * b).sum())
            at = end
        x = model.score @ [1, np.log1p(sum(probabilities)), max(probabilities, default=0)]
        return 1 / (1 + np.exp(-x))

    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    for i, text, _ in rows[:120] + [(2001, "", 0), (2000, None, 0)]:
        assert got[i] == pytest.approx(plain(text), abs=1e-9)


def test_training_is_bounded_and_deterministic(spark):
    rows, docs, labels = fixture(spark, random.Random(7))
    few = toxicity.training(docs, labels, "doc_id", "text", "toxic", 20, 1 << 20, 42).collect()
    assert sorted(r["label"] for r in few).count(1) == 20 and not any(r["id"] is None or remainder(r["id"]) == 1 or r["id"] == 1 for r in few)
    small = toxicity.training(docs, labels, "doc_id", "text", "toxic", 1500, 8000, 42)
    assert all(r["n"] <= 8000 and r["widest"] <= 1000 for r in small.groupBy("label").agg(
        F.sum(F.octet_length("text")).alias("n"), F.max(F.octet_length("text")).alias("widest")).collect())
    one = {(r["doc_id"], r["score"]) for r in toxicity.score(docs, labels).collect()}
    assert one == {(r["doc_id"], r["score"]) for r in toxicity.score(docs.repartition(7, "text"), labels.repartition(3)).collect()}


def test_without_both_labels_and_without_rows(spark):
    _, docs, labels = fixture(spark, random.Random(7))
    for left in (labels.limit(0), labels.where("toxic = 0")):
        assert {(r["score"], r["predicted"], len(r["spans"])) for r in toxicity.score(docs, left).collect()} == {(0.5, 0, 0)}
    assert toxicity.score(docs.limit(0), labels).collect() == []


def test_query_finds_what_is_labelled(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.QUERIES["op13_toxicity"](spark, sf)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    joined = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] for r in joined if r["toxic"] == 1) >= 0.75 * sum(r["toxic"] for r in joined)
    assert sum(r["predicted"] for r in joined if r["toxic"] == 0) <= 0.03 * len(joined)
