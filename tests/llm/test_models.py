import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paramo.llm import caps, classifier, licences, rules

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score double, id string"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_held_out(spark):
    docs, labels = tables(spark)
    got = classifier.quality(docs, labels).toPandas().set_index("doc_id")
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got.index)
    known = labels.toPandas().set_index("doc_id").join(got)
    held = known[known.held_out]
    assert len(held) > 40 and (held.predicted == held.quality).mean() >= 0.97
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_quality_learns_from_text_of_learnt_rows_only(spark):
    docs, labels = tables(spark)
    a = classifier.quality(docs, labels, most=200).orderBy("doc_id").toPandas()
    turned = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    b = classifier.quality(docs.withColumn("lang", F.lit("xx")), turned, most=200).orderBy("doc_id").toPandas()
    assert (a.score == b.score).all()


def test_quality_odd_rows(spark):
    rows = [(i, ("good plain words here " if i % 2 else "BAD!! ### ") * 30, 0.0, "z") for i in range(60)] + [
        (60, None, 0.0, "z"), (61, "", 0.0, "z"), (None, "good plain words", 0.0, None), (3, "good plain words here " * 30, 0.0, "z"), (62, "word " * 300_000, 0.0, "z")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    out = classifier.quality(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(rows)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[60]["score"] == got[61]["score"] and got[None]["held_out"]
    assert all(got[i]["predicted"] == i % 2 for i in range(10, 60))
    kept = classifier.accepted(docs, labels)
    assert kept.columns == docs.columns and 11 in {r["doc_id"] for r in kept.collect()} and 10 not in {r["doc_id"] for r in kept.collect()}
    none = classifier.quality(docs, labels.where("quality = 1"))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert classifier.quality(docs.limit(0), labels).count() == 0 and classifier.quality(docs, labels.limit(0)).count() == len(rows)


def test_word_features_do_not_depend_on_neighbours():
    words = [b"abc", b"x", "é€".encode(), b"<y>", b"a" * 100]
    flat, sizes = classifier.features(words)
    assert flat.tolist() == [b for w in words for b in classifier.features([w])[0].tolist()] and sizes.sum() == len(flat)


# --- quality rules -------------------------------------------------------------------


def own_statistics(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {j for v in windows.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def odd_texts():
    rng = random.Random(2)
    rows = [" ".join(rng.choice("ab ba cc # $x é\n".split(" ")) for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    return [*rows, None, "", " \n\t\x0b\x0c\r ", "a a a a", "a b", "x\n\nx\r\nx\nx", "    |", "w " * 100_000, "😀 😀 😀 😀"]


def test_statistics_against_brute_force(spark):
    rows = list(enumerate(odd_texts()))
    got = rules.statistics(spark.createDataFrame([(i, t, 0.0, "q") for i, t in rows], DOCS), "doc_id", "text").collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == own_statistics(rows[r["id"]][1]), r
    plan = rules.statistics(spark.createDataFrame([(1, "a", 0.0, "q")], DOCS), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_rules_reject_what_is_labelled_bad(spark):
    docs, labels = tables(spark)
    got = rules.judged(docs, labels).toPandas().set_index("doc_id").join(labels.toPandas().set_index("doc_id"), how="inner")
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]]
    held = held[~held.base_failed]
    assert (held.kept == (held.quality == 1)).mean() >= 0.97
    base = (got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words)
    assert (base == got.base_failed).all() and not got[got.base_failed].kept.any()


def test_rules_odd_rows(spark):
    rows = [(i, t, 0.0, "q") for i, t in enumerate(odd_texts())] + [(None, "a " * 60, 0.0, "q"), (1, "same id", 0.0, "q")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 0)], "doc_id long, quality int")
    out = rules.judged(docs, labels)
    assert out.count() == len(rows) and out.where("rule IS NOT NULL").count() == 0
    assert rules.judged(docs.limit(0), labels).count() == 0
    rule = rules.Rule((rules.Condition("_a", True, 1.0), rules.Condition("_b", False, 2.0)), 1.0)
    frame = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0), (1.0, 0.0)], "_a double, _b double")
    assert [r[0] for r in frame.select(rules.fired([rule])).collect()] == ["a > 1 AND b <= 2", None, None]


# --- cap filters ---------------------------------------------------------------------


def own_links(rows, least=0.93):
    ids = sorted({i for i, v, l in rows if i is not None})
    links, up = {i: set() for i in ids}, {i: i for i in ids}
    good = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and v and l is not None and None not in v and np.isfinite(v).all() and any(v)]

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x, l in good:
        for j, y, m in good:
            if i < j and l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[i].add(j), links[j].add(i)
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(links[i]), root(i)) for i in ids}


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(120):
        base = rng.normal(size=64)
        for c in range(rng.choice([1, 1, 1, 3, 12])):
            v = base + rng.normal(size=64) * 0.15 * (c > 0)
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(k % 3)))
    hot = rows[0][1]
    rows += [(len(rows) + k, hot, 0) for k in range(60)]
    n = len(rows)
    return rows + [(n, None, 0), (n + 1, [0.0] * 64, 0), (n + 2, [float("nan")] * 64, 0), (n + 3, [None] + [1.0] * 63, 0),
                   (n + 4, [float("inf")] * 64, 0), (n + 5, hot, None), (n + 6, [], 0), (n + 7, hot[:32], 0), (n + 8, [1.0], 0), (n + 9, [2.0], 0)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 1) for i, v, l in rows], "vec_id long, embedding array<float>, label int, n_links int")


def test_caps_against_all_pairs(spark):
    rows = vectors()
    want = own_links(rows)
    for tile in (16, 1024):
        got = {r["vec_id"]: r for r in caps.near_duplicates(frame(spark, rows), tile=tile).collect()}
        found, all_ = sum(r["n_links"] for r in got.values()), sum(n for n, _ in want.values())
        assert found >= 0.97 * all_ and all(got[i]["n_links"] <= n for i, (n, _) in want.items())
        assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
        assert sum(got[i]["component_id"] == c for i, (_, c) in want.items()) >= 0.97 * len(want)


def test_caps_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (1, v, 0), (2, v, 0), (None, v, 0), (3, [-1.0, 0.0, 0.0], 0)]
    got = sorted([tuple(r) for r in caps.near_duplicates(frame(spark, rows)).collect()], key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True), (3, 0, 3, True)], key=str)
    assert caps.near_duplicates(frame(spark, [])).count() == 0


def test_list_decoding_finds_every_exceeded_filter():
    code = caps.random_code(48, 512, 4, 1)
    x = caps.unit(np.random.default_rng(0).normal(size=(30, 48)))
    rows, found = code.exceeded(x)
    a, b = code.products(x)
    sums = (a[:, :, None] + b[:, None, :]).reshape(30, -1)
    least = np.minimum(code.least, np.sort(sums, axis=1)[:, -caps.NEAREST] - 1e-12)
    assert set(zip(rows.tolist(), found.tolist())) == {(int(i), int(k)) for i, k in zip(*np.nonzero(sums >= least[:, None]))}


# --- licences ------------------------------------------------------------------------


def test_licences_of_planted_lines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = licences.scan(docs).where("confirmed").toPandas()
    texts = docs.toPandas().set_index("doc_id").text
    lines = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
             "GPL": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0."}
    for family, line in lines.items():
        want = {(i, k) for i, t in texts.items() for k, x in enumerate((t or "").split("\n")) if x.strip() == line}
        mine = got[got.family == family]
        assert want and want <= set(zip(mine.doc_id, mine.paragraph))
    marks = re.compile("licen|copyright|GNU|CC BY|rights reserved", re.I)
    assert all(marks.search(texts[r.doc_id].split("\n")[r.paragraph]) for r in got.itertuples())


def test_licences_odd_rows(spark):
    model = licences.train([x.split() for x in (b"some plain words here", b"other words in a line", b"the of and to in that")])
    mit = "# " + licences.TEMPLATES["MIT"][3]
    rows = [(1, mit), (1, mit), (2, None), (3, ""), (4, "\n\n" + mit + "\nplain words after it"), (None, mit), (5, "The driving license expired in March.")]
    docs = spark.createDataFrame([(i, t, 0.0, "q") for i, t in rows], DOCS)
    got = [(r["doc_id"], r["paragraph"], r["family"]) for r in licences.scan(docs, model=model).where("confirmed").collect()]
    assert sorted(got, key=str) == sorted([(1, 0, "MIT"), (1, 0, "MIT"), (4, 2, "MIT"), (None, 0, "MIT")], key=str)
    assert licences.scan(docs.limit(0)).count() == 0


def test_licences_of_templates_alone_on_a_line(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts] + [("MIT", "MIT License"), ("BSD", "BSD License")]
    rows = spark.createDataFrame([(i, f"Thank you\n\n{t}\nhello\n-") for i, (_, t) in enumerate(lines)], "doc_id long, text string")
    got = licences.scan(rows, model=licences.fit(docs, "doc_id", "text")).where("confirmed").collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in got) == [(i, 2, f) for i, (f, _) in enumerate(lines)]


def own_scores(model, line):
    """The classes' probabilities by plain lists: every n-gram of words once, by its hash."""
    w = [model_word(x) for x in line.lower().encode().split()]
    grams = {tuple(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
    hashes, at = set(), {int(k): i for i, k in enumerate(model.keys)}
    for gram in grams:
        mixed = 0
        for code in gram:
            mixed = (mixed ^ code) * 0x9E3779B97F4A7C15 % (1 << 64)
            mixed ^= mixed >> 31
        hashes.add(mixed)
    z = [(sum(float(model.weights[at[h], k]) for h in hashes if h in at) / len(hashes) ** 0.5 + float(model.bias[k])) / model.temperature for k in range(len(model.classes))]
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


def model_word(word):
    return zlib.crc32(word.strip(licences.STRIP) or word) + 1


@pytest.fixture(scope="module")
def licence_model(spark):
    return licences.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text")


def test_licence_scores_equal_plain_lists(licence_model):
    lines = [t for ts in licences.TEMPLATES.values() for t in ts] + ["one", "the " * 300, "Some plain words, some plain words", "...", "MIT MIT license MIT license"]
    got = licence_model.probabilities(*licences.encoded([licences.words(x) for x in lines]))
    for line, row in zip(lines, got):
        assert row.tolist() == pytest.approx(own_scores(licence_model, line), abs=1e-9)


def test_repeated_words_give_no_licence(spark, licence_model):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300").select("text").collect()
    seen = sorted({w for r in texts for w in (r["text"] or "").split()})[::15][:1500] + ["the", "version", "license", "copyright", "Software", "Orre"]
    rows = [(i, " ".join([w] * n)) for i, w in enumerate(seen) for n in (1, 7, 300)]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=licence_model).collect()
    assert found == []


def test_short_notices_are_found_and_prose_is_not(spark, licence_model):
    wanted = [("proprietary", "All rights reserved."), ("GPL", "GNU GPL v3"), ("MIT", "MIT License"), ("BSD", "# BSD License"), ("Apache-2.0", "Apache License 2.0"),
              ("CC-BY-SA", "Licensed under CC BY-SA 4.0."), ("proprietary", "Copyright 2015 the authors. All rights reserved.")]
    prose = ["The driving license expired in March and was renewed.", "He said that all of them had the right to be there.", "a", "Version two", "x " * 40_000 + "end",
             "word of the " * 20_000]
    rows = [(i, t) for i, (_, t) in enumerate(wanted)] + [(100 + i, t) for i, t in enumerate(prose)]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=licence_model).collect()
    assert sorted((r["doc_id"], r["family"], r["confirmed"]) for r in found) == [(i, f, True) for i, (f, _) in enumerate(wanted)]


def test_every_notice_of_the_corpus_is_found_and_nothing_else(spark, licence_model):
    """Unconfirmed rows too: no line without a word of licences is reported, and every line that reserves all rights is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {(r["doc_id"], r["paragraph"]) for r in licences.scan(docs, model=licence_model).collect()}
    marks = re.compile("licen|copyright|GNU|CC BY|rights reserved|permission|proprietary|public domain", re.I)
    lines = {(r["doc_id"], i): x for r in docs.select("doc_id", "text").collect() for i, x in enumerate((r["text"] or "").split("\n"))}
    assert all(marks.search(lines[at]) for at in found)
    assert {at for at, x in lines.items() if x.strip() == "All rights reserved."} <= found
