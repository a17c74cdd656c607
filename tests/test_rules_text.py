import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.operators import aggregates as agg
from paramo.operators import rules as r
from paramo.operators import text as t


def index(spark, *rows):
    return spark.createDataFrame([(dt.date(2024, i + 1, 1), a, b) for i, (a, b) in enumerate(rows)], "month date, idx_total double, idx_fert double")


@pytest.mark.parametrize("rows,want", [
    ([(100.0, 130.0)], []), ([(100.0, 130.1)], [("fertilizante_alto", "MEDIA")]), ([(100.0, 149.6)], [("fertilizante_alto", "ALTA")]),
    ([(100.0, 0.0), (105.0, 0.0)], []), ([(100.0, 0.0), (94.9, 0.0)], [("variacion_alta", "MEDIA")]), ([(0.0, 0.0), (50.0, None)], [])])
def test_price_rules(spark, rows, want):
    assert [(x["rule"], x["priority"]) for x in r.price_rules(index(spark, *rows)).collect()] == want


def obs(spark, variable, *values):
    return spark.createDataFrame([(i, variable, v, dt.date(2024, 1, 10), "Antioquia", 1) for i, v in enumerate(values)],
                                 "obs_id int, variable string, value double, obs_date date, region string, station int")


@pytest.mark.parametrize("variable,values,want", [
    (fv.RAIN, [4.9], ["sequia"]), (fv.RAIN, [0.0, 9.0], ["sequia"]), (fv.RAIN, [0.0, 0.0, 10.0], []), (fv.RAIN, [5.0], []),
    (fv.RAIN, [150.0], []), (fv.RAIN, [150.1], ["inundacion"]), (fv.TEMP, [30.0], []), (fv.TEMP, [30.1], ["calor"])])
def test_climate_rules(spark, variable, values, want):
    assert [x["rule"] for x in r.climate_rules(obs(spark, variable, *values)).collect()] == want


def tolls(spark, traffic, evaders):
    return spark.createDataFrame([("s", "Antioquia", traffic, evaders)], "site string, region string, traffic long, evaders long")


def test_evasion_rule(spark):
    assert r.evasion_rule(tolls(spark, 100, 15)).count() == 0 and r.evasion_rule(tolls(spark, 100, 16)).count() == 1
    assert r.evasion_rule(tolls(spark, 0, 16)).count() == 0
    assert agg.evasion(tolls(spark, 90, 10), denominator="all").first()["evasion_pct"] == 10.0


def test_priorities(spark):
    calm = r.prioritised(index(spark, (100.0, 90.0)), obs(spark, fv.RAIN, 50.0), tolls(spark, 100, 1)).collect()
    assert [x["rule"] for x in calm] == ["precio_estable", "clima_estable"]
    busy = r.prioritised(index(spark, (100.0, 140.0), (120.0, 140.0)), obs(spark, fv.RAIN, 1.0), tolls(spark, 100, 50)).collect()
    assert [x["rule"] for x in busy] == ["compuesta", "sequia", "fertilizante_alto", "variacion_alta", "evasion_alta"]


def test_model_insights(spark):
    df = spark.createDataFrame([("ALTA", 6.0, 6)], "label string, forecast_change_pct double, n_anomalies int")
    assert [x["rule"] for x in r.model_insights(df).collect()] == ["modelo_alta", "alza_prevista", "muchas_anomalias"]
    calm = spark.createDataFrame([("BAJA", None, 5)], "label string, forecast_change_pct double, n_anomalies int")
    assert [x["rule"] for x in r.model_insights(calm).collect()] == ["todo_estable"]


def test_corpus_phrases_find_their_intent(spark):
    df = spark.createDataFrame([(i, p, k) for i, (p, k) in enumerate(fv.CORPUS)], "id int, text string, want string")
    out = t.intent_by_cosine(df, "id", "text").collect()
    assert all(x["intent"] == x["want"] and x["confidence"] == 1.0 for x in out)


def test_unknown_and_empty_messages(spark):
    df = spark.createDataFrame([(1, "xyzzy plugh"), (2, ""), (3, None), (4, "   ")], "id int, text string")
    assert {(x["intent"], x["confidence"]) for x in t.intent_by_cosine(df, "id", "text").collect()} == {("desconocido", 0.0)}


def test_keywords_first_listed_wins(spark):
    df = spark.createDataFrame([(1, "precio y peaje"), (2, "nada")], "id int, text string")
    out = {x["id"]: (x["intent"], x["confidence"]) for x in t.intent_by_keywords(df, "text").collect()}
    assert out == {1: ("trafico", 0.5), 2: ("desconocido", 0.0)}


def test_region_in_text(spark):
    df = spark.createDataFrame([("Peajes del VALLE del Cauca",), ("en Bogotá",)], "text string")
    assert [x[0] for x in df.select(t.mentioned_region("text")).collect()] == ["Valle", None]


def test_tfidf_against_numpy(spark):
    texts = ["uno dos dos", "dos tres", "tres tres tres cuatro", ""] + ["comun"] * 200
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(x["id"], x["term"]): x["weight"] for x in t.tfidf(df, "id", "text").collect()}
    bags = []
    for s in texts:
        w = s.split()
        grams = w + [" ".join(p) for p in zip(w, w[1:])]
        bags.append({g: grams.count(g) for g in grams})
    n = len(texts)
    for i, bag in enumerate(bags):
        v = {g: (1 + np.log(c)) * (np.log((1 + n) / (1 + sum(g in b for b in bags))) + 1) for g, c in bag.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        for g, x in v.items():
            assert np.isclose(got[(i, g)], x / norm)
    assert len(got) == sum(map(len, bags))


def test_tfidf_ways_agree(spark, monkeypatch):
    """Terms that take the join and terms that stay in their row weigh the same; keys may repeat or be null, texts too."""
    rows = [(1, "uno dos dos"), (1, "dos tres"), (None, "dos uno dos"), (None, "x"), (2, None), (3, "uno dos dos"), (4, "tres cuatro"), (5, "yy yy yy")]
    df = spark.createDataFrame(rows, "id int, text string")

    def found():
        return sorted(((str(r["id"]), r["term"], round(r["weight"], 12)) for r in t.tfidf(df, "id", "text").collect()))

    both = found()
    assert "dos" in t.common_terms(df.select(F.col("text").alias("_t"))) and len(both) == 20
    sums = {}
    for k, _, w in both:
        sums[k] = sums.get(k, 0) + w * w
    assert set(sums) == {"1", "3", "4", "5", "None"} and all(abs(x - 1) < 1e-9 for x in sums.values())
    monkeypatch.setattr(t, "COMMON", 1)
    assert found() == both
    monkeypatch.setattr(t, "SAMPLE_TEXTS", 0)
    assert found() == both


def test_cosine_counts_only_terms_of_the_corpus(spark):
    phrase = fv.CORPUS[0][0]
    rows = [("a", phrase), ("a", f"{phrase} zzz"), ("b", "zzz qqq zzz"), ("c", None), (None, phrase), ("d", fv.CORPUS[-1][0] + " qqq")]
    df = spark.createDataFrame(rows, "id string, text string")
    among = spark.createDataFrame([("zzz",)], "term string")
    assert sorted(map(tuple, t.term_counts(df, "id", "text", among).collect())) == [("a", "zzz", 1), ("b", "zzz", 2)]
    found = t.intent_by_cosine(df, "id", "text")
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    # a corpus of the caller takes the way without it
    given = t.intent_by_cosine(df, "id", "text", t.default_corpus(spark))
    assert sorted(map(str, found.collect())) == sorted(map(str, given.collect())) and found.count() == 6


def test_tfidf_in_parts_is_that_in_one(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(12)) if i % 9 else None) for i in range(120)]
    df = spark.createDataFrame([*rows, (None, "w1 solo"), (5, "w2 otra vez")], "id int, text string")
    monkeypatch.setattr(t, "COMMON", 20)
    written, materialise = [], t.materialise

    def watched(table, *more):
        written.append(table.columns)
        return materialise(table, *more)

    monkeypatch.setattr(t, "materialise", watched)
    found = []
    for most in (1 << 22, 300):
        monkeypatch.setattr(t, "PART_TERMS", most)
        written.clear()
        found.append({(r["id"], r["term"]): r["weight"] for r in t.tfidf(df, "id", "text").collect()})
        parts = written.count(["_k", "term", "tf", "df"])
        assert (parts == 1) if most > 300 else (1 < parts <= t.MOST_PARTS)
    assert found[0].keys() == found[1].keys() and all(abs(w - found[1][k]) < 1e-12 for k, w in found[0].items())
