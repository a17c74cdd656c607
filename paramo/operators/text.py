"""TF-IDF, intent classification and routing over message tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.functions import parsing as p
from paramo.operators import aggregates as agg
from paramo.session import fan_out, materialise

def term_counts(df: DataFrame, key: str, text: str, among: DataFrame | None = None) -> DataFrame:
    """(key, term, tf) for all one- and two-word terms of the whole text, or those of the small table ``among``."""
    clean = df.select(key, p.words(p.clean_text(text)).alias("_w"))
    terms = clean.select(key, F.explode(p.text_grams(F.col("_w"))).alias("term"))
    if among is not None:
        terms = terms.join(F.broadcast(among), "term", "left_semi")
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"))


def tf_weight(tf: Column) -> Column:
    return 1 + F.ln(tf)


def unit_length(df: DataFrame, key: str) -> DataFrame:
    """Divide by the Euclidean length of the text's vector; a window holds the terms of one text."""
    return df.withColumn("weight", F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy(key))))


def term_idf(counts: DataFrame, n_texts: Column) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df")).withColumn(
        "idf", F.ln((1 + n_texts) / (1 + F.col("df"))) + 1)


def spread(df: DataFrame) -> DataFrame:
    """At least as many partitions as the session shuffles to: a table of few row groups is dealt out before heavy work."""
    width = fan_out(df.sparkSession)
    return df.repartition(width) if df.rdd.getNumPartitions() < width else df


#: Texts of the sample that names common terms, how many of these there are at most, and their longest.
SAMPLE_TEXTS, COMMON, LONGEST = 5000, 100_000, 64
#: Rows of terms that are shuffled at a time, about, and in how many parts at most, as each reads all of the list again.
PART_TERMS, MOST_PARTS = 1 << 22, 8


def common_terms(texts: DataFrame) -> list[str]:
    """Terms of two or more texts of a bounded sample by hash, the most frequent first.

    They only choose the way a term takes in ``tfidf``: their counts over all texts are made there."""
    span = 2 ** 32
    share = min(1.0, SAMPLE_TEXTS / max(texts.count(), 1))
    grams = texts.where(F.pmod(F.xxhash64("_t"), F.lit(span)) < int(span * share)).select(
        F.explode(F.array_distinct(p.text_grams(p.words(p.clean_text("_t"))))).alias("term"))
    counts = grams.where(F.length("term") <= LONGEST).groupBy("term").agg(F.count("*").alias("n")).where("n > 1")
    return [r["term"] for r in counts.orderBy(F.col("n").desc(), "term").limit(COMMON).select("term").collect()]


def counted_terms(texts: DataFrame, common: Sequence[str]) -> DataFrame:
    """(_k, common, rare): per text its distinct one- and two-word terms with their counts, those of the list by their number."""
    held = texts.sparkSession.sparkContext.broadcast({term: i for i, term in enumerate(common)})
    kinds = [pa.struct([("id", pa.int32()), ("tf", pa.int64())]), pa.struct([("term", pa.string()), ("tf", pa.int64())])]

    def run(batches):
        known = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, tfs, terms, counts, ends = [], [], [], [], [[0], [0]]
                for words in part.column("_w").to_pylist():
                    words = words or []
                    for term, n in Counter([*words, *[f"{a} {b}" for a, b in zip(words, words[1:])]]).items():
                        if (i := known.get(term)) is None:
                            terms.append(term)
                            counts.append(n)
                        else:
                            ids.append(i)
                            tfs.append(n)
                    ends[0].append(len(ids))
                    ends[1].append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.StructArray.from_arrays([pa.array(x, k[0].type), pa.array(c, pa.int64())], fields=list(k)))
                         for e, x, c, k in zip(ends, (ids, terms), (tfs, counts), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("_k"), *lists], names=["_k", "common", "rare"])

    words = texts.select("_k", p.words(p.clean_text("_t")).alias("_w"))
    key_type = texts.schema["_k"].dataType.simpleString()
    return words.mapInArrow(run, f"_k {key_type}, common array<struct<id: int, tf: bigint>>, rare array<struct<term: string, tf: bigint>>")


def rare_parts(counts: DataFrame, parts: int) -> Iterator[DataFrame]:
    """(_k, term, tf, df) in parts by hash of the term: what one part shuffles is gone before the next begins, which bounds the disk."""
    for p in range(parts):
        part = counts.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == p) if parts > 1 else counts
        yield part.join(part.groupBy("term").agg(F.count("*").alias("df")), "term").select("_k", "term", "tf", "df")


def tfidf(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): logarithmic term counts, smoothed idf, unit length.

    Terms are counted inside each text's row and written once.  Terms that a sample shows to be common (at most COMMON) stay in
    the row: their exact counts over all texts go to every task, so they are never shuffled.  All other terms meet their count in a
    join, some of them at a time, and go back to the length of their text in another.
    """
    texts = spread(df.select(F.col(key).alias("_k"), F.col(text).alias("_t")))
    common = common_terms(texts)
    listed = materialise(counted_terms(texts, common), "zstd")
    n, others = listed.agg(F.count("*"), F.sum(F.size("rare"))).first()
    n = F.lit(n).cast("bigint")
    names = df.sparkSession.createDataFrame(pd.DataFrame({"id": range(len(common)), "term": common}), "id int, term string")
    per_id = listed.select(F.explode("common.id").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
    # a term of the list is in some text, so it has a count
    idf = F.broadcast(materialise(names.join(per_id, "id").withColumn("idf", F.ln((1 + n) / (1 + F.col("df"))) + 1).drop("df")))
    weight = (tf_weight(F.col("tf")) * F.col("idf")).alias("weight")
    parts = min(MOST_PARTS, max(1, -(-(others or 0) // PART_TERMS)))
    rare = [materialise(part, "zstd").select("_k", "term", (tf_weight(F.col("tf")) * (F.ln((1 + n) / (1 + F.col("df"))) + 1)).alias("weight"))
            for part in rare_parts(listed.select("_k", F.inline("rare")), parts)]
    rare = reduce(DataFrame.unionByName, rare)
    near = listed.select("_k", F.inline("common")).join(idf, "id").select("_k", weight)
    square = F.sum(F.col("weight") * F.col("weight")).alias("sq")
    lengths = materialise(near.groupBy("_k").agg(square).unionByName(rare.groupBy("_k").agg(square)).groupBy(F.col("_k").alias("_of")).agg(
        F.sqrt(F.sum("sq")).alias("length")))
    own = F.col("_k").eqNullSafe(F.col("_of"))
    out = listed.select("_k", "common").join(lengths, own).select("_k", "length", F.inline("common")).join(idf, "id").select("_k", "length", "term", weight)
    out = out.unionByName(rare.join(lengths, own).select("_k", "length", "term", "weight"))
    return out.select(F.col("_k").alias(key), "term", (F.col("weight") / F.col("length")).alias("weight"))


def default_corpus(spark: SparkSession) -> DataFrame:
    """(phrase_id, phrase, intent): the built-in phrases, a few dozen rows."""
    return spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(fv.CORPUS)], "phrase_id int, phrase string, intent string")


def intent_by_cosine(df: DataFrame, key: str, text: str, corpus: DataFrame | None = None,
                     least: float = 0.05, digits: int | None = 3) -> DataFrame:
    """Best intent of each text by cosine similarity to the phrases of the corpus.

    Only terms of the corpus count.  The dot product is a join on the term, so nothing is compared
    that shares no word; each message row meets at most the phrases that contain its term.
    """
    built_in = corpus is None
    corpus = default_corpus(df.sparkSession) if built_in else corpus
    small = F.broadcast if built_in else (lambda x: x)
    counts = term_counts(corpus, "phrase_id", "phrase")
    vocabulary = term_idf(counts, corpus.agg(F.count("*")).scalar()).select("term", "idf")
    phrases = unit_length(
        counts.join(small(vocabulary), "term").select("phrase_id", "term", (tf_weight(F.col("tf")) * F.col("idf")).alias("weight")),
        "phrase_id").join(small(corpus.select("phrase_id", "intent")), "phrase_id").withColumnRenamed("weight", "phrase_weight")
    messages = unit_length(
        term_counts(df, key, text, vocabulary.select("term") if built_in else None).join(small(vocabulary), "term")
        .select(key, "term", (tf_weight(F.col("tf")) * F.col("idf")).alias("weight")), key)
    # sums arrive in any order: nine decimals make equal similarities equal
    sims = messages.join(small(phrases), "term").groupBy(key, "phrase_id", "intent").agg(
        F.round(F.sum(F.col("weight") * F.col("phrase_weight")), 9).alias("sim"))
    best = sims.groupBy(key).agg(
        F.max_by("intent", F.struct("sim", -F.col("phrase_id"))).alias("intent"), F.max("sim").alias("sim"))
    sim = F.coalesce("sim", F.lit(0.0))
    return df.join(best, key, "left").withColumns({
        "intent": F.when(sim < least, fv.UNKNOWN_INTENT).otherwise(F.col("intent")),
        "confidence": p.rounded(sim, digits)}).drop("sim")


def intent_by_keywords(df: DataFrame, text: str, keywords: Mapping[str, Sequence[str]] = fv.INTENT_KEYWORDS,
                       digits: int | None = 2) -> DataFrame:
    """Intent with most of its keywords in the text, and its share of all hits; first listed wins ties."""
    clean = p.clean_text(text)
    hits = {k: sum((F.col("_clean").contains(w).cast("int") for w in ws), F.lit(0)) for k, ws in keywords.items()}
    df = df.withColumn("_clean", clean).withColumns({f"_n_{k}": c for k, c in hits.items()})
    cols = [F.col(f"_n_{k}") for k in keywords]
    best, total = F.greatest(*cols), sum(cols[1:], cols[0])
    pick = F.coalesce(*[F.when(c == best, F.lit(k)) for k, c in zip(keywords, cols)])
    return df.withColumns({
        "intent": F.when(best == 0, fv.UNKNOWN_INTENT).otherwise(pick),
        "confidence": p.rounded(F.when(best == 0, 0.0).otherwise(best / total), digits),
    }).drop("_clean", *[f"_n_{k}" for k in keywords])


def mentioned_region(text: str, names: Sequence[str] = tuple(fv.REGION_NAMES)) -> Column:
    """First listed region whose name is in the text, capitalised; null when none is."""
    lower = F.lower(F.col(text))
    found = F.coalesce(*[F.when(lower.contains(n), F.lit(n)) for n in names])
    return F.concat(F.upper(F.substring(found, 1, 1)), F.substring(found, 2, 100))


# our wording of the answers that need no data
STATIC_ANSWERS = {
    "ayuda": "Puedo informar sobre peajes, precios de insumos y clima. Escriba su pregunta.",
    "ivt": "El puntaje territorial combina precios, clima y calendario en tres niveles: BAJA, MEDIA y ALTA.",
    "anomalia": "Los períodos atípicos se detectan con varios métodos; vea la lista ordenada por puntaje.",
    "forecast": "Las series se proyectan por meses con un intervalo de confianza del 95 %.",
    fv.UNKNOWN_INTENT: "No entendí la pregunta. Pregunte por peajes, precios o clima.",
}
SUGGESTIONS = {
    "trafico": ["Peaje con más tránsito", "Tránsito por categoría"],
    "precios": ["Precio del fertilizante", "Mes con mayor alza"],
    "clima": ["Estación con más lluvia", "Temperatura por región"],
    "resumen": ["Última fecha cargada"],
    "ayuda": ["Tránsito en Antioquia", "Precio de insumos"],
    "ivt": ["Precio de este mes", "Lluvia reciente"],
    "anomalia": ["Registros por tabla", "Precio de este mes"],
    "forecast": ["Precio actual", "Alertas de clima"],
    fv.UNKNOWN_INTENT: ["Tránsito en Antioquia", "Precio del fertilizante", "Lluvia de la semana"],
}


def with_all_regions(rows: DataFrame, region: str, names: Sequence[str]) -> DataFrame:
    """Each row once for the country (null) and once for every listed name its region contains."""
    lower = F.lower(F.coalesce(F.col(region), F.lit("")))
    keys = F.array(F.lit(None).cast("string"),
                   *[F.when(lower.contains(n), F.lit(n[:1].upper() + n[1:])).otherwise(F.lit("-")) for n in names])
    return rows.withColumn("asked", F.explode(F.array_distinct(keys))).where("asked IS NULL OR asked <> '-'")


def answers(tolls: DataFrame, index: DataFrame, obs: DataFrame, names: Sequence[str] = tuple(fv.REGION_NAMES)) -> DataFrame:
    """(intent, asked region, answer) for every answer the data can give."""
    per_region = tolls.groupBy("region").agg(F.sum("traffic").alias("t"), F.sum("evaders").alias("e"), F.count("*").alias("n"))
    traffic = with_all_regions(per_region, "region", names).groupBy("asked").agg(
        F.sum("t").alias("t"), F.sum("e").alias("e"), F.sum("n").alias("n"))
    pct = agg.share_pct(F.col("e"), F.col("t"))
    traffic = traffic.select(F.lit("trafico").alias("intent"), "asked", F.concat(
        F.format_string("Tránsito total: %d vehículos en %d períodos; %d evasiones (%.2f%%).", "t", "n", "e", pct),
        F.when(pct > fv.EVASION_NOTE_PCT, " La evasión es alta.").otherwise("")).alias("answer"))
    latest = agg.recent_change(index, digits=None)
    prices = latest.select(F.lit("precios").alias("intent"), F.lit(None).cast("string").alias("asked"), F.concat(
        F.format_string("Índice de insumos en %s: %.1f.", F.date_format("last", "yyyy-MM"), "last_value"),
        F.coalesce(F.when(F.col("change_pct").isNotNull(), F.format_string(" Cambio en 6 meses: %.2f%%.", "change_pct")), F.lit("")),
    ).alias("answer"))
    week = agg.climate_window(obs.withColumn("total", F.col("value")), by=["region"])
    parts = with_all_regions(week.withColumn("s", F.col("mean") * F.col("n")), "region", names).groupBy("asked", "variable").agg(
        (F.sum("s") / F.sum("n")).alias("mean"), F.max("top").alias("top"), F.sum("n").alias("n"))

    def line(variable: str, text: str) -> Column:
        mine = F.col("variable") == variable
        return F.max(F.when(mine, F.format_string(text, "mean", "top", "n")))

    climate = parts.groupBy("asked").agg(F.concat_ws(
        " ", line(fv.RAIN, "Lluvia: promedio %.1f mm, máximo %.1f mm (%d datos)."),
        line(fv.TEMP, "Temperatura: promedio %.1f °C, máximo %.1f °C (%d datos).")).alias("answer")).select(
        F.lit("clima").alias("intent"), "asked", "answer")

    def rows(df: DataFrame) -> Column:
        return df.agg(F.count("*")).scalar()

    spark = tolls.sparkSession
    totals = spark.range(1).select(F.lit("resumen").alias("intent"), F.lit(None).cast("string").alias("asked"), F.format_string(
        "Registros: %d de peajes, %d de precios, %d de clima.", rows(tolls), rows(index), rows(obs)).alias("answer"))
    fixed = spark.createDataFrame([(k, None, v) for k, v in STATIC_ANSWERS.items()], "intent string, asked string, answer string")
    return traffic.unionByName(prices).unionByName(climate).unionByName(totals).unionByName(fixed)


def route(messages: DataFrame, answer_rows: DataFrame) -> DataFrame:
    """Messages (with intent and region) joined to their answer and suggestions.

    Only traffic and climate depend on the region.  The answers are a few dozen aggregate rows, so
    Spark's size check turns this into a broadcast join and a popular intent is not a hot key.
    """
    asked = F.when(F.col("intent").isin("trafico", "clima"), F.col("region"))
    tips = F.create_map(*[x for k, v in SUGGESTIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    right = answer_rows.select(F.col("intent").alias("_i"), F.col("asked").alias("_a"), "answer")
    return messages.join(right, (F.col("intent") == F.col("_i")) & asked.eqNullSafe(F.col("_a")), "left").drop("_i", "_a").withColumns({
        "answer": F.coalesce("answer", F.lit("No hay datos para esa consulta.")), "suggestions": F.element_at(tips, F.col("intent"))})
