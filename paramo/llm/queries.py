"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramo.llm import alignment, bpe, caps, classifier, licences, mixing, periodic, preference, rules, simhash, spans, suffixes, toxicity
from paramo.llm.common import read, words_of

QUERIES, ORACLES = {}, {}


def tokenizer() -> str:
    """The tokenizer file of the encoding queries."""
    return public_tokenizers.path("byte_bpe_50k.json")


def query(key: str, oracle: str | None = None):
    def add(build):
        QUERIES[key] = build
        if oracle is not None:
            ORACLES[key] = oracle.strip()
        return build

    return add


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text", shingle=3, radius=3, seed=42)


@query("op2_suffix_array_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(read(spark, sf_dir, "documents"), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.3)


OP4_SQL = """
WITH rows AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
pairs AS (SELECT c.conv_id // 2 AS pair_id, c.conv_id AS chosen, r.conv_id AS rejected
  FROM (SELECT DISTINCT conv_id FROM rows) c JOIN (SELECT DISTINCT conv_id FROM rows) r ON c.conv_id % 2 = 0 AND r.conv_id = c.conv_id + 1),
placed AS (
  SELECT pair_id, 'chosen' AS side, turn, role, text FROM pairs JOIN rows ON conv_id = chosen
  UNION ALL SELECT pair_id, 'rejected', turn, role, text FROM pairs JOIN rows ON conv_id = rejected),
told AS (SELECT pair_id, side, turn, list((role, text) ORDER BY role, text) AS said FROM placed GROUP BY ALL),
firsts AS (
  SELECT pair_id, min(turn) AS first FROM (
    SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.turn, b.turn) AS turn, a.said AS x, b.said AS y
    FROM (SELECT * FROM told WHERE side = 'chosen') a FULL JOIN (SELECT * FROM told WHERE side = 'rejected') b
      ON a.pair_id = b.pair_id AND a.turn = b.turn) WHERE x IS DISTINCT FROM y GROUP BY pair_id),
parts AS (
  SELECT p.pair_id, CASE WHEN first IS NULL OR turn < first THEN 'prompt' ELSE side END AS part, side, turn, role, text,
    '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS segment
  FROM placed p LEFT JOIN firsts f ON p.pair_id = f.pair_id),
shown AS (
  SELECT *, CAST(coalesce(sum(length(segment)) OVER (PARTITION BY pair_id, part ORDER BY turn, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM parts WHERE part <> 'prompt' OR side = 'chosen')
SELECT pair_id, part, turn, role, segment, start,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(head) END AS mask_from,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(segment) - 1 END AS mask_to
FROM shown
"""


@query("op4_preference_formatting", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return preference.segments(turns, preference.neighbours(turns))


@query("op5_embedding_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(read(spark, sf_dir, "embeddings"), least=0.93)


@query("op6_bpe_encoding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer()
    ids = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    ids = ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                     F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    return bpe.decode(ids, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


@query("op7_license_scans")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


@query("op8_substring_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_removed", "emptied", F.length("text").cast("long").alias("n_chars_kept"),
                        F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = f"""
WITH RECURSIVE counts AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS tokens
  FROM documents),
sources AS (SELECT source, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM counts GROUP BY source),
total AS (SELECT CAST(sum(tokens) AS DOUBLE) AS t FROM sources),
shares AS (SELECT source, tokens, tokens / t AS p FROM sources, total WHERE tokens > 0),
aim AS (SELECT -sum(p * ln(p)) + 0.5 * (ln(count(*)) + sum(p * ln(p))) AS entropy, list(p) AS ps, list(tokens) AS ts FROM shares),
lifts(step, low, width) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1, CASE WHEN (
    SELECT ln(list_sum(list_transform(ps, lambda p: exp((low + width / 2) * ln(p)))))
      - (low + width / 2) * list_sum(list_transform(ps, lambda p: exp((low + width / 2) * ln(p)) * ln(p)))
        / list_sum(list_transform(ps, lambda p: exp((low + width / 2) * ln(p)))) >= entropy - 1e-12 FROM aim)
    THEN low + width / 2 ELSE low END, width / 2
  FROM lifts WHERE step < {mixing.STEPS}),
repeats(step, low, width) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1, CASE WHEN (
    SELECT list_max(list_transform(list_zip(ps, ts), lambda x: exp((low + width / 2) * ln(x[1])) / x[2])) * t
      / list_sum(list_transform(ps, lambda p: exp((low + width / 2) * ln(p)))) > 4 * (1 + 1e-12) FROM aim, total)
    THEN low + width / 2 ELSE low END, width / 2
  FROM repeats WHERE step < {mixing.STEPS}),
power AS (
  SELECT greatest(CASE WHEN (SELECT count(*) FROM shares) = 1 THEN 1 ELSE (SELECT low FROM lifts WHERE step = {mixing.STEPS}) END,
    (SELECT CASE WHEN low > 0 THEN low + width ELSE 0 END FROM repeats WHERE step = {mixing.STEPS})) AS a),
weights AS (
  SELECT source, tokens, exp(a * ln(p)) / sum(exp(a * ln(p))) OVER () AS weight FROM shares, power),
budgets AS (
  SELECT source, tokens, CAST(floor(weight * t + 0.5) AS BIGINT) AS target FROM weights, total),
passes AS (
  SELECT source, target // tokens AS epochs, target - target // tokens * tokens AS rest FROM budgets WHERE target > 0),
uses AS (
  SELECT doc_id, c.source, c.tokens, block, epochs, rest,
    CAST('0x' || substr(md5('42:' || block || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, {mixing.DRAW_BITS // 4}) AS BIGINT) AS draw
  FROM (SELECT *, unnest(range(0, epochs + 1)) AS block FROM passes) p JOIN counts c ON c.source IS NOT DISTINCT FROM p.source
  WHERE block < epochs OR rest > 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY source, block ORDER BY draw, doc_id, tokens) AS place,
    coalesce(sum(tokens) OVER (PARTITION BY source, block ORDER BY draw RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM uses)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(place AS BIGINT) AS place, draw, tokens
FROM ordered WHERE block < epochs OR before < rest
"""


@query("op9_source_mixing", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), lift=0.5, max_epochs=4.0, seed=42)[0]


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the texts, picked by CRC-32 of the id, the words from one on are replaced by a repeating unit of theirs."""
    draw = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "text", F.when(draw % 10 == 0, words_of(F.col("text"))).alias("words"), F.floor(draw / 10).alias("g"))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    repeated = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return docs.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(repeated, " ")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(with_periods(read(spark, sf_dir, "documents")), least=24, times=3)
    best = periodic.strongest("runs")
    found = found.select("doc_id", "runs", best.alias("best"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length").cast("long"), F.col("best.period").cast("long")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").cast("long").alias("start"), length.alias("length"),
                        period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
                        F.sha2(periodic.listed("runs"), 256).alias("runs_sha256"), "collapsed_sha256")


@query("op12_cross_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.7)
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
