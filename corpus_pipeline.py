"""The corpus pipeline: documents in, encoded training mixture out.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns of
documents, but for the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramo.llm import bpe, classifier, mixing, simhash, spans
from paramo.llm.common import read
from paramo.llm.queries import tokenizer
from paramo.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return classifier.accepted(docs, read(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return simhash.keep_first(docs, shingle=3, radius=3)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut sentences of spans that occurred before; texts that lose all sentences go."""
    return with_length(spans.without_repeats(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents by the budgets of their sources."""
    return mixing.mixed(docs, lift=0.5, max_epochs=4.0)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    sha = F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha")
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text", sha), tokenizer(), "text", "ids")
    # written out between, so that a task holds the workers of one of the two at a time
    ids = materialise(ids.withColumn("n_tokens", F.size("ids").cast("long"))).withColumn("_ids", F.col("ids"))
    back = bpe.decode(ids, tokenizer(), "_ids", "_back").withColumn("decodes", F.sha2("_back", 256) == F.col("_sha"))
    return back.select("doc_id", "lang", "source", "n_tokens", "ids", "decodes")


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, where there was such a column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_spans),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", encoded),
]

#: The stages are hashes, sentence rules and a trained model; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
