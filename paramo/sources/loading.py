"""Idempotent loading, declared tables, staging and run reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paramo.schemas import Table
from paramo.session import materialise, staged


def all_filled(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key.  An aggregation, so copies collapse before the shuffle and a key
    that fills a third of the batch is no heavier than any other.  Rows with a null in the key
    are never equal to one another and all stay: each gets a group of its own."""
    rest = [c for c in df.columns if c not in keys]
    solo = F.when(~all_filled(keys), F.monotonically_increasing_id())
    kept = df.withColumn("_solo", solo).groupBy(*keys, "_solo").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


def unseen(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of the batch an insert-ignore would add: first of its key and not in the target.

    The target is first reduced to the keys the batch brings.  With a batch below Spark's broadcast size
    the target is only streamed past it and never shuffled; a large batch becomes a shuffled join.
    """
    known = target.select(*keys).join(batch.where(all_filled(keys)).select(*keys).distinct(), list(keys), "left_semi")
    return first_per_key(batch, keys, order).join(known, list(keys), "left_anti")


def insert_ignore(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], order: Sequence[str],
                  prune_by: str | None = None) -> DataFrame:
    """Append the unseen rows of the batch to the Parquet table at ``path``; returns one row of
    counts: batch, inserted, skipped.  Running it again inserts nothing.

    ``prune_by`` names a key column (a date, say): only target files and partitions within the batch's
    range of it are read.  The new rows are staged first, so nothing reads the table while it grows and
    the count costs no pass over it.
    """
    batch = materialise(batch)  # conformed once, read three times
    target = spark.read.schema(batch.schema).parquet(path)
    bounds = [F.min(prune_by).alias("lo"), F.max(prune_by).alias("hi")] if prune_by else []
    facts = batch.agg(F.count("*").alias("offered"), *bounds).first()
    if prune_by and facts["lo"] is not None:
        target = target.where(F.col(prune_by).between(facts["lo"], facts["hi"]))
    fresh = materialise(unseen(target, batch, keys, order))
    fresh.write.mode("append").parquet(path)
    offered, inserted = facts["offered"], fresh.count()
    return spark.createDataFrame([(offered, inserted, offered - inserted)], "batch long, inserted long, skipped long")


#: Partition column of tables whose loads can be repeated.
LOAD = "load_id"


def create(spark: SparkSession, path: str, schema) -> None:
    """An empty table that takes loads by id."""
    spark.createDataFrame([], schema).write.parquet(f"{path}/{LOAD}=none")


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all loads."""
    return spark.read.parquet(path).drop(LOAD)


def insert_once(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], order: Sequence[str], load_id: str) -> None:
    """Insert-ignore of a batch as the load ``load_id``.

    The rows are compared with all other loads and replace the folder of this one, so the same load
    can run again after a failure and leaves the table as if it had run once.
    """
    others = spark.read.parquet(path).where(F.col(LOAD).cast("string") != load_id).select(*batch.columns)
    with staged(batch) as rows, staged(unseen(others, rows, keys, order)) as fresh:
        fresh.write.mode("overwrite").parquet(f"{path}/{LOAD}={load_id}")


def quality_report(df: DataFrame, table: Table) -> DataFrame:
    """Failures of the declared rules: (check, column, failures)."""
    checks = {("missing", c): F.count_if(F.col(c).isNull()) for c in table.required if c in df.columns}
    checks |= {("too_long", c): F.count_if(F.length(F.col(c)) > n) for c, n in table.lengths.items() if c in df.columns}
    one = df.agg(*[c.alias(f"{k}|{name}") for (k, name), c in checks.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.lit(name).alias("column"),
                              F.col(f"`{k}|{name}`").alias("failures")) for k, name in checks])
    copies = (df.where(all_filled(table.key)).groupBy(*table.key).agg(F.count("*").alias("n"))
              .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("failures"))
              .select(F.lit("duplicate_key").alias("check"), F.lit(",".join(table.key)).alias("column"), "failures"))
    return one.select(F.inline(rows)).unionByName(copies)


def conflicting_codes(dim: DataFrame, name: str, code: str) -> DataFrame:
    """Names of a dimension that carry more than one code."""
    return dim.groupBy(name).agg(F.countDistinct(code).alias("codes"), F.min(code).alias("lowest")).where("codes > 1")


def declare(df: DataFrame, table: Table) -> DataFrame:
    """The rows under the declared column order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema])


# --- Fixed values: stages of the data folder -----------------------------------------
STAGES = ("raw", "processed", "features", "predictions", "exports")


def stage(df: DataFrame, root: str, zone: str, name: str, date: str) -> str:
    """Write one dataset of a stage, partitioned by year and month of ``date``.

    The rebalance hint lets AQE merge small partitions and split a heavy month over several files.
    """
    if zone not in STAGES:
        raise ValueError(f"stage must be one of {STAGES}")
    path = f"{root.rstrip('/')}/{zone}/{name}"
    parts = df.withColumns({"year": F.year(date), "month_no": F.month(date)})
    parts.hint("rebalance", "year", "month_no").write.mode("overwrite").partitionBy("year", "month_no").parquet(path)
    return path


def run_summary(feeds: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Per feed: rows extracted and rows loaded."""
    parts = [raw.agg(F.count("*").alias("extracted")).select(
        F.lit(name).alias("feed"), "extracted", loaded.agg(F.count("*")).scalar().alias("loaded"))
        for name, (raw, loaded) in feeds.items()]
    return reduce(DataFrame.unionByName, parts)


def dry_run(conformed: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """What a load would start with; nothing is written."""
    return conformed.orderBy(*order).limit(n)


def run_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Any SQL over named tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)
