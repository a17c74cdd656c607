"""Exact ranks, running totals and quantiles without an unpartitioned sort.

Everything rests on one shape: collapse equal values first (partial aggregation, so a
value that fills a third of the table is one row), cut the distinct values into buckets
of about equal size at approximate quantiles, run the window inside each bucket, and add
the totals of the lower buckets.  No task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paramo.session import fan_out


def with_row(df: DataFrame, name: str, source: DataFrame, **parts: Column) -> DataFrame:
    """Add the one-row aggregate of ``source`` as a struct column: a scalar subquery, run once,
    instead of a join.  Callers drop the column when done."""
    row = source.agg(F.struct(*[c.alias(n) for n, c in parts.items()]).alias("s")).scalar()
    return df.withColumn(name, row)


def running_totals(
    df: DataFrame,
    value: str,
    weights: Mapping[str, Column],
    by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """One row per distinct value (per group) with, for each weight ``w``, its sum at the value,
    ``w_before`` (the sum over all smaller values of the group) and ``w_total`` (over the group)."""
    by = list(by)
    buckets = buckets or fan_out(df.sparkSession)
    names = list(weights)
    distinct = df.groupBy(*by, value).agg(*[F.sum(c).alias(n) for n, c in weights.items()])
    cuts = F.percentile_approx(value, [i / buckets for i in range(1, buckets)], max(1000, 10 * buckets))
    if by:
        bounds = distinct.groupBy(*by).agg(cuts.alias("_cuts"))
        placed = distinct.join(bounds, by)
    else:
        placed = distinct.withColumn("_cuts", distinct.agg(cuts).scalar())
    placed = placed.withColumn(
        "_bucket", F.size(F.filter("_cuts", lambda b: b < F.col(value)))
    ).drop("_cuts")
    lower = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    # at most `buckets` rows per group reach this window
    starts = placed.groupBy(*by, "_bucket").agg(*[F.sum(n).alias(n) for n in names]).select(
        *by, "_bucket", *[F.coalesce(F.sum(n).over(lower), F.lit(0)).alias(f"_{n}_start") for n in names],
        *[F.sum(n).over(W.partitionBy(*by)).alias(f"{n}_total") for n in names])
    inside = W.partitionBy(*by, "_bucket").orderBy(value)
    prior = inside.rowsBetween(W.unboundedPreceding, -1)
    return placed.join(starts, [*by, "_bucket"]).select(
        *by, value, *names,
        *[(F.col(f"_{n}_start") + F.coalesce(F.sum(n).over(prior), F.lit(0))).alias(f"{n}_before")
          for n in names],
        *[f"{n}_total" for n in names],
    )


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (),
              name: str = "feature", value: str = "value") -> DataFrame:
    """Wide columns -> (keep..., feature, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value))
                      for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(
        *keep, F.col(f"_p.{name}").alias(name), F.col(f"_p.{value}").alias(value))


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float],
                    by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Linearly interpolated quantiles per group, one output column per entry of ``probs``,
    plus ``n`` (non-null values)."""
    by = list(by)
    ranked = running_totals(df.where(F.col(value).isNotNull()), value, {"_n": F.lit(1)}, by, buckets)
    def value_at(rank: Column) -> Column:
        here = (F.col("_n_before") <= rank) & (rank < F.col("_n_before") + F.col("_n"))
        return F.max(F.when(here, F.col(value)))

    outs = []
    for out, p in probs.items():
        place = (F.col("_n_total") - 1) * F.lit(float(p))
        low, high = value_at(F.floor(place)), value_at(F.ceil(place))
        part = F.max(place - F.floor(place))
        outs.append((low + (high - low) * part).alias(out))
    return ranked.groupBy(*by).agg(F.max("_n_total").alias("n"), *outs)


def hash_ranks(df: DataFrame, keys: Sequence[str], seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows with ``draw`` (a repeatable 64-bit hash of the key), ``draw_rank`` (0-based rank of
    the draw inside the group, equal draws in order of the key) and ``group_size``; independent of
    partitioning.  Rows with equal keys are in any order among themselves, each with a rank of its own."""
    by = list(by)
    drawn = df.withColumn("draw", F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]))
    ranks = running_totals(drawn, "draw", {"_n": F.lit(1)}, by)
    joined = drawn.join(ranks.select(
        *by, "draw", F.col("_n_before").alias("draw_rank"), F.col("_n_total").alias("group_size")), [*by, "draw"])
    # a partition holds the rows of one draw: one key, but for collisions
    tied = F.row_number().over(W.partitionBy(*by, "draw").orderBy(*keys)) - 1
    return joined.withColumn("draw_rank", F.col("draw_rank") + tied)
