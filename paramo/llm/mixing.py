"""Mixing sources by temperature: share ** exponent, budgets, and block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paramo.llm.common import words_of
from paramo.session import materialise

#: Bisection steps, and how many of them one pass over the sources takes.
STEPS, AT_ONCE = 36, 6
#: Rows of one source that one window task orders, about.
WINDOW_ROWS = 20_000
#: Draws are this many bits of an MD5 sum.
DRAW_BITS = 60


def token_count(text: Column) -> Column:
    """Words of a text; null has 0."""
    return F.size(words_of(text)).cast("long")


def draw(block: Column, key: Column, seed: int) -> Column:
    """A repeatable number below 2 ** DRAW_BITS per block and key: the order of the block's permutation."""
    text = F.concat_ws(":", F.lit(str(seed)), block.cast("string"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("long")


def bisect(shares: DataFrame, holds: Callable[[Column], Column]) -> float:
    """The largest multiple of 2 ** -STEPS in [0, 1) up to which ``holds`` is true, or 1.0 if true there.

    ``holds(exponent)`` is an aggregate of ``shares`` that is true below some exponent and false above it.
    One pass evaluates the middles of AT_ONCE steps, one row each; only their truth values come back.
    """
    low, width, parts = 0.0, 1.0, 2 ** AT_ONCE
    for k in range(STEPS // AT_ONCE):
        width /= parts
        last = parts if k == 0 else parts - 1  # the first pass looks at 1.0 too
        tried = shares.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(last)))).withColumn("a", F.lit(low) + F.col("k") * F.lit(width))
        true = sum(1 for r in tried.groupBy("k").agg(holds(F.col("a")).alias("t")).collect() if r["t"])
        low += width * true
        if low >= 1.0:
            return 1.0
    return low


def exponent(shares: DataFrame, budget: float, entropy: float | None, max_epochs: float | None) -> float:
    """The exponent nearest 1 whose weights have the entropy asked for, but within the repetition limit.

    ``shares`` has p (token share) and tokens of each source with tokens."""
    def power(a: Column) -> Column:
        return F.exp(a * F.log("p"))

    def spread(a: Column) -> Column:
        return F.log(F.sum(power(a))) - F.max(a) * F.sum(power(a) * F.log("p")) / F.sum(power(a))

    def beyond(a: Column) -> Column:
        return F.max(power(a) / F.col("tokens")) * F.lit(budget) / F.sum(power(a)) > F.lit(max_epochs * (1 + 1e-12))

    chosen = 1.0 if entropy is None else bisect(shares, lambda a: spread(a) >= F.lit(entropy - 1e-12))
    if max_epochs is not None and shares.agg(beyond(F.lit(chosen))).first()[0]:
        # natural weights repeat least; if they too go beyond the limit, it cannot be met
        chosen = min(bisect(shares, beyond) + 2.0 ** -STEPS, 1.0)
    return chosen


def budgets(counts: DataFrame, lift: float, max_epochs: float | None, budget: int | None) -> DataFrame:
    """(source, n, tokens, weight, target, epochs, rest): per source its token budget as whole passes and a rest.

    ``counts`` has source and tokens per document.  The entropy aimed for lies ``lift`` of the way from that
    of the natural shares to that of equal weights."""
    sources = counts.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    sources = materialise(sources)
    total, filled = sources.where("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    if not total:
        return sources.select("*", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("target"),
                              F.lit(0).cast("long").alias("epochs"), F.lit(0).cast("long").alias("rest"))
    budget = total if budget is None else budget
    shares = sources.where("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(total)))
    natural = -shares.agg(F.sum(F.col("p") * F.log("p"))).first()[0]
    a = exponent(shares, float(budget), natural + lift * (math.log(filled) - natural), max_epochs)
    raised = shares.withColumn("_w", F.exp(F.lit(a) * F.log("p")))
    z = raised.agg(F.sum("_w")).first()[0]
    weighted = raised.withColumn("weight", F.col("_w") / F.lit(z)).drop("_w", "p").unionByName(
        sources.where("NOT tokens > 0").withColumn("weight", F.lit(0.0)))
    target = F.floor(F.col("weight") * F.lit(float(budget)) + 0.5)
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(F.lit(0))
    out = weighted.withColumn("target", target).withColumn("epochs", passes.cast("long"))
    return materialise(out.withColumn("rest", F.col("target") - F.col("epochs") * F.col("tokens")))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None,
        lift: float = 0.5, max_epochs: float | None = 4.0, budget: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(plan, sources).  ``plan`` is the mixture: one row per use of a document, with ``source``, ``block``,
    ``place`` (1, 2, ... within the block), ``draw`` and ``tokens``.  ``sources`` has the weights and budgets.

    Weights are the token shares of the sources raised to an exponent in [0, 1] and normalised.  The exponent
    is bisected until the weights' entropy is ``lift`` of the way from natural to equal weights, and raised
    if a source would be repeated more than ``max_epochs`` times.  A source with a budget of b tokens gets
    floor(b / its tokens) whole blocks and a last one that takes documents while the tokens of those
    before stay under the rest.  Every block is a permutation of its own: documents in order of a hash of
    seed, block and id; equal draws are taken together.  ``budget`` is the tokens of all documents by default.

    A null source is a source; null texts have no tokens.  Sources without tokens get no weight and no rows.
    Rows that share an id share their draws.  Other columns are not read.  An empty table gives an empty plan.
    """
    tokens = token_count(F.col("text")) if tokens is None else tokens
    counts = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                     F.coalesce(tokens.cast("long"), F.lit(0)).alias("tokens")))
    sources = budgets(counts, lift, max_epochs, budget)
    # a handful of columns per source; Spark broadcasts them if they are few and splits hot keys if not
    shares = sources.where("target > 0").select(
        F.col("source").alias("_source"), "epochs", "rest", F.ceil(F.col("n") / WINDOW_ROWS).alias("_buckets"))
    uses = counts.join(shares, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    uses = uses.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))))
    uses = uses.where("block < epochs OR rest > 0").withColumn("draw", draw(F.col("block"), F.col("id"), seed))
    uses = uses.withColumn("_bucket", F.floor(F.col("draw") / F.lit(2.0 ** DRAW_BITS) * F.col("_buckets")))
    block = ["source", "block"]
    starts = uses.groupBy(*block, "_bucket").agg(F.count("*").alias("_n"), F.sum("tokens").alias("_t"))
    lower = W.partitionBy(*block).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    # n / WINDOW_ROWS rows per source and block
    starts = starts.select(F.col("source").alias("_source"), F.col("block").alias("_block"), F.col("_bucket").alias("_b"),
                           F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_rows_before"),
                           F.coalesce(F.sum("_t").over(lower), F.lit(0)).alias("_tokens_before"))
    inside = W.partitionBy(*block, "_bucket")
    ordered = uses.withColumns({
        "_row": F.row_number().over(inside.orderBy("draw", "id", "tokens")),
        "_before": F.coalesce(F.sum("tokens").over(inside.orderBy("draw").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))})
    placed = ordered.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
                          & (F.col("_bucket") == F.col("_b")))
    taken = placed.where((F.col("block") < F.col("epochs")) | (F.col("_tokens_before") + F.col("_before") < F.col("rest")))
    plan = taken.select(F.col("id").alias(id_col), "source", "block", (F.col("_rows_before") + F.col("_row")).alias("place"), "draw", "tokens")
    return plan, sources


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, **how) -> DataFrame:
    """``docs`` as the mixture: every row as often as the plan uses it, block after block, each in the order of its draws.

    The plan comes down to one number per source, the last draw of its last block, so no text is joined."""
    plan, sources = mix(docs, id_col, source_col, token_count(F.col(text_col)), seed=seed, **how)
    last = plan.groupBy("source", "block").agg(F.max("draw").alias("_last"))
    ends = materialise(sources.where("target > 0").select(F.col("source").alias("_source"), F.col("epochs").alias("_epochs"))
                       .join(last.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "_last"),
                             F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_epochs") == F.col("_b")), "left").drop("_s", "_b"))
    # the row is one column, so that no name of it can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_own"))
    uses = rows.join(ends, F.col("_own").eqNullSafe(F.col("_source")))
    uses = uses.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_epochs"))))
    uses = uses.withColumn("_draw", draw(F.col("_block"), F.col("_id"), seed))
    uses = uses.where("_block < _epochs OR _draw <= _last")
    return uses.orderBy("_block", "_draw", "_id").select("_row.*")
