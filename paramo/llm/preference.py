"""Preference formatting: the common prompt once, and a masked completion per side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Turns of one text whose offsets one window task orders.
CHUNK = 256


def neighbours(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(pair_id, chosen, rejected): conversations 2k and 2k + 1, where there are both."""
    ids = turns.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    odd = F.pmod("id", F.lit(2)) == 1
    pairs = ids.groupBy(F.floor(F.col("id") / 2).cast("long").alias("pair_id")).agg(
        F.max(F.when(~odd, F.col("id"))).alias("chosen"), F.max(F.when(odd, F.col("id"))).alias("rejected"))
    return pairs.where("chosen IS NOT NULL AND rejected IS NOT NULL")


def segments(turns: DataFrame, pairs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text", learn_from: str = "assistant") -> DataFrame:
    """One row per rendered turn of every pair: (pair_id, part, turn, role, segment, start, mask_from, mask_to).

    ``pairs`` has pair_id, chosen and rejected.  The turns up to the first that differs between the two
    conversations (in role or text, or that one of them lacks) are the ``part`` 'prompt' and rendered once;
    the others are the parts 'chosen' and 'rejected'.  A turn is rendered as ``<|role|>``, a line end, the text,
    ``<|end|>`` and a line end.  ``start`` is its offset in the text of its part.  ``mask_from`` and ``mask_to``
    are the offsets in the part between which a trainer counts the loss: text and end mark of completion
    turns of role ``learn_from``; null elsewhere.

    The form is long, a row per turn, so that a conversation of any length is spread over tasks; a part's text is its
    segments in order of start.  Rows without id or turn have no place and are left out; null roles and texts count as
    empty.  Rows that share id and turn are one turn: equal ones are taken once, others in order of role and
    text.  If one conversation is a prefix of the other, its completion has no rows.  Other columns are not read.
    Empty tables give an empty one.
    """
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id IS NOT NULL AND turn IS NOT NULL").distinct()
    sides = pairs.select("pair_id", F.explode(F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("chosen").alias("id")),
        F.struct(F.lit("rejected").alias("side"), F.col("rejected").alias("id")))).alias("s")).select("pair_id", "s.side", "s.id")
    placed = rows.join(sides, "id").select("pair_id", "side", "turn", "role", "text")
    chosen = F.col("side") == "chosen"
    sign = F.when(chosen, 1).otherwise(-1)
    # what a turn says on the two sides cancels out if and only if it is the same
    marks = placed.groupBy("pair_id", "turn").agg(
        F.sum(sign).alias("n"), *[F.sum(sign * F.xxhash64(F.lit(seed), "role", "text").cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)])
    differs = marks.where("n <> 0 OR h1 <> 0 OR h2 <> 0").groupBy("pair_id").agg(F.min("turn").alias("_first"))
    joined = placed.join(differs, "pair_id", "left")
    common = F.coalesce(F.col("turn") < F.col("_first"), F.lit(True))
    parts = joined.where(~common | chosen).withColumn("part", F.when(common, "prompt").otherwise(F.col("side")))
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    shown = parts.withColumns({"head": F.length(head), "segment": F.concat(head, F.col("text"), F.lit("<|end|>\n")),
                               "_chunk": F.floor(F.col("turn") / CHUNK)}).withColumn("_size", F.length("segment").cast("long"))
    by = ["pair_id", "part"]
    before = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = shown.groupBy(*by, "_chunk").agg(F.sum("_size").alias("_sum")).select(
        *by, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*by, "_chunk").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    out = shown.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(starts, [*by, "_chunk"])
    start = F.col("_base") + F.col("_in")
    learnt = (F.col("part") != "prompt") & (F.col("role") == learn_from)
    return out.select("pair_id", "part", "turn", "role", "segment", start.alias("start"),
                      F.when(learnt, start + F.col("head")).alias("mask_from"),
                      F.when(learnt, start + F.col("_size") - 1).alias("mask_to"))
