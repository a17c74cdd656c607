"""Quality rules: a decision list learnt by sequential covering, as Spark conditional expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramo.llm.classifier import held_out
from paramo.llm.common import SPACE, words_of
from paramo.session import cut_lineage, materialise

#: Cut points tried per statistic and class.
CUTS = 24
#: Statistics that conditions may use; each is 0 for a text without words.
RATIOS = {
    "mean_word": "word_chars / n_words",
    "symbol_share": "n_symbols / word_chars",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / word_chars",
    "exclaim_share": "n_exclaim / n_words",
    "line_words": "n_words / n_lines",
    "n_words": "n_words / 1",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def expression(self) -> Column:
        value = F.col(self.feature)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature.lstrip('_')} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """All conditions hold: the document is rejected.  ``precision`` is that on the pruning rows."""

    conditions: tuple[Condition, ...]
    precision: float

    def expression(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.expression()
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


def left_over(text: Column, others: str) -> Column:
    """How many characters remain when runs of ``others`` are taken out."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_exclaim) of every text.

    A word is repeated if a window of three words that holds it occurs twice or more in its text.  Windows
    are compared by 64-bit hashes inside the row: hashes with their places are sorted, equal neighbours
    are repeated windows, and the places these cover are counted.  Nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", text.alias("text"), words_of(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    rows = rows.withColumn("_lines", lines)
    counted = rows.select(
        "id", "w", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        left_over(F.col("text"), "[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"), left_over(F.col("text"), r"\P{Lu}+").alias("n_upper"),
        left_over(F.col("text"), "[^!]+").alias("n_exclaim"))
    numbers = [c for c in counted.columns if c != "w"]
    places = F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))
    hashed = counted.select(*numbers, F.sort_array(F.transform(places, lambda i: F.struct(
        F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")))).alias("s"))
    again = F.filter(F.transform("s", lambda x, k: F.when(
        (F.get("s", k - 1)["h"] == x["h"]) | (F.get("s", k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
    marked = hashed.select(*numbers, again.alias("r"))
    covered = F.array_distinct(F.concat("r", F.transform("r", lambda i: i + 1), F.transform("r", lambda i: i + 2)))
    return marked.select(*numbers, F.size(covered).cast("long").alias("n_repeat_words"))


def with_ratios(stats: DataFrame) -> DataFrame:
    """The statistics that conditions use, under their names in RATIOS with ``_`` before ``n_words``."""
    out = {}
    for name, ratio in RATIOS.items():
        above, below = ratio.split(" / ")
        divisor = F.lit(1.0) if below == "1" else F.col(below).cast("double")
        out[feature_name(name)] = F.when(divisor > 0, F.col(above).cast("double") / divisor).otherwise(F.lit(0.0))
    return stats.withColumns(out)


def feature_name(name: str) -> str:
    return f"_{name}"


def cut_points(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """Thresholds to try per statistic: the middles between neighbouring quantiles (least and greatest value
    included) of both classes, so that a rare class has its own and a threshold keeps clear of both."""
    probs = [i / CUTS for i in range(CUTS + 1)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(f, probs, 10_000).alias(f) for f in features]).collect()
    points = [sorted({v for r in found for v in r[f]}) for f in features]
    return [[(x + y) / 2 for x, y in zip(p, p[1:])] for p in points]


def bin_of(feature: str, cuts: list[float]) -> Column:
    """How many cut points lie below the statistic."""
    return F.size(F.filter(F.array(*[F.lit(float(v)) for v in cuts]).cast("array<double>"), lambda v: v < F.col(feature)))


def foil_gain(p: float, n: float, p_all: float, n_all: float) -> float:
    if p == 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p_all / (p_all + n_all)))


def learn(labelled: DataFrame, most_rules: int = 8, most_conditions: int = 3, least_precision: float = 0.9,
          least_support: int = 10) -> list[Rule]:
    """Rules that reject, learnt from rows with ``id``, ``bad`` (0/1) and the statistics of RATIOS.

    Two thirds of the rows, by hash, grow a rule: the condition with the largest information gain is added
    until no good row is covered.  The other third prunes it: trailing conditions go while that raises
    (p - n) / (p + n).  A rule enters the list if its precision on the pruning rows is ``least_precision``;
    the rows it covers are set aside, and covering goes on.  Every step is one aggregation of all rows to
    a histogram of a few hundred cells; only that comes to the driver.
    """
    features = [feature_name(f) for f in RATIOS]
    cuts = cut_points(labelled, features)
    if not any(cuts):
        return []
    bins = F.array(*[bin_of(f, c) for f, c in zip(features, cuts)])
    rows = cut_lineage(labelled.select(F.col("bad").cast("int").alias("bad"), (F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(3)) > 0).alias("grow"),
                                       bins.alias("bins")).groupBy("bad", "grow", "bins").agg(F.count("*").alias("n")))
    p, n = F.sum(F.col("bad") * F.col("n")), F.sum((1 - F.col("bad")) * F.col("n"))

    def holds(conditions) -> Column:
        out = F.lit(True)
        for f, above, k in conditions:
            out = out & ((F.col("bins")[f] > k) if above else (F.col("bins")[f] <= k))
        return out

    def count(part: DataFrame) -> tuple[float, float]:
        r = part.agg(p, n).first()
        return float(r[0] or 0), float(r[1] or 0)

    def best(part: DataFrame, p_all: float, n_all: float):
        cells: dict[int, dict[int, tuple[float, float]]] = {}
        for r in part.select("bad", "n", F.posexplode("bins").alias("f", "k")).groupBy("f", "k").agg(p.alias("p"), n.alias("q")).collect():
            cells.setdefault(r["f"], {})[r["k"]] = (float(r["p"]), float(r["q"]))
        top = (1e-9, None)
        for f in sorted(cells):
            below_p = below_n = 0.0
            for k in range(len(cuts[f])):  # the threshold cuts[f][k] lies between bins k and k + 1
                dp, dn = cells[f].get(k, (0.0, 0.0))
                below_p, below_n = below_p + dp, below_n + dn
                for above, pp, nn in ((False, below_p, below_n), (True, p_all - below_p, n_all - below_n)):
                    if pp >= least_support and (g := foil_gain(pp, nn, p_all, n_all)) > top[0]:
                        top = (g, (f, above, k), pp, nn)
        return top

    rules: list[Rule] = []
    left = rows
    for _ in range(most_rules):
        conditions: list[tuple[int, bool, int]] = []
        grow, prune = left.where("grow"), left.where("NOT grow")
        p_all, n_all = count(grow)
        while p_all >= least_support and n_all and len(conditions) < most_conditions:
            found = best(grow.where(holds(conditions)), p_all, n_all)
            if found[1] is None:
                break
            conditions.append(found[1])
            p_all, n_all = found[2], found[3]
        if not conditions:
            break
        worth = []
        for size in range(1, len(conditions) + 1):
            pp, nn = count(prune.where(holds(conditions[:size])))
            worth.append(((pp - nn) / (pp + nn) if pp + nn else -1.0, -size, pp / (pp + nn) if pp + nn else 0.0))
        value, size, precision = max(worth)
        conditions = conditions[:-size]
        if precision < least_precision:
            break
        rules.append(Rule(tuple(Condition(features[f], above, cuts[f][k]) for f, above, k in conditions), precision))
        left = left.where(~holds(conditions))
    return rules


def fired(rules: list[Rule]) -> Column:
    """The first rule that rejects a document, as text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.expression(), F.lit(str(rule))).otherwise(out)
    return out


def judged(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule), one row per row.

    ``base_failed``: under 50 words, or over half of the words repeated.  ``kept`` is false there; else it
    is the verdict of a decision list that is learnt from the labelled rows that are not held out (every
    fifth id by CRC-32) and pass the base rule; ``rule`` is the rule that rejects.  See ``learn``.

    Null and empty texts have no words and fail the base rule.  Ids whose labels contradict each other are
    not learnt from; without labels of both kinds there are no rules.  Repeated rows get equal results.
    Other columns are not read.  An empty table gives an empty one.
    """
    stats = materialise(statistics(df, id_col, text_col))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = with_ratios(stats.withColumn("base_failed", base))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(~held_out(F.col("id")) & F.col("label").isNotNull())
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most")
    learnt = learn(stats.where("NOT base_failed").join(known, "id").withColumn("bad", F.when(F.col("label") == 0, 1).otherwise(0)), **how)
    out = stats.withColumn("rule", F.when(~F.col("base_failed"), fired(learnt)))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
