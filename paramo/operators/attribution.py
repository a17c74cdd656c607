"""Feature attributions: Shapley values of a model or of the closed-form score, rankings and texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.functions.ranks import hash_ranks, running_totals
from paramo.operators import score as sc
from paramo.session import cut_lineage


def summary(background: DataFrame, columns: Sequence[str] = tuple(fv.FEATURES), by: Sequence[str] = ("class_id",)) -> DataFrame:
    """The mean row of each group with its number of rows as ``weight``: a background of a few rows that all rows enter."""
    return background.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").cast("double").alias("weight")).drop(*by)


def model_shapley(rows: DataFrame, background: DataFrame, key: str, predict: Callable[[DataFrame], DataFrame], value: str,
                  columns: Sequence[str] = tuple(fv.FEATURES), permutations: int = 8, seed: int = 2026) -> DataFrame:
    """(key, feature, contribution): sampled interventional Shapley values of ``value`` as given by ``predict``.

    For every row, background row and feature order, features move from the background to the row one by
    one; all of these hybrid rows go through the model in one batch.  Each step's change belongs to the
    feature that moved, so contributions of a row add up to its value minus the weighted mean of the background.
    The whole background is used, a column ``weight`` counting if it has one, and the model is asked
    rows x background x permutations x features times: pass a ``summary`` of a large background.
    """
    rng = np.random.default_rng(seed)
    k = len(columns)
    orders = [rng.permutation(k).tolist() for _ in range(permutations)]
    place = F.array(*[F.array(*[F.lit(int(o.index(j))) for j in range(k)]) for o in orders])
    at = F.array(*[F.array(*[F.lit(int(j)) for j in o]) for o in orders])
    weight = F.col("weight").cast("double") if "weight" in background.columns else F.lit(1.0)
    listed = background.select(F.struct(*columns).alias("_b"), weight.alias("_w"))
    full = rows.select(key, *columns).crossJoin(listed)
    full = (full.withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
            .withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(k)))))
    hybrid = full.select(key, "_perm", "_step", "_w", *[
        F.when(F.get(F.get(place, F.col("_perm")), F.lit(j)) < F.col("_step"), F.col(c).cast("double")).otherwise(F.col(f"_b.{c}").cast("double")).alias(c)
        for j, c in enumerate(columns)])
    valued = predict(hybrid).select(key, "_perm", "_step", "_w", F.col(value).alias("_v"))
    moved = lambda step: F.get(F.get(at, F.col("_perm")), step)
    parts = F.filter(F.array(
        F.when(F.col("_step") > 0, F.struct(moved(F.col("_step") - 1).alias("f"), F.col("_v").alias("d"))),
        F.when(F.col("_step") < k, F.struct(moved(F.col("_step")).alias("f"), (-F.col("_v")).alias("d")))), lambda p: p.isNotNull())
    # each background row and order adds one positive and one negative part per feature
    sums = valued.select(key, "_w", F.explode(parts).alias("_p")).groupBy(key, F.col("_p.f").alias("_f")).agg(
        (F.sum(F.col("_w") * F.col("_p.d")) / (F.sum("_w") / 2)).alias("contribution"))
    return sums.select(key, F.get(F.array(*[F.lit(c) for c in columns]), F.col("_f")).alias("feature"), "contribution")


# feature groups whose members move together in the exact attribution of the score; the score is the sum
# of one part per group, kept within 0-100
GROUPS = {
    "precio": ["upra_indice_total", "upra_var_mensual_pct"],
    "lluvia": ["ideam_precipitacion_anomalia"],
    "temperatura": ["ideam_temperatura_anomalia"],
    "calendario": ["mes", "anio"],
}
_LOW, _HIGH = 0.0, 100.0


def _parts(df: DataFrame, bounds: tuple[float, float]) -> DataFrame:
    """The part of each group, by columns named as the groups."""
    rain, heat = F.col("ideam_precipitacion_anomalia"), F.col("ideam_temperatura_anomalia")
    zero = F.lit(0.0)
    whole = df.withColumns({"_rain": rain, "_heat": heat})
    dry = sc.components(whole.withColumn("ideam_temperatura_anomalia", F.when(heat.isNotNull(), zero)), bounds)
    dry = dry.withColumnsRenamed({"price_part": "precio", "calendar_part": "calendario", "climate_part": "lluvia"})
    warm = dry.withColumns({"ideam_precipitacion_anomalia": F.when(F.col("_rain").isNotNull(), zero), "ideam_temperatura_anomalia": F.col("_heat")})
    return sc.components(warm, bounds).withColumnRenamed("climate_part", "temperatura").drop("price_part", "calendar_part", "_rain", "_heat")


def score_shapley(rows: DataFrame, background: DataFrame, key: str, bounds: tuple[float, float]) -> DataFrame:
    """(key, feature, contribution): exact Shapley values of the score over all sets of feature groups.

    The whole background counts, without a row meeting it: the score is a sum of parts, so a group's value
    is its part less the background's mean of that part.  Only the limits of the score, 0 and 100, make
    groups interact.  For each set of groups that come from the row, how far the limits cut the
    background's mean follows from running sums over the sorted background, read at the row's own sum.
    """
    names = list(GROUPS)
    g = len(names)
    columns = [c for cs in GROUPS.values() for c in cs]
    own = cut_lineage(_parts(rows.select(key, *columns), bounds).select(key, *names))
    other = cut_lineage(_parts(background.select(*columns), bounds).select(*names).dropna())
    total = F.struct(*[F.avg(n).alias(n) for n in names])
    linear = own.withColumn("_mean", other.agg(total).scalar())
    linear = linear.select(key, *[(F.col(n) - F.col(f"_mean.{n}")).alias(n) for n in names])

    def part_sum(mask: int, inside: bool) -> Column:
        return sum((F.col(n) for j, n in enumerate(names) if bool(mask >> j & 1) == inside), F.lit(0.0))

    masks = range(2 ** g)
    ends = own.agg(*[F.struct(F.min(part_sum(m, True)), F.max(part_sum(m, True))).alias(f"m{m}") for m in masks]).first()
    rest = other.agg(*[F.struct(F.min(part_sum(m, False)), F.max(part_sum(m, False))).alias(f"m{m}") for m in masks]).first()
    cut = [m for m in masks if None not in (*ends[m], *rest[m]) and (ends[m][0] + rest[m][0] < _LOW or ends[m][1] + rest[m][1] > _HIGH)]
    weight = lambda size: factorial(size) * factorial(g - size - 1) / factorial(g)
    coef = [[weight(bin(m).count("1") - 1) if m >> j & 1 else -weight(bin(m).count("1")) for j in range(g)] for m in masks]
    if cut:
        by_mask = lambda inside: F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), part_sum(m, inside).alias("x")) for m in cut]))
        asked = own.select(key, by_mask(True).alias("q")).select(key, "q.mask", F.col("q.x").alias("_x")).where("_x IS NOT NULL")
        asked = cut_lineage(asked.withColumns({"_top": F.lit(_HIGH) - F.col("_x"), "_low": F.lit(_LOW) - F.col("_x")}))
        held = other.select(by_mask(False).alias("q")).select("q.mask", F.col("q.x").alias("b"), F.lit(1.0).alias("n"))
        marks = asked.select("mask", F.col("_top").alias("b"), F.lit(0.0).alias("n")).unionByName(
            asked.select("mask", F.col("_low").alias("b"), F.lit(0.0).alias("n")))
        sums = cut_lineage(running_totals(held.unionByName(marks), "b", {"n": F.col("n"), "s": F.col("b") * F.col("n")}, ["mask"]))
        at_top = sums.select("mask", F.col("b").alias("_top"), (F.col("n_total") - F.col("n_before") - F.col("n")).alias("_n_up"),
                             (F.col("s_total") - F.col("s_before") - F.col("s")).alias("_s_up"), F.col("n_total").alias("_all"))
        at_low = sums.select("mask", F.col("b").alias("_low"), F.col("n_before").alias("_n_down"), F.col("s_before").alias("_s_down"))
        off = asked.join(at_top, ["mask", "_top"]).join(at_low, ["mask", "_low"]).withColumn(
            "_d", (F.col("_low") * F.col("_n_down") - F.col("_s_down") - F.col("_s_up") + F.col("_top") * F.col("_n_up")) / F.col("_all"))
        table = F.get(F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in coef]), F.col("mask"))
        moved = off.groupBy(key).agg(*[F.sum(F.get(table, F.lit(j)) * F.col("_d")).alias(f"_o_{n}") for j, n in enumerate(names)])
        linear = linear.join(moved, key, "left").select(key, *[(F.col(n) + F.coalesce(f"_o_{n}", F.lit(0.0))).alias(n) for n in names])
    return linear.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("contribution")) for n in names])))


def global_importance(contributions: DataFrame, feature: str = "feature", value: str = "contribution") -> DataFrame:
    return contributions.groupBy(feature).agg(F.avg(F.abs(value)).alias("importance"))


def title_of(feature: Column) -> Column:
    names = F.create_map(*[x for k, v in fv.FEATURE_TITLES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(names, feature), feature)


def top_factors(contributions: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n largest contributions per row, with rank, title and sign colour (a row has one entry per feature)."""
    w = W.partitionBy(key).orderBy(F.abs("contribution").desc(), "feature")
    ranked = contributions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.withColumns({"title": title_of(F.col("feature")),
                               "color": F.when(F.col("contribution") > 0, "#EF4444").otherwise("#3B82F6")})


def importance_pct(importance: DataFrame) -> DataFrame:
    """Share of the total in percent, largest first."""
    total = importance.agg(F.sum("importance")).scalar()
    out = importance.withColumn("_t", F.coalesce(F.nullif(total, F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("importance_pct", F.col("importance") / F.col("_t") * 100).drop("_t").orderBy(F.col("importance").desc(), "feature")


def explanation(contributions: DataFrame, key: str, label: str = "label", threshold: float = 0.5) -> DataFrame:
    """One sentence per row: class, up to three raising and two lowering factors, and both totals.

    ``contributions`` carries the row's label.  Only the five largest factors are named.
    """
    top = top_factors(contributions, key)
    up, down = F.col("contribution") > threshold, F.col("contribution") < -threshold
    w = lambda side: F.sum(side.cast("int")).over(W.partitionBy(key).orderBy("rank"))
    top = top.withColumns({"_u": w(up), "_d": w(down)})
    text = (F.when(up & (F.col("_u") <= 3), F.concat(F.lit("Sube el riesgo: "), F.col("title"), F.lit(".")))
            .when(down & (F.col("_d") <= 2), F.concat(F.lit("Baja el riesgo: "), F.col("title"), F.lit("."))))
    order = F.when(up, F.col("rank")).otherwise(F.col("rank") + 100)
    parts = top.groupBy(key).agg(F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct(order.alias("o"), text.alias("t"))))).alias("_p"))
    totals = contributions.groupBy(key).agg(
        F.first(label).alias(label),
        F.sum(F.when(F.col("contribution") > 0, F.col("contribution")).otherwise(0.0)).alias("total_positive"),
        F.sum(F.when(F.col("contribution") < 0, F.col("contribution")).otherwise(0.0)).alias("total_negative"))
    head = (F.when(F.col(label) == "ALTA", "Riesgo alto.").when(F.col(label) == "MEDIA", "Riesgo moderado.")
            .when(F.col(label) == "BAJA", "Condiciones favorables.").otherwise("Estado calculado."))
    body = F.when(F.size("_p") == 0, F.lit("Nada se aparta de lo normal.")).otherwise(F.concat_ws(" ", F.col("_p.t")))
    return totals.join(parts, key).select(key, F.concat_ws(" ", head, body).alias("explanation"), "total_positive", "total_negative")


def permutation_importance(df: DataFrame, key: str, predict: Callable[[DataFrame], DataFrame], columns: Sequence[str] = tuple(fv.FEATURES),
                           label: str = "class_id", seed: int = 2026) -> DataFrame:
    """(feature, importance): loss of accuracy when one column is shuffled.

    The shuffle pairs rows by their rank under two hashes: a join on unique ranks, the same on any cluster.
    """
    a = hash_ranks(df.select(key, *columns, label), [key], seed).withColumnRenamed("draw_rank", "_rank").drop("draw", "group_size")
    b = hash_ranks(df.select(key, *columns), [key], seed + 1).select(F.col("draw_rank").alias("_rank"), F.struct(*columns).alias("_other"))
    paired = a.join(b, "_rank")
    # one pass over (row, shuffled feature); feature null is the untouched row
    names = F.array(F.lit("-"), *[F.lit(c) for c in columns])
    long = paired.withColumn("_shuffled", F.explode(names))
    mixed = long.select(key, label, "_shuffled", *[
        F.when(F.col("_shuffled") == c, F.col(f"_other.{c}")).otherwise(F.col(c)).alias(c) for c in columns])
    right = predict(mixed).groupBy("_shuffled").agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"))
    base = right.where(F.col("_shuffled") == "-").select("accuracy").scalar()
    out = right.withColumn("_base", base).where(F.col("_shuffled") != "-")
    return out.select(F.col("_shuffled").alias("feature"), (F.col("_base") - F.col("accuracy")).alias("importance"))
