"""Dashboard aggregates: partial aggregation on the map side, top-k on the result."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.functions.parsing import contains_ci, rounded
from paramo.operators.query import latest


def top_sum(df: DataFrame, key: str, value: str, n: int | None, out: str = "total", also: Mapping[str, Column] | None = None) -> DataFrame:
    """Sum per key, largest first, ties by key."""
    agg = df.groupBy(key).agg(F.sum(value).alias(out), *[c.alias(a) for a, c in (also or {}).items()])
    ordered = agg.orderBy(F.col(out).desc(), key)
    return ordered.limit(n) if n else ordered


def share_pct(part: Column, whole: Column) -> Column:
    """part / whole in percent; 0 when there is nothing to divide by."""
    return F.coalesce(F.when(whole > 0, part / whole * 100), F.lit(0.0))


def traffic_kpis(df: DataFrame) -> DataFrame:
    out = df.agg(F.coalesce(F.sum("traffic"), F.lit(0)).alias("traffic"),
                 F.coalesce(F.sum("evaders"), F.lit(0)).alias("evaders"),
                 F.countDistinct("site").alias("sites"))
    return out.withColumn("evasion_pct", share_pct(F.col("evaders"), F.col("traffic")))


def evasion(df: DataFrame, region: str | None = None, denominator: str = "traffic",
            digits: int | None = 2) -> DataFrame:
    """Totals and evasion rate; ``denominator='all'`` divides by traffic plus evaders."""
    if region:
        df = df.where(contains_ci("region", region))
    out = df.agg(F.coalesce(F.sum("traffic"), F.lit(0)).alias("traffic"),
                 F.coalesce(F.sum("evaders"), F.lit(0)).alias("evaders"), F.count("*").alias("periods"))
    whole = F.col("traffic") if denominator == "traffic" else F.col("traffic") + F.col("evaders")
    return out.withColumn("evasion_pct", rounded(share_pct(F.col("evaders"), whole), digits))


def climate_window(df: DataFrame, days: int = 7, region: str | None = None, as_of: dt.date | None = None,
                   date: str = "obs_date", by: Sequence[str] = ()) -> DataFrame:
    """Mean, maximum and count per variable over the last ``days`` days."""
    today = F.lit(as_of) if as_of else latest(df, date)
    out = df.where(F.col(date) >= F.date_sub(today, days))
    if region:
        out = out.where(contains_ci("region", region))
    return out.groupBy(*by, "variable").agg(
        F.avg("value").alias("mean"), F.max("value").alias("top"), F.count("*").alias("n"))


def mean_of(variable: str) -> Column:
    return F.avg(F.when(F.col("variable") == variable, F.col("value")))


def region_pivot(df: DataFrame, n: int = 8, label: str = "Sin geo") -> DataFrame:
    """Mean rain and temperature side by side per region, wettest first."""
    out = df.groupBy(F.coalesce("region", F.lit(label)).alias("region")).agg(
        mean_of(fv.RAIN).alias("rain"), mean_of(fv.TEMP).alias("temp"))
    return (out.where(F.col("rain").isNotNull() | F.col("temp").isNotNull())
            .orderBy(F.coalesce("rain", F.lit(0.0)).desc(), "region").limit(n))


def climate_kpis(df: DataFrame) -> DataFrame:
    return df.agg(
        mean_of(fv.RAIN).alias("mean_rain"), mean_of(fv.TEMP).alias("mean_temp"),
        F.count_if(F.col("variable") == fv.RAIN).alias("n_rain"),
        F.count_if(F.col("variable") == fv.TEMP).alias("n_temp"),
        F.countDistinct("station").alias("stations"))


def region_top(df: DataFrame, n: int = 10, digits: int | None = 2, label: str = "Desconocido") -> DataFrame:
    out = df.groupBy(F.coalesce("region", F.lit(label)).alias("region")).agg(
        rounded(F.avg("value"), digits).alias("mean"))
    return out.orderBy(F.col("mean").desc(), "region").limit(n)


def regions_covered(df: DataFrame, days: int = 7, as_of: dt.date | None = None, date: str = "obs_date") -> DataFrame:
    today = F.lit(as_of) if as_of else latest(df, date)
    return df.where(F.col(date) >= F.date_sub(today, days)).agg(
        F.countDistinct("region").alias("regions"), F.count("*").alias("rows"))


def zone_gap(df: DataFrame, value: str = "pct_internet", zone: str = "zone", warn_at: float = 25.0) -> DataFrame:
    """Mean per zone (null counts as 0), the urban minus rural gap and its warning."""
    def mean(name: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col(zone) == name, F.coalesce(value, F.lit(0.0)))), F.lit(0.0))
    out = df.agg(mean("urbana").alias("urban"), mean("rural").alias("rural"))
    gap = F.col("urban") - F.col("rural")
    return out.withColumns({"gap": gap, "warn": gap > warn_at})


def coverage_by_level(df: DataFrame, levels: Sequence[str] = tuple(fv.EDUCATION_LEVELS)) -> DataFrame:
    """Mean net coverage per level; 0 for a level without rows."""
    means = df.agg(*[F.coalesce(F.avg(F.when(F.col("level") == lv, F.col("net_rate"))), F.lit(0.0)).alias(lv)
                     for lv in levels])
    rows = F.array(*[F.struct(F.lit(lv).alias("level"), F.col(lv).alias("mean_net_rate")) for lv in levels])
    return means.select(F.inline(rows))


def pivot_levels(df: DataFrame, keys: Sequence[str] = ("place", "year"), order: str = "row_id",
                 levels: Sequence[str] = tuple(fv.EDUCATION_LEVELS), high: float = 6.0) -> DataFrame:
    """One row per place and year, the last record of each level side by side."""
    def last(level: str, value: str) -> Column:
        mine = F.col("level") == level
        return F.max_by(F.when(mine, F.col(value)), F.when(mine, F.col(order)))
    aggs = [last(lv, v).alias(f"{lv}_{v}") for lv in levels for v in ("net_rate", "dropout_rate")]
    out = df.where(F.col("level").isin(list(levels))).groupBy(*keys).agg(*aggs)
    flag = F.lit(False)
    for lv in levels:
        flag = flag | F.coalesce(F.col(f"{lv}_dropout_rate") > high, F.lit(False))
    return out.withColumn("high_dropout", flag)


def banded(df: DataFrame, band: Column, name: str = "band") -> DataFrame:
    return df.groupBy(band.alias(name)).agg(F.count("*").alias("rows"))


def severity(score: str) -> Column:
    return F.when(F.col(score) < -0.2, "ALTA").when(F.col(score) < -0.1, "MEDIA").otherwise("BAJA")


def movement(change: str) -> Column:
    return F.when(F.col(change) > 0.5, "sube").when(F.col(change) < -0.5, "baja").otherwise("estable")


def coverage_band(pct: str) -> Column:
    return F.when(F.col(pct) >= 65, "alta").when(F.col(pct) >= 40, "media").otherwise("baja")


def price_band(idx: str) -> Column:
    v = F.col(idx)
    return (F.when(v > 130, "critico").when(v > 110, "alto").when(v >= 95, "normal").when(v < 95, "bajo"))


# The three operators below rank periods within a series: at most one calendar per window.

def change_over(df: DataFrame, periods: int = 12, value: str = "idx_total", date: str = "month",
                by: Sequence[str] = (), digits: int | None = 2) -> DataFrame:
    """Change of the last row against the row ``periods`` earlier; null when the series is shorter."""
    past = F.lag(value, periods).over(W.partitionBy(*by).orderBy(date))
    out = df.withColumn("_past", past).groupBy(*by).agg(
        F.max(date).alias("last"), F.max_by(value, date).alias("now"), F.max_by("_past", date).alias("past"))
    return out.withColumn("change_pct", rounded((F.col("now") - F.col("past")) / F.nullif(F.col("past"), F.lit(0)) * 100, digits))


def last_periods(df: DataFrame, n: int | None, date: str = "month", by: Sequence[str] = ()) -> DataFrame:
    if n is None:
        return df
    if not by:
        return df.orderBy(F.col(date).desc()).limit(n)
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(F.col(date).desc()))).where(F.col("_rn") <= n).drop("_rn")


def recent_change(df: DataFrame, n: int = 6, value: str = "idx_total", date: str = "month",
                  sub: Sequence[str] = ("idx_fert", "idx_pest"), by: Sequence[str] = (), digits: int | None = 2) -> DataFrame:
    """First-to-last change over the last ``n`` periods with the latest sub-indices."""
    out = last_periods(df, n, date, by).groupBy(*by).agg(
        F.max(date).alias("last"), F.min_by(value, date).alias("first_value"), F.max_by(value, date).alias("last_value"),
        *[F.max_by(c, date).alias(c) for c in sub])
    a, b = F.nullif(F.col("first_value"), F.lit(0)), F.nullif(F.col("last_value"), F.lit(0))
    return out.withColumn("change_pct", rounded((b - a) / a * 100, digits))
