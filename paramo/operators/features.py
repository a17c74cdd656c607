"""The monthly feature matrix.

Windows run over one row per month and series, so a window holds at most one calendar;
raw observations are reduced to months by a combining aggregation first.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.functions.parsing import rounded
from paramo.operators.query import latest


def pct_change(df: DataFrame, value: str, date: str = "month", by: Sequence[str] = (),
               out: str = "upra_var_mensual_pct", digits: int | None = 3) -> DataFrame:
    """Change against the last known earlier month in percent; the first month gets 0."""
    before = F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(date).rowsBetween(W.unboundedPreceding, -1))
    change = (F.col(value) / F.nullif(before, F.lit(0)) - 1) * 100
    return df.withColumn(out, F.coalesce(rounded(change, digits), F.lit(0.0)))


def month_of(c: str) -> Column:
    return F.trunc(F.col(c).cast("date"), "month")


def monthly(df: DataFrame, value: str = "value", ts: str = "ts", by: Sequence[str] = (),
            how: str = "avg", out: str | None = None) -> DataFrame:
    """Observations -> one row per month (and group); ``how`` is any aggregate of one column."""
    return df.groupBy(*by, month_of(ts).alias("month")).agg(getattr(F, how)(value).alias(out or value))


def seasonal_normals(spark: SparkSession, start, end, variable: str) -> DataFrame:
    """Month calendar with the expected value of the season."""
    pattern, normal = ((fv.RAIN_PATTERN, fv.RAIN_NORMAL_MM) if variable == fv.RAIN
                       else (fv.TEMP_PATTERN, fv.TEMP_NORMAL_C))
    months = F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.trunc(F.lit(end).cast("date"), "month"),
                                  F.expr("interval 1 month")))
    shares = F.array(*[F.lit(x) for x in pattern])
    return (spark.range(1).select(months.alias("month"))
            .withColumn("value", F.element_at(shares, F.month("month")) * normal))


def with_month_guard(real: DataFrame, normals: DataFrame, least: int = fv.MIN_REAL_MONTHS) -> DataFrame:
    """The real months, or the seasonal normals when there are fewer than ``least`` of them."""
    months = real.select("month").distinct().agg(F.count("*")).scalar()
    tagged = real.select("month", "value", F.lit(False).alias("is_normal")).where(months >= least)
    return tagged.unionByName(normals.select("month", "value", F.lit(True).alias("is_normal")).where(months < least))


def month_join(index: DataFrame, rain: DataFrame, temp: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Index months with the rain and temperature of the month where known."""
    return index.join(rain, [*by, "month"], "left").join(temp, [*by, "month"], "left")


def interpolate(df: DataFrame, columns: Sequence[str], order: str = "month", by: Sequence[str] = (),
                edges: bool = True) -> DataFrame:
    """Linear interpolation by row position; the ends take the nearest value when ``edges``."""
    w = W.partitionBy(*by).orderBy(order)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    df = df.withColumn("_pos", F.row_number().over(w))
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col("_pos"))
        df = df.withColumns({
            "_v0": F.last(c, ignorenulls=True).over(back), "_p0": F.last(at, ignorenulls=True).over(back),
            "_v1": F.first(c, ignorenulls=True).over(ahead), "_p1": F.first(at, ignorenulls=True).over(ahead),
        })
        between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_pos") - F.col("_p0")) / F.nullif(
            F.col("_p1") - F.col("_p0"), F.lit(0))
        ends = F.coalesce("_v0", "_v1") if edges else F.col("_v0")
        df = df.withColumn(c, F.coalesce(F.col(c), between, ends))
    return df.drop("_pos", "_v0", "_p0", "_v1", "_p1")


def fill_normal(df: DataFrame, rain: str = "rain_mm", temp: str = "temp_c") -> DataFrame:
    return df.withColumns({rain: F.coalesce(F.col(rain), F.lit(fv.RAIN_NORMAL_MM)),
                           temp: F.coalesce(F.col(temp), F.lit(fv.TEMP_NORMAL_C))})


def deltas(df: DataFrame, rain: str = "rain_mm", temp: str = "temp_c", rounding: bool = True) -> DataFrame:
    """Climate features and their distance from the normal."""
    return df.withColumns({
        "ideam_precipitacion_mm": F.col(rain),
        "ideam_precipitacion_anomalia": rounded(F.col(rain) - fv.RAIN_NORMAL_MM, 2 if rounding else None),
        "ideam_temperatura_c": F.col(temp),
        "ideam_temperatura_anomalia": rounded(F.col(temp) - fv.TEMP_NORMAL_C, 3 if rounding else None),
    })


def calendar(df: DataFrame, date: str = "month") -> DataFrame:
    return df.withColumns({"mes": F.month(date), "anio": F.year(date)})


def matrix(index: DataFrame, rain: DataFrame, temp: DataFrame, by: Sequence[str] = (), rounding: bool = True) -> DataFrame:
    """The whole feature matrix: ``index`` (month, idx_total, idx_fert, idx_pest) with monthly
    ``rain`` (month, rain_mm) and ``temp`` (month, temp_c); rows without an index are dropped."""
    df = pct_change(index, "idx_total", by=by, digits=3 if rounding else None)
    df = month_join(df, rain, temp, by)
    df = fill_normal(interpolate(df, ["rain_mm", "temp_c"], by=by))
    df = calendar(deltas(df, rounding=rounding)).where(F.col("idx_total").isNotNull())
    names = {"idx_total": "upra_indice_total", "idx_fert": "upra_fertilizantes", "idx_pest": "upra_plaguicidas"}
    return df.withColumnsRenamed(names).select(*by, F.col("month").alias("fecha"), *fv.FEATURES)


def scenario_rows(df: DataFrame, date: str = "fecha", rounding: bool = True) -> DataFrame:
    """Scenario inputs (index, change, sub-indices, rain, temperature, date) -> feature rows."""
    return calendar(deltas(df, "precipitacion_mm", "temperatura_c", rounding), date)


def latest_inputs(index: DataFrame, obs: DataFrame, days: int = 30, as_of: dt.date | None = None,
                  digits: int | None = 3) -> DataFrame:
    """One row: newest index values with the change against the previous row, and the climate
    means of the last ``days`` days, each falling back to its normal."""
    two = index.orderBy(F.col("month").desc()).limit(2).agg(
        F.max("month").alias("fecha"), F.max_by("idx_total", "month").alias("now"), F.min_by("idx_total", "month").alias("before"),
        F.max_by("idx_fert", "month").alias("upra_fertilizantes"), F.max_by("idx_pest", "month").alias("upra_plaguicidas"))
    today = F.lit(as_of) if as_of else latest(obs, "obs_date")
    recent = obs.where(F.col("obs_date") >= F.date_sub(today, days))

    def mean(variable: str, normal: float) -> Column:
        return F.coalesce(recent.where(F.col("variable") == variable).agg(F.avg("value")).scalar(), F.lit(normal))

    change = F.coalesce((F.col("now") - F.col("before")) / F.nullif(F.col("before"), F.lit(0)) * 100, F.lit(0.0))
    return two.select(
        "fecha", F.coalesce("now", F.lit(0.0)).alias("upra_indice_total"), rounded(change, digits).alias("upra_var_mensual_pct"),
        F.coalesce("upra_fertilizantes", F.lit(0.0)).alias("upra_fertilizantes"),
        F.coalesce("upra_plaguicidas", F.lit(0.0)).alias("upra_plaguicidas"),
        mean(fv.RAIN, fv.RAIN_NORMAL_MM).alias("precipitacion_mm"), mean(fv.TEMP, fv.TEMP_NORMAL_C).alias("temperatura_c"))
