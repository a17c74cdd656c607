"""The 0-100 vulnerability score, its label and its reading, as column expressions.

The only data-wide value is the range of the index, read by a scalar subquery; everything
else stays in one generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.functions.parsing import rounded
from paramo.functions.ranks import with_row


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def minmax(df: DataFrame, value: str, out: str, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Add the position of the value in the range of the data (or of fixed bounds); 0.5 without a range."""
    if bounds:
        df = df.withColumn("_span", F.struct(F.lit(float(bounds[0])).alias("low"), F.lit(float(bounds[1])).alias("high")))
    else:
        df = with_row(df, "_span", df, low=F.min(value), high=F.max(value))
    low, high = F.col("_span")["low"], F.col("_span")["high"]
    return df.withColumn(out, F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.5))).drop("_span")


def components(df: DataFrame, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Price, climate and calendar parts of the score (each already weighted)."""
    df = minmax(df, "upra_indice_total", "_norm", bounds)
    norm = F.col("_norm")
    change = (clip(F.col("upra_var_mensual_pct"), -5.0, 10.0) + 5) / 15
    rain, temp = F.col("ideam_precipitacion_anomalia"), F.col("ideam_temperatura_anomalia")
    dry = clip(-rain / 120, 0.0, 1.0)
    wet = clip(rain / 250 * 0.4, 0.0, 0.4)
    rain_risk = clip(dry + wet, 0.0, 1.0)
    heat = clip(temp / 2.5, 0.0, 1.0)
    harvest = F.when(F.col("mes").isin(fv.HARVEST_MONTHS), 22.0).otherwise(0.0)
    inflation = (F.when(F.col("anio").isin(fv.PEAK_INFLATION_YEARS), 28.0)
                 .when(F.col("anio").isin(fv.POST_INFLATION_YEARS), 12.0).otherwise(0.0))
    return df.withColumns({
        "price_part": (norm * 0.55 + change * 0.45) * 100 * 0.40,
        "climate_part": (rain_risk * 0.65 + heat * 0.35) * 100 * 0.35,
        "calendar_part": F.least(F.lit(100.0), harvest + inflation) * 0.25,
    }).drop("_norm")


def score(df: DataFrame, bounds: tuple[float, float] | None = None, digits: int | None = 2, out: str = "score") -> DataFrame:
    """Weighted sum of the parts, kept within 0-100."""
    parts = components(df, bounds)
    total = clip(F.col("price_part") + F.col("climate_part") + F.col("calendar_part"), 0.0, 100.0)
    return parts.withColumn(out, rounded(total, digits)).drop("price_part", "climate_part", "calendar_part")


def class_id(score_col: str = "score") -> Column:
    s = F.col(score_col)
    return F.when(s >= fv.CUT_HIGH, 2).when(s >= fv.CUT_MEDIUM, 1).otherwise(0)


def label_of(c: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in fv.LABELS.items() for x in (F.lit(k), F.lit(v))]), c.cast("int"))


def color_of(c: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in fv.LABEL_COLORS.items() for x in (F.lit(k), F.lit(v))]), c.cast("int"))


def labelled(df: DataFrame, score_col: str = "score") -> DataFrame:
    return df.withColumn("class_id", class_id(score_col)).withColumns(
        {"label": label_of(F.col("class_id")), "color": color_of(F.col("class_id"))})


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class with the size of the smallest class."""
    counts = df.groupBy(label).agg(F.count("*").alias("rows"))
    return counts.withColumn("smallest", counts.agg(F.min("rows")).scalar())


def interpretation(df: DataFrame, label: str = "label", change: str = "upra_var_mensual_pct",
                   rain: str = "ideam_precipitacion_mm", temp: str = "ideam_temperatura_c", out: str = "reading") -> DataFrame:
    """A sentence per row: the class, then what drives it."""
    high, medium = F.col(label) == "ALTA", F.col(label) == "MEDIA"
    ch = F.col(change)
    parts = F.concat_ws(
        " ",
        F.when(high, "Vulnerabilidad ALTA.").when(medium, "Vulnerabilidad MEDIA, conviene vigilar.")
        .otherwise("Vulnerabilidad BAJA, situación estable."),
        F.when(high & (ch > 2), F.format_string("Insumos al alza: %.1f%% en el mes.", ch)),
        F.when(high & (F.col(rain) < fv.RAIN_NORMAL_MM * 0.6), F.lit("Llueve menos de lo normal.")),
        F.when(high & (F.col(temp) > fv.TEMP_NORMAL_C + 2), F.format_string("Más calor que el promedio: %.1f °C.", F.col(temp))),
        F.when(medium & (ch > 1), F.format_string("Precios en subida: %.1f%%.", ch)),
        F.when(medium & (ch < -1), F.format_string("Precios en bajada: %.1f%%.", ch)),
    )
    return df.withColumn(out, parts)
