"""Recommendation rules over small aggregates.

A rule is a condition on one aggregate row; each operator reduces its facts with combining
aggregations first, so the rules themselves only ever see a handful of rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.operators import aggregates as agg
from paramo.operators.query import latest
from paramo.session import cut_lineage

RULE_COLUMNS = ["seq", "rule", "kind", "priority", "metric", "threshold", "actions"]

# our wording of the advice per rule
ACTIONS = {
    "fertilizante_alto": ["Adelantar la compra", "Usar abonos orgánicos", "Buscar subsidios vigentes"],
    "variacion_alta": ["Revisar contratos de suministro", "Ajustar el presupuesto de siembra"],
    "sequia": ["Activar el riego", "Vigilar los embalses", "Preferir cultivos resistentes"],
    "inundacion": ["Limpiar drenajes", "Consultar las alertas tempranas", "Proteger los cultivos bajos"],
    "calor": ["Regar con más frecuencia", "Cubrir el suelo", "Fumigar en horas frescas"],
    "evasion_alta": ["Revisar las casetas", "Auditar los puntos de evasión", "Mejorar la señalización"],
    "compuesta": ["Reunir a las entidades del sector", "Revisar el seguro agrícola", "Priorizar a pequeños productores"],
    "precio_estable": ["Leer el boletín mensual", "Comparar precios locales"],
    "clima_estable": ["Consultar el calendario agroclimático", "Planear la siembra"],
    "modelo_alta": ["Activar la asistencia en las zonas afectadas"],
    "modelo_media": ["Aumentar la frecuencia del seguimiento"],
    "alza_prevista": ["Comprar insumos antes del pico"],
    "muchas_anomalias": ["Revisar los períodos atípicos"],
    "todo_estable": ["Seguir el monitoreo normal"],
}


def rule(when: Column, seq: int, name: str, kind: str, priority: Column | str, metric: Column, threshold: float) -> Column:
    """One rule as a struct, null when it does not fire."""
    level = F.lit(priority) if isinstance(priority, str) else priority
    return F.when(when, F.struct(
        F.lit(seq).alias("seq"), F.lit(name).alias("rule"), F.lit(kind).alias("kind"), level.alias("priority"),
        metric.cast("double").alias("metric"), F.lit(float(threshold)).alias("threshold"),
        F.array(*[F.lit(a) for a in ACTIONS[name]]).alias("actions")))


def fire(df: DataFrame, rules: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("_r")).select(*by, "_r.*")


def price_rules(index: DataFrame) -> DataFrame:
    """Alerts from the last two months of the price index."""
    two = index.orderBy(F.col("month").desc()).limit(2).agg(
        F.count("*").alias("n"), F.coalesce(F.max_by("idx_total", "month"), F.lit(0.0)).alias("now"),
        F.coalesce(F.max_by("idx_fert", "month"), F.lit(0.0)).alias("fert"), F.min_by("idx_total", "month").alias("before"))
    before = F.when(F.col("n") > 1, F.nullif(F.col("before"), F.lit(0)))
    change = F.coalesce((F.col("now") - before) / before * 100, F.lit(0.0))
    high = F.when(F.col("fert") > fv.FERTILIZER_ALERT * fv.FERTILIZER_HIGH_FACTOR, "ALTA").otherwise("MEDIA")
    return fire(two, [
        rule(F.col("fert") > fv.FERTILIZER_ALERT, 1, "fertilizante_alto", "precio", high, F.col("fert"), fv.FERTILIZER_ALERT),
        rule(F.abs(change) > fv.MONTHLY_CHANGE_ALERT, 2, "variacion_alta", "precio", "MEDIA", change, fv.MONTHLY_CHANGE_ALERT)])


def climate_rules(obs: DataFrame, days: int = 7, region: str | None = None, as_of: dt.date | None = None,
                  by: Sequence[str] = ()) -> DataFrame:
    """Drought, flood and heat alerts from the last ``days`` days, for the whole or per group."""
    week = agg.climate_window(obs, days, region, as_of, by=by)
    mean, top = F.coalesce("mean", F.lit(0.0)), F.coalesce("top", F.lit(0.0))
    rain, temp = F.col("variable") == fv.RAIN, F.col("variable") == fv.TEMP
    dry = rain & (mean < fv.RAIN_LOW_MEAN) & (top < fv.RAIN_LOW_MAX)
    return fire(week, [
        rule(dry, 3, "sequia", "clima", "ALTA", mean, fv.RAIN_LOW_MEAN),
        rule(rain & ~dry & (mean > fv.RAIN_HIGH_MEAN), 4, "inundacion", "clima", "ALTA", mean, fv.RAIN_HIGH_MEAN),
        rule(temp & (mean > fv.TEMP_HIGH_MEAN), 5, "calor", "clima", "MEDIA", mean, fv.TEMP_HIGH_MEAN)], by)


def evasion_rule(tolls: DataFrame, region: str | None = None, threshold: float = fv.EVASION_ALERT_PCT) -> DataFrame:
    totals = agg.evasion(tolls, region, digits=None)
    return fire(totals, [rule((F.col("traffic") > 0) & (F.col("evasion_pct") > threshold), 6, "evasion_alta", "trafico",
                              "MEDIA", F.col("evasion_pct"), threshold)])


def compound(alerts: DataFrame) -> DataFrame:
    """One more alert when price and climate alerts are active together."""
    state = alerts.agg(
        F.coalesce(F.bool_or(F.col("kind") == "precio"), F.lit(False)).alias("price"),
        F.coalesce(F.bool_or(F.col("kind") == "clima"), F.lit(False)).alias("climate"),
        F.coalesce(F.bool_or(F.col("priority") == "ALTA"), F.lit(False)).alias("high"), F.count("*").alias("n"))
    level = F.when(F.col("high"), "ALTA").otherwise("MEDIA")
    return fire(state, [rule(F.col("price") & F.col("climate"), 0, "compuesta", "riesgo_compuesto", level, F.col("n"), 2)])


def standard(df: DataFrame) -> DataFrame:
    """The two monitoring rows given when no alert is active."""
    always = F.lit(True)
    return fire(df.sparkSession.range(1), [
        rule(always, 7, "precio_estable", "precio", "BAJA", F.lit(0.0), 0),
        rule(always, 8, "clima_estable", "clima", "BAJA", F.lit(0.0), 0)])


def priority_rank(c: str = "priority") -> Column:
    return F.when(F.col(c) == "ALTA", 0).when(F.col(c) == "MEDIA", 1).when(F.col(c) == "BAJA", 2).otherwise(3)


def prioritised(index: DataFrame, obs: DataFrame, tolls: DataFrame, region: str | None = None, n: int = 8) -> DataFrame:
    """All alerts, most urgent first, at most ``n``; monitoring rows when there are none."""
    # at most a handful of rows, looked at three times
    alerts = cut_lineage(price_rules(index).unionByName(climate_rules(obs, region=region)).unionByName(evasion_rule(tolls, region)))
    alerts = alerts.unionByName(compound(alerts))
    some = F.coalesce(alerts.agg(F.count("*")).scalar(), F.lit(0))
    rows = alerts.unionByName(standard(index).where(some == 0))
    return rows.orderBy(priority_rank(), "seq", "rule").limit(n)


def model_insights(state: DataFrame) -> DataFrame:
    """Advice from model outputs; ``state`` has label, forecast_change_pct and n_anomalies."""
    label, change, odd = F.col("label"), F.coalesce("forecast_change_pct", F.lit(0.0)), F.coalesce("n_anomalies", F.lit(0))
    high, medium, rise, many = label == "ALTA", label == "MEDIA", change > 5, odd > 5
    return fire(state, [
        rule(high, 1, "modelo_alta", "ALERTA", "ALTA", F.lit(2.0), 2),
        rule(medium, 2, "modelo_media", "MONITOREO", "MEDIA", F.lit(1.0), 1),
        rule(rise, 3, "alza_prevista", "PREVENCIÓN", "MEDIA", change, 5),
        rule(many, 4, "muchas_anomalias", "INVESTIGACIÓN", "BAJA", odd, 5),
        rule(~(high | medium | rise | many), 5, "todo_estable", "INFO", "BAJA", F.lit(0.0), 0)])
