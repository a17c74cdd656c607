"""Registered queries: feature matrix (F) and score (G)."""

from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.operators import features as f
from paramo.operators import score as s
from paramo.plans.catalog import Inputs, query
from paramo.plans.clean import sql_values

PREV = "lag(idx_total) OVER (ORDER BY month)"
CHANGE = f"coalesce((idx_total / {PREV} - 1) * 100, 0)"


@query("feat_pct_change", f"SELECT month, {CHANGE} AS upra_var_mensual_pct FROM b_index", "b_index")
def feat_pct_change(i: Inputs):
    return f.pct_change(i("b_index"), "idx_total", digits=None).select("month", "upra_var_mensual_pct")


@query("feat_monthly_mean", """SELECT region, variable, CAST(date_trunc('month', ts) AS DATE) AS month, avg(value) AS value
FROM b_sensor GROUP BY 1, 2, 3""", "b_sensor")
def feat_monthly_mean(i: Inputs):
    return f.monthly(i("b_sensor"), by=["region", "variable"])


NORMALS = ("(VALUES " + sql_values((float(m + 1), r, t) for m, (r, t) in enumerate(zip(fv.RAIN_PATTERN, fv.TEMP_PATTERN)))
           + ") AS p(m, rain, temp)")


@query("feat_min_months_guard", f"""
WITH real AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, avg(value) AS value FROM b_sensor
  WHERE variable = 'precipitacion_mm' AND value >= 0 AND value < 1000 GROUP BY 1),
 span AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM b_index),
 normal AS (SELECT s.month, p.rain * 150 AS value FROM span s JOIN {NORMALS} ON p.m = month(s.month))
SELECT 'climate' AS source, month, value, false AS is_normal FROM b_rain_rows WHERE (SELECT count(*) FROM b_rain_rows) >= 3
UNION ALL SELECT 'sensor', month, value, false FROM real WHERE (SELECT count(*) FROM real) >= 3
UNION ALL SELECT 'sensor', month, value, true FROM normal WHERE (SELECT count(*) FROM real) < 3
""".replace("b_rain_rows", "(SELECT month, rain_mm AS value FROM b_climate_month) r"), "b_sensor b_index b_climate_month")
def feat_min_months_guard(i: Inputs):
    from paramo.operators.normalise import plausible
    obs = plausible(i("b_sensor")).where(F.col("variable") == fv.RAIN)
    span = i("b_index").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    normals = f.seasonal_normals(i.spark, span.select("a").scalar(), span.select("b").scalar(), fv.RAIN)
    climate = i("b_climate_month").select("month", F.col("rain_mm").alias("value"))
    return (f.with_month_guard(climate, normals).withColumn("source", F.lit("climate"))
            .unionByName(f.with_month_guard(f.monthly(obs), normals).withColumn("source", F.lit("sensor"))))


JOINED = """SELECT i.month, i.idx_total, i.idx_fert, i.idx_pest, c.rain_mm, c.temp_c
FROM b_index i LEFT JOIN b_climate_month c ON c.month = i.month"""
USES = "b_index b_climate_month"


def rain_temp(i: Inputs):
    climate = i("b_climate_month")
    return climate.select("month", "rain_mm"), climate.select("month", "temp_c")


def joined(i: Inputs):
    return f.month_join(i("b_index").select("month", "idx_total", "idx_fert", "idx_pest"), *rain_temp(i))


@query("feat_month_join", JOINED, USES)
def feat_month_join(i: Inputs):
    return joined(i)


def lerp(c, part=""):
    back = f"OVER ({part} ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = f"OVER ({part} ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    v0, p0 = f"last_value({c} IGNORE NULLS) {back}", f"last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {back}"
    v1, p1 = f"first_value({c} IGNORE NULLS) {ahead}", f"first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {ahead}"
    return f"coalesce({c}, {v0} + ({v1} - {v0}) * (pos - {p0}) / ({p1} - {p0}), {v0}, {v1}) AS {c}"


FILLED = f"""SELECT month, idx_total, idx_fert, idx_pest, {lerp('rain_mm')}, {lerp('temp_c')}
FROM (SELECT *, row_number() OVER (ORDER BY month) AS pos FROM ({JOINED}) j) k"""


@query("feat_interpolate", FILLED, USES)
def feat_interpolate(i: Inputs):
    return f.interpolate(joined(i), ["rain_mm", "temp_c"])


@query("feat_fill_normal", f"SELECT month, coalesce(rain_mm, 150) AS rain_mm, coalesce(temp_c, 22) AS temp_c FROM ({JOINED}) j", USES)
def feat_fill_normal(i: Inputs):
    return f.fill_normal(joined(i)).select("month", "rain_mm", "temp_c")


@query("feat_anomaly_delta", f"""SELECT month, rain_mm AS ideam_precipitacion_mm, rain_mm - 150 AS ideam_precipitacion_anomalia,
 temp_c AS ideam_temperatura_c, temp_c - 22 AS ideam_temperatura_anomalia FROM ({FILLED}) j""", USES)
def feat_anomaly_delta(i: Inputs):
    df = f.deltas(f.interpolate(joined(i), ["rain_mm", "temp_c"]), rounding=False)
    return df.select("month", *[c for c in df.columns if c.startswith("ideam")])


@query("feat_calendar", "SELECT month, CAST(month(month) AS INTEGER) AS mes, CAST(year(month) AS INTEGER) AS anio FROM b_index", "b_index")
def feat_calendar(i: Inputs):
    return f.calendar(i("b_index").select("month"))


MATRIX = f"""SELECT month AS fecha, idx_total AS upra_indice_total, {CHANGE} AS upra_var_mensual_pct,
 idx_fert AS upra_fertilizantes, idx_pest AS upra_plaguicidas, coalesce(rain_mm, 150) AS ideam_precipitacion_mm,
 coalesce(rain_mm, 150) - 150 AS ideam_precipitacion_anomalia, coalesce(temp_c, 22) AS ideam_temperatura_c,
 coalesce(temp_c, 22) - 22 AS ideam_temperatura_anomalia, CAST(month(month) AS INTEGER) AS mes, CAST(year(month) AS INTEGER) AS anio
FROM ({FILLED}) j WHERE idx_total IS NOT NULL"""


def matrix(i: Inputs):
    return f.matrix(i("b_index").select("month", "idx_total", "idx_fert", "idx_pest"), *rain_temp(i), rounding=False)


@query("feat_matrix", MATRIX, USES)
def feat_matrix(i: Inputs):
    return matrix(i)


def score_sql(source, low=None, high=None, keep="*"):
    """Score of the rows of ``source`` (a table or parenthesised select)."""
    lo = low if low is not None else f"(SELECT min(upra_indice_total) FROM {source} z)"
    hi = high if high is not None else f"(SELECT max(upra_indice_total) FROM {source} z)"
    return f"""SELECT *, greatest(0, least(100, price_part + climate_part + calendar_part)) AS score FROM (SELECT {keep},
 (0.55 * CASE WHEN {hi} > {lo} THEN (upra_indice_total - {lo}) / ({hi} - {lo}) ELSE 0.5 END
  + 0.45 * (greatest(-5, least(10, upra_var_mensual_pct)) + 5) / 15) * 100 * 0.40 AS price_part,
 (0.65 * least(1, greatest(0, least(1, greatest(0, -ideam_precipitacion_anomalia / 120)))
              + least(0.4, greatest(0, ideam_precipitacion_anomalia / 250) * 0.4))
  + 0.35 * least(1, greatest(0, ideam_temperatura_anomalia / 2.5))) * 100 * 0.35 AS climate_part,
 least(100, CASE WHEN mes IN (9, 10, 11) THEN 22 ELSE 0 END
  + CASE WHEN anio IN (2022, 2023) THEN 28 WHEN anio IN (2024, 2025) THEN 12 ELSE 0 END) * 0.25 AS calendar_part
 FROM {source} w) v"""


LABEL = "CASE WHEN score >= 42 THEN 'ALTA' WHEN score >= 25 THEN 'MEDIA' ELSE 'BAJA' END"
CLASS = "CASE WHEN score >= 42 THEN 2 WHEN score >= 25 THEN 1 ELSE 0 END"
SCORED = score_sql(f"({MATRIX})")
SITE_SCORED = score_sql("b_site_month")


@query("feat_scenario_row", """SELECT month AS fecha, CAST(idx_total AS DOUBLE) AS upra_indice_total, rain_mm AS precipitacion_mm, temp_c AS temperatura_c,
 rain_mm AS ideam_precipitacion_mm, rain_mm - 150 AS ideam_precipitacion_anomalia, temp_c AS ideam_temperatura_c,
 temp_c - 22 AS ideam_temperatura_anomalia, CAST(month(month) AS INTEGER) AS mes, CAST(year(month) AS INTEGER) AS anio
FROM b_index JOIN b_climate_month USING (month)""", USES)
def feat_scenario_row(i: Inputs):
    inputs = i("b_index").join(i("b_climate_month"), "month").select(
        F.col("month").alias("fecha"), F.col("idx_total").alias("upra_indice_total"),
        F.col("rain_mm").alias("precipitacion_mm"), F.col("temp_c").alias("temperatura_c"))
    return f.scenario_rows(inputs, rounding=False)


@query("feat_latest_inputs", """WITH t AS (SELECT * FROM b_index ORDER BY month DESC LIMIT 2),
 r AS (SELECT * FROM b_sensor WHERE obs_date >= (SELECT max(obs_date) FROM b_sensor) - INTERVAL 30 DAY)
SELECT max(month) AS fecha, arg_max(idx_total, month) AS upra_indice_total,
 (arg_max(idx_total, month) - arg_min(idx_total, month)) / arg_min(idx_total, month) * 100 AS upra_var_mensual_pct,
 coalesce((SELECT idx_fert FROM t ORDER BY month DESC LIMIT 1), 0) AS upra_fertilizantes,
 coalesce((SELECT idx_pest FROM t ORDER BY month DESC LIMIT 1), 0) AS upra_plaguicidas,
 (SELECT avg(value) FROM r WHERE variable = 'precipitacion_mm') AS precipitacion_mm,
 (SELECT avg(value) FROM r WHERE variable = 'temperatura_c') AS temperatura_c FROM t""", "b_index b_sensor")
def feat_latest_inputs(i: Inputs):
    return f.latest_inputs(i("b_index"), i("b_sensor"), digits=None)


@query("score_minmax", """SELECT row_id, (upra_indice_total - min(upra_indice_total) OVER ()) /
 (max(upra_indice_total) OVER () - min(upra_indice_total) OVER ()) AS position FROM b_site_month""", "b_site_month")
def score_minmax(i: Inputs):
    return s.minmax(i("b_site_month"), "upra_indice_total", "position").select("row_id", "position")


@query("score_clip_components", f"SELECT row_id, price_part, climate_part, calendar_part FROM ({SITE_SCORED}) q", "b_site_month")
def score_clip_components(i: Inputs):
    return s.components(i("b_site_month")).select("row_id", "price_part", "climate_part", "calendar_part")


@query("score_index", f"SELECT row_id, score FROM ({SITE_SCORED}) q", "b_site_month")
def score_index(i: Inputs):
    return s.score(i("b_site_month"), digits=None).select("row_id", "score")


@query("score_label", f"""SELECT fecha, upra_indice_total, ideam_precipitacion_mm, score, {CLASS} AS class_id, {LABEL} AS label,
 CASE WHEN score >= 42 THEN '#C0392B' WHEN score >= 25 THEN '#F2A541' ELSE '#3FA796' END AS color FROM ({SCORED}) q""", USES)
def score_label(i: Inputs):
    return s.labelled(s.score(matrix(i), digits=None)).select(
        "fecha", "upra_indice_total", "ideam_precipitacion_mm", "score", "class_id", "label", "color").orderBy("fecha")


@query("score_class_distribution", f"""WITH c AS (SELECT {LABEL} AS label, count(*) AS rows FROM ({SITE_SCORED}) q GROUP BY 1)
SELECT label, rows, (SELECT min(rows) FROM c) AS smallest FROM c""", "b_site_month")
def score_class_distribution(i: Inputs):
    return s.class_distribution(s.labelled(s.score(i("b_site_month"), digits=None)))


@query("score_interpretation", f"""SELECT fecha, concat_ws(' ',
 CASE label WHEN 'ALTA' THEN 'Vulnerabilidad ALTA.' WHEN 'MEDIA' THEN 'Vulnerabilidad MEDIA, conviene vigilar.' ELSE 'Vulnerabilidad BAJA, situación estable.' END,
 CASE WHEN label = 'ALTA' AND upra_var_mensual_pct > 2 THEN printf('Insumos al alza: %.1f%% en el mes.', upra_var_mensual_pct) END,
 CASE WHEN label = 'ALTA' AND ideam_precipitacion_mm < 90 THEN 'Llueve menos de lo normal.' END,
 CASE WHEN label = 'ALTA' AND ideam_temperatura_c > 24 THEN printf('Más calor que el promedio: %.1f °C.', ideam_temperatura_c) END,
 CASE WHEN label = 'MEDIA' AND upra_var_mensual_pct > 1 THEN printf('Precios en subida: %.1f%%.', upra_var_mensual_pct) END,
 CASE WHEN label = 'MEDIA' AND upra_var_mensual_pct < -1 THEN printf('Precios en bajada: %.1f%%.', upra_var_mensual_pct) END) AS reading
FROM (SELECT *, {LABEL} AS label FROM ({SCORED}) q) l""", USES)
def score_interpretation(i: Inputs):
    return s.interpretation(s.labelled(s.score(matrix(i), digits=None))).select("fecha", "reading")
