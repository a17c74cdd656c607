"""Registered queries: cleaning and conforming (B)."""

from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.functions import parsing as p
from paramo.operators import normalise as n
from paramo.plans.catalog import Inputs, query


def sql_values(rows) -> str:
    """Python rows -> SQL VALUES list."""
    def lit(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


CODES = f"(VALUES {sql_values(fv.MUNICIPALITY_CODES.items())}) AS d(place_key, code)"
SITES = f"(VALUES {sql_values((k, *v) for k, v in fv.TOLL_SITES.items())}) AS d(k, code, region, municipality, lat, lon)"


def num(c):
    return f"CASE WHEN regexp_matches(trim({c}), '{p.NUMBER_PATTERN}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def integer(c):
    return f"TRY_CAST(trunc({num(c)}) AS INTEGER)"


def day(c):
    return f"CAST(TRY_STRPTIME(nullif(regexp_extract({c}, '{p.DATE_PATTERN}', 1), ''), '%Y-%m-%d') AS DATE)"


def zero_null(c):
    return f"nullif({num(c)}, 0)"


TOLL_ORACLE = f"""
SELECT d.code AS codigo_dane, d.region AS departamento, d.municipality AS municipio, d.lat AS latitud, d.lon AS longitud,
  {day('desde')} AS fecha, 'transporte' AS sector, 'ANI' AS fuente, idpeaje, peaje, categoriatarifa AS categoria_tarifa,
  {day('desde')} AS fecha_inicio, {day('hasta')} AS fecha_fin, {num('valortarifa')} AS valor_tarifa,
  {integer('cantidadtrafico')} AS cantidad_trafico, {integer('cantidadevasores')} AS cantidad_evasores,
  {integer('cantidadexentos787')} AS cantidad_exentos, src_order, src_line
FROM r_toll LEFT JOIN {SITES} ON d.k = lower(trim(peaje))"""


@query("norm_tolls", TOLL_ORACLE, "r_toll")
def norm_tolls(i: Inputs):
    return n.tolls(n.enrich_sites(i("r_toll")), keep=["src_order", "src_line"])


@query("norm_index", f"""
SELECT '00' AS codigo_dane, 'Nacional' AS departamento, 'Colombia' AS municipio, CAST(4.5709 AS DOUBLE) AS latitud,
  CAST(-74.2973 AS DOUBLE) AS longitud, {day('fecha')} AS fecha, 'agropecuario' AS sector, 'UPRA' AS fuente,
  {num('indice_total')} AS indice_total, {num('total_fertilizantes')} AS total_fertilizantes,
  {num('total_plaguicidas')} AS total_plaguicidas, {num('total_otros')} AS total_otros, src_order
FROM r_index""", "r_index")
def norm_index(i: Inputs):
    return n.price_index(i("r_index"), keep=["src_order"])


def climate_records(i: Inputs):
    """r_climate rows as the MAP a landed JSON object parses to."""
    raw = i("r_climate")
    names = {c: n.CLIMATE_FIELDS[c[:-4]] if c.endswith("_alt") else c for c in raw.columns if c != "src_id"}
    parts = [x for c, name in names.items() for x in (F.lit(name), F.col(c))]
    return raw.select(F.map_filter(F.create_map(*parts), lambda k, v: v.isNotNull()).alias("record"), "src_id")


CLIMATE_ORACLE = f"""
SELECT d.code AS codigo_dane, departamento, municipio, latitud, longitud, fecha, 'climatico' AS sector, 'IDEAM' AS fuente,
  codigo_estacion, CAST(NULL AS VARCHAR) AS nombre_estacion, codigo_sensor, tipo_variable, valor_observado, unidad_medida,
  CAST(NULL AS VARCHAR) AS zona_hidrografica, src_id
FROM (SELECT coalesce(nullif(municipio, ''), nullif(municipio_alt, '')) AS municipio,
        coalesce(nullif(departamento, ''), nullif(departamento_alt, '')) AS departamento,
        {num('latitud')} AS latitud, {num('longitud_alt')} AS longitud, {day('fechaobservacion')} AS fecha,
        codigoestacion_alt AS codigo_estacion, codigosensor AS codigo_sensor, tipo_variable,
        {num('valorobservado_alt')} AS valor_observado, unidadmedida AS unidad_medida, src_id FROM r_climate) x
LEFT JOIN {CODES} ON d.place_key = lower(trim(municipio))"""


@query("norm_climate", CLIMATE_ORACLE, "r_climate")
def norm_climate(i: Inputs):
    return n.climate(climate_records(i), keep=["src_id"])


CONNECT_REASON = f"""CASE WHEN indice_penetracion <> '' AND ({num('indice_penetracion')}) IS NULL THEN 'unparsable'
  WHEN trim(coalesce(municipio, '')) = '' THEN 'no_name'
  WHEN coalesce({num('indice_penetracion')}, 0) = 0 THEN 'zero_value' END"""
EDU_REASON = f"""CASE WHEN tasa_desercion <> '' AND ({num('tasa_desercion')}) IS NULL THEN 'unparsable'
  WHEN coalesce(nullif(codigo_dane_municipio, ''), cod_mpio, '') = '' THEN 'no_code'
  WHEN trim(coalesce(municipio, '')) = '' THEN 'no_name' END"""


@query("norm_connectivity", f"""
SELECT coalesce(codigo_dane, cod_dane, '00000') AS codigo_dane, trim(coalesce(departamento, nombre_departamento)) AS departamento,
  trim(municipio) AS municipio, CAST(NULL AS DOUBLE) AS latitud, CAST(NULL AS DOUBLE) AS longitud, 2023 AS anio,
  DATE '2023-12-31' AS fecha, {num('indice_penetracion')} AS pct_hogares_internet,
  {zero_null('pct_celular')} AS pct_hogares_celular, CAST(NULL AS DOUBLE) AS pct_hogares_pc,
  coalesce(tipo_conexion, 'mixta') AS tipo_conexion, {zero_null('velocidad_promedio')} AS velocidad_mbps,
  {integer('poblacion')} AS poblacion, coalesce(zona, 'total') AS zona, 'tecnologia' AS sector, 'MinTIC' AS fuente, src_id
FROM r_connect WHERE {CONNECT_REASON} IS NULL""", "r_connect")
def norm_connectivity(i: Inputs):
    return n.connectivity(i("r_connect"), 2023, keep=["src_id"])


@query("norm_education", f"""
SELECT trim(coalesce(nullif(codigo_dane_municipio, ''), cod_mpio)) AS codigo_dane, trim(departamento) AS departamento,
  trim(municipio) AS municipio, CAST(NULL AS DOUBLE) AS latitud, CAST(NULL AS DOUBLE) AS longitud, 2022 AS anio,
  DATE '2022-12-31' AS fecha, lower(trim(coalesce(nivel, nivel_educativo, 'total'))) AS nivel_educativo,
  CAST(total_matriculados AS INTEGER) AS matriculados, CAST(matriculados_oficial AS INTEGER) AS matriculados_oficial,
  CAST(NULL AS INTEGER) AS matriculados_privado, CAST(tasa_cobertura_neta AS DOUBLE) AS tasa_cobertura_neta,
  CAST(NULL AS DOUBLE) AS tasa_cobertura_bruta, CAST(NULL AS DOUBLE) AS tasa_aprobacion,
  {zero_null('tasa_desercion')} AS tasa_desercion, 'total' AS zona, 'educacion' AS sector, 'MEN-SIMAT' AS fuente, src_id
FROM r_edu WHERE {EDU_REASON} IS NULL""", "r_edu")
def norm_education(i: Inputs):
    return n.education(i("r_edu"), 2022, keep=["src_id"])


@query("parse_date_safe", f"SELECT src_order, src_line, desde, {day('desde')} AS parsed FROM r_toll", "r_toll")
def parse_date_safe(i: Inputs):
    return i("r_toll").select("src_order", "src_line", "desde", p.to_date("desde").alias("parsed"))


@query("parse_float_safe", f"SELECT src_order, src_line, valortarifa, {num('valortarifa')} AS parsed FROM r_toll", "r_toll")
def parse_float_safe(i: Inputs):
    return i("r_toll").select("src_order", "src_line", "valortarifa", p.to_double("valortarifa").alias("parsed"))


@query("parse_int_safe", f"SELECT src_order, src_line, cantidadtrafico, {integer('cantidadtrafico')} AS parsed FROM r_toll", "r_toll")
def parse_int_safe(i: Inputs):
    return i("r_toll").select("src_order", "src_line", "cantidadtrafico", p.to_int("cantidadtrafico").alias("parsed"))


@query("lookup_code", f"""
SELECT tipo_variable, count(*) AS rows, count(*) FILTER (WHERE d.code IS NULL) AS unmatched, min(d.code) AS first_code
FROM (SELECT tipo_variable, coalesce(municipio, municipio_alt) AS m FROM r_climate) x
LEFT JOIN {CODES} ON d.place_key = lower(trim(m)) GROUP BY 1""", "r_climate")
def lookup_code(i: Inputs):
    named = i("r_climate").select("tipo_variable", F.coalesce("municipio", "municipio_alt").alias("m"))
    return n.lookup_code(named, "m").groupBy("tipo_variable").agg(
        F.count("*").alias("rows"), F.count_if(F.col("code").isNull()).alias("unmatched"),
        F.min("code").alias("first_code"))


@query("enrich_geo", f"""
SELECT src_order, src_line, peaje, d.code AS codigo_dane, d.region AS departamento, d.municipality AS municipio,
  d.lat AS latitud, d.lon AS longitud FROM r_toll LEFT JOIN {SITES} ON d.k = lower(trim(peaje))""", "r_toll")
def enrich_geo(i: Inputs):
    return n.enrich_sites(i("r_toll").select("src_order", "src_line", "peaje"))


@query("zero_blank_to_null", f"""
SELECT src_id, {zero_null('indice_penetracion')} AS pct, {zero_null('latitud')} AS lat, {zero_null('pct_celular')} AS mobile
FROM r_connect""", "r_connect")
def zero_blank_to_null(i: Inputs):
    return i("r_connect").select("src_id", p.zero_to_null("indice_penetracion").alias("pct"),
                                 p.zero_to_null("latitud").alias("lat"), p.zero_to_null("pct_celular").alias("mobile"))


@query("reject_split", f"""
SELECT 'connectivity' AS feed, coalesce({CONNECT_REASON}, 'ok') AS reason, count(*) AS rows FROM r_connect GROUP BY 1, 2
UNION ALL SELECT 'education', coalesce({EDU_REASON}, 'ok'), count(*) FROM r_edu GROUP BY 1, 2""", "r_connect r_edu")
def reject_split(i: Inputs):
    connect, edu = i("r_connect"), i("r_edu")
    a = n.reject_counts(connect, n.connectivity_reason(connect)).withColumn("feed", F.lit("connectivity"))
    b = n.reject_counts(edu, n.education_reason(edu)).withColumn("feed", F.lit("education"))
    return a.unionByName(b)


@query("plausible_range", """
SELECT obs_id, station, variable, value FROM b_sensor WHERE ts IS NOT NULL AND value IS NOT NULL
 AND ((variable = 'precipitacion_mm' AND value >= 0 AND value < 1000)
   OR (variable = 'temperatura_c' AND value > -5 AND value < 45))""", "b_sensor")
def plausible_range(i: Inputs):
    return n.plausible(i("b_sensor")).select("obs_id", "station", "variable", "value")


CLEAN_SQL = "trim(regexp_replace(regexp_replace(strip_accents(lower({c})), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("text_normalize", f"SELECT msg_id, {CLEAN_SQL.format(c='text')} AS clean FROM b_message", "b_message")
def text_normalize(i: Inputs):
    return i("b_message").select("msg_id", p.clean_text("text").alias("clean"))


@query("zero_null_default", """
SELECT region, coalesce(nullif(ev, 0), 0) AS evaders, coalesce(nullif(rain, 0), 150.0) AS rain FROM (
 SELECT t.region, CAST(sum(t.evaders) AS BIGINT) AS ev, avg(CASE WHEN t.category = 'R' THEN t.fare END) AS rain
 FROM b_toll t GROUP BY 1) x""", "b_toll")
def zero_null_default(i: Inputs):
    agg = i("b_toll").groupBy("region").agg(
        F.sum("evaders").alias("evaders"), F.avg(F.when(F.col("category") == "R", F.col("fare"))).alias("rain"))
    return n.fill_default(agg, {"evaders": 0, "rain": 150.0})
