"""Abstract inputs bound to the star-schema tables.

Each binding is one SQL text.  Spark runs it over the table views; the oracle SQL carries
the same text as a CTE, so both engines start from equal input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

BINDINGS: dict[str, str] = {}

# site x category x month facts
BINDINGS["b_toll"] = """
SELECT l.l_suppkey AS site_id, s.s_name AS site, n.n_name AS region, l.l_returnflag AS category,
       CAST(date_trunc('month', l.l_shipdate) + INTERVAL '23' YEAR AS DATE) AS month,
       CAST(sum(CAST(l.l_quantity AS BIGINT)) AS BIGINT) AS traffic,
       CAST(sum(CAST(floor(l.l_quantity * l.l_discount) AS BIGINT)) AS BIGINT) AS evaders,
       CAST(sum(CAST(floor(l.l_quantity * l.l_tax) AS BIGINT)) AS BIGINT) AS exempt,
       avg(l.l_extendedprice) AS fare
FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey
     JOIN nation n ON n.n_nationkey = s.s_nationkey
GROUP BY 1, 2, 3, 4, 5"""

# monthly price index with three sub-indices
BINDINGS["b_index"] = """
SELECT CAST(date_trunc('month', o_orderdate) + INTERVAL '23' YEAR AS DATE) AS month,
       avg(o_totalprice) / 2500 AS idx_total,
       avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / 2500 AS idx_fert,
       avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) / 2500 AS idx_pest,
       avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) / 2500 AS idx_other
FROM orders GROUP BY 1"""

# station observations
BINDINGS["b_sensor"] = """
SELECT e.event_id AS obs_id, e.user_id AS station, n.n_name AS region, e.ts,
       CAST(e.ts AS DATE) AS obs_date,
       CASE e.event_type WHEN 'view' THEN 'precipitacion_mm' WHEN 'click' THEN 'temperatura_c' WHEN 'purchase' THEN 'humedad_pct'
            WHEN 'signup' THEN 'viento_ms' ELSE 'presion_hpa' END AS variable,
       e.value
FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 25"""

# monthly climate
BINDINGS["b_climate_all"] = """
SELECT CAST(date_trunc('month', l_shipdate) + INTERVAL '23' YEAR AS DATE) AS month,
       avg(l_quantity) * 6 AS rain_mm,
       22 + (avg(l_discount) - CAST(0.05 AS DOUBLE)) * 100 AS temp_c
FROM lineitem GROUP BY 1"""

# the same with every seventh month missing, for the operators that fill gaps
BINDINGS["b_climate_month"] = """
SELECT CAST(date_trunc('month', l_shipdate) + INTERVAL '23' YEAR AS DATE) AS month,
       avg(l_quantity) * 6 AS rain_mm,
       22 + (avg(l_discount) - CAST(0.05 AS DOUBLE)) * 100 AS temp_c
FROM lineitem
WHERE (extract(YEAR FROM l_shipdate) * 12 + extract(MONTH FROM l_shipdate)) % 7 <> 0
GROUP BY 1"""

# place x zone coverage
BINDINGS["b_connect"] = """
SELECT c.c_custkey AS row_id, n.n_name AS region, c.c_nationkey AS place_id, c.c_name AS place,
       2015 + c.c_custkey % 8 AS year,
       CASE WHEN c.c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'urbana' ELSE 'rural' END AS zone,
       greatest(CAST(0.0 AS DOUBLE), least(CAST(100.0 AS DOUBLE), c.c_acctbal / 100)) AS pct_internet
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey"""

# place x level rates
BINDINGS["b_edu"] = """
SELECT p_partkey AS row_id, p_brand AS place, concat('R', CAST(p_partkey % 25 AS STRING)) AS region,
       2015 + p_partkey % 8 AS year,
       CASE p_size % 4 WHEN 0 THEN 'preescolar' WHEN 1 THEN 'primaria' WHEN 2 THEN 'secundaria' ELSE 'media' END AS level,
       p_size AS enrolled,
       p_retailprice % 100 AS net_rate, CAST(p_size AS DOUBLE) / 5 AS dropout_rate
FROM part"""

# one monthly series per region
BINDINGS["b_multi_series"] = """
SELECT n.n_name AS series_key,
       CAST(date_trunc('month', o.o_orderdate) + INTERVAL '23' YEAR AS DATE) AS month,
       sum(o.o_totalprice) AS y
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
GROUP BY 1, 2"""

# region x month matrix under the feature names: traffic as the price proxy, climate of the region's sites
BINDINGS["b_region_month"] = """
SELECT CAST(key * 1000 + (year(month) - 2018) * 12 + month(month) AS BIGINT) AS row_id, r.*
FROM (SELECT n.n_nationkey AS key, n.n_name AS region,
       CAST(date_trunc('month', l.l_shipdate) + INTERVAL '23' YEAR AS DATE) AS month,
       sum(l.l_quantity) AS upra_indice_total,
       avg(l.l_tax) * 100 AS upra_var_mensual_pct,
       avg(l.l_extendedprice) / 100 AS upra_fertilizantes,
       sum(CASE WHEN l.l_returnflag = 'R' THEN l.l_quantity ELSE 0 END) AS upra_plaguicidas,
       avg(l.l_quantity) * 6 AS ideam_precipitacion_mm,
       avg(l.l_quantity) * 6 - 150 AS ideam_precipitacion_anomalia,
       22 + (avg(l.l_discount) - CAST(0.05 AS DOUBLE)) * 100 AS ideam_temperatura_c,
       (avg(l.l_discount) - CAST(0.05 AS DOUBLE)) * 100 AS ideam_temperatura_anomalia
FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey
GROUP BY 1, 2, 3) r"""

# site x month rows for supervised learning: change per site, national climate of the month
BINDINGS["b_site_month"] = """
SELECT t.site_id, t.month, t.site_id * 1000 + (year(t.month) - 2018) * 12 + month(t.month) AS row_id,
       CAST(t.traffic AS DOUBLE) AS upra_indice_total,
       coalesce((t.traffic - lag(t.traffic) OVER (PARTITION BY t.site_id ORDER BY t.month)) * CAST(100.0 AS DOUBLE)
                / lag(t.traffic) OVER (PARTITION BY t.site_id ORDER BY t.month), CAST(0.0 AS DOUBLE)) AS upra_var_mensual_pct,
       t.fare / 100 AS upra_fertilizantes, CAST(t.evaders AS DOUBLE) AS upra_plaguicidas,
       coalesce(c.rain_mm, CAST(150.0 AS DOUBLE)) AS ideam_precipitacion_mm,
       coalesce(c.rain_mm, CAST(150.0 AS DOUBLE)) - 150 AS ideam_precipitacion_anomalia,
       coalesce(c.temp_c, CAST(22.0 AS DOUBLE)) AS ideam_temperatura_c,
       coalesce(c.temp_c, CAST(22.0 AS DOUBLE)) - 22 AS ideam_temperatura_anomalia,
       CAST(month(t.month) AS INT) AS mes, CAST(year(t.month) AS INT) AS anio
FROM (SELECT site_id, month, sum(traffic) AS traffic, sum(evaders) AS evaders, avg(fare) AS fare
      FROM b_toll GROUP BY site_id, month) t
LEFT JOIN b_climate_all c ON c.month = t.month"""

# --- raw feed records: all strings, with planted bad values --------------------------
BINDINGS["r_toll"] = """
SELECT CAST(l.l_suppkey AS STRING) AS idpeaje, p.name AS peaje, l.l_returnflag AS categoriatarifa,
       CASE WHEN l.l_orderkey % 11 = 0 THEN concat(substr(CAST(l.l_shipdate AS STRING), 1, 10), 'T00:00:00.000')
            WHEN l.l_orderkey % 11 = 1 THEN concat(substr(CAST(l.l_shipdate AS STRING), 1, 10), 'T00:00:00')
            WHEN l.l_orderkey % 97 = 2 THEN '2024-02-30' WHEN l.l_orderkey % 97 = 3 THEN '15/01/2024'
            WHEN l.l_orderkey % 97 = 4 THEN '' WHEN l.l_orderkey % 97 = 5 THEN '2024-1-5'
            ELSE substr(CAST(l.l_shipdate AS STRING), 1, 10) END AS desde,
       CASE WHEN l.l_orderkey % 53 = 0 THEN NULL ELSE substr(CAST(l.l_shipdate AS STRING), 1, 10) END AS hasta,
       CASE WHEN l.l_orderkey % 89 = 0 THEN 'abc' WHEN l.l_orderkey % 89 = 1 THEN ''
            WHEN l.l_orderkey % 89 = 2 THEN '1e3' ELSE CAST(CAST(floor(l.l_extendedprice) AS BIGINT) AS STRING) END AS valortarifa,
       CASE WHEN l.l_orderkey % 83 = 0 THEN '3.9' WHEN l.l_orderkey % 83 = 1 THEN '5d'
            WHEN l.l_orderkey % 83 = 2 THEN ' 7 ' WHEN l.l_orderkey % 83 = 3 THEN NULL
            ELSE CAST(CAST(l.l_quantity AS BIGINT) AS STRING) END AS cantidadtrafico,
       CAST(l.l_linenumber AS STRING) AS cantidadevasores, '0' AS cantidadexentos787,
       l.l_orderkey AS src_order, l.l_linenumber AS src_line
FROM lineitem l JOIN (VALUES (0, 'La Ye'), (1, ' MARINILLA '), (2, 'Fontibón'), (3, 'Siberia'), (4, 'Río Grande'),
                             (5, 'Peaje sin ficha'), (6, 'chia'), (7, CAST(NULL AS STRING))) AS p(k, name)
     ON p.k = l.l_suppkey % 8"""

BINDINGS["r_index"] = """
SELECT concat(substr(CAST(o_orderdate AS STRING), 1, 10), 'T00:00:00.000') AS fecha,
       CASE WHEN o_orderkey % 41 = 0 THEN 'n/d' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS indice_total,
       CASE WHEN o_orderstatus = 'F' THEN '101.5' END AS total_fertilizantes,
       CASE WHEN o_orderstatus = 'O' THEN '-0.25' ELSE '' END AS total_plaguicidas,
       '7' AS total_otros, o_orderkey AS src_order
FROM orders"""

# fields named *_alt are the CamelCase spelling some records carry instead
BINDINGS["r_climate"] = """
SELECT CASE WHEN e.event_id % 2 = 0 THEN p.name END AS municipio,
       CASE WHEN e.event_id % 2 = 1 THEN p.name END AS municipio_alt,
       CASE WHEN e.event_id % 2 = 0 THEN n.n_name ELSE '' END AS departamento, n.n_name AS departamento_alt,
       CASE WHEN e.event_id % 3 = 0 THEN '4.5' END AS latitud, '-74.25' AS longitud_alt,
       concat(substr(CAST(e.ts AS STRING), 1, 10), 'T', substr(CAST(e.ts AS STRING), 12, 8)) AS fechaobservacion,
       CAST(e.user_id AS STRING) AS codigoestacion_alt, CAST(e.user_id % 7 AS STRING) AS codigosensor,
       CASE e.event_type WHEN 'view' THEN 'precipitacion_mm' WHEN 'click' THEN 'temperatura_c' WHEN 'purchase' THEN 'humedad_pct'
            WHEN 'signup' THEN 'viento_ms' ELSE 'presion_hpa' END AS tipo_variable,
       CASE WHEN e.event_id % 50 = 0 THEN 'nan?' ELSE CAST(CAST(floor(e.value) AS BIGINT) AS STRING) END AS valorobservado_alt,
       'u' AS unidadmedida, CAST(e.event_id AS STRING) AS src_id
FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 25
     JOIN (VALUES (0, 'Medellín'), (1, ' BOGOTÁ '), (2, 'Cali'), (3, 'Pueblo nuevo'), (4, 'QUIBDÓ'),
                  (5, CAST(NULL AS STRING)), (6, '')) AS p(k, name) ON p.k = e.user_id % 7"""

BINDINGS["r_connect"] = """
SELECT CASE WHEN c_custkey % 2 = 0 THEN concat(' Region ', CAST(c_nationkey AS STRING)) END AS departamento,
       concat('Region ', CAST(c_nationkey AS STRING)) AS nombre_departamento,
       CASE WHEN c_custkey % 29 = 0 THEN ' ' ELSE c_name END AS municipio,
       CASE WHEN c_custkey % 3 = 0 THEN CAST(10000 + c_custkey AS STRING) END AS codigo_dane,
       CASE WHEN c_custkey % 3 = 1 THEN CAST(10000 + c_custkey AS STRING) END AS cod_dane,
       CASE WHEN c_custkey % 31 = 0 THEN '0' WHEN c_custkey % 37 = 0 THEN 'x'
            ELSE CAST(CAST(floor(abs(c_acctbal) / 100) AS BIGINT) AS STRING) END AS indice_penetracion,
       '0' AS latitud, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '55.5' END AS pct_celular,
       CASE WHEN c_custkey % 7 <> 0 THEN 'fibra' END AS tipo_conexion, '12' AS velocidad_promedio,
       CASE WHEN c_custkey % 4 = 0 THEN '1200' END AS poblacion,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'urbana' WHEN c_mktsegment = 'MACHINERY' THEN 'rural' END AS zona,
       c_custkey AS src_id
FROM customer"""

BINDINGS["r_edu"] = """
SELECT CASE WHEN p_partkey % 2 = 0 THEN CAST(20000 + p_partkey AS STRING) ELSE '' END AS codigo_dane_municipio,
       CASE WHEN p_partkey % 3 = 0 THEN CAST(30000 + p_partkey AS STRING) END AS cod_mpio,
       p_type AS departamento, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE concat(p_brand, ' ') END AS municipio,
       CASE WHEN p_partkey % 5 = 0 THEN ' MEDIA' WHEN p_partkey % 5 = 1 THEN 'Primaria' END AS nivel,
       CASE WHEN p_partkey % 5 = 2 THEN 'Secundaria' END AS nivel_educativo,
       CAST(p_size AS STRING) AS total_matriculados, '10' AS matriculados_oficial, '0' AS matriculados_no_oficial,
       CAST(CAST(floor(p_retailprice) AS BIGINT) % 100 AS STRING) AS tasa_cobertura_neta,
       CASE WHEN p_partkey % 13 = 0 THEN 'mal' ELSE '4.5' END AS tasa_desercion, p_partkey AS src_id
FROM part"""

# place dimension and messages
BINDINGS["b_place"] = """
SELECT n_nationkey AS place_id, n_name AS place,
       CASE n_nationkey % 6 WHEN 0 THEN 'Antioquia' WHEN 1 THEN 'Choco' WHEN 2 THEN 'Valle' WHEN 3 THEN 'Meta'
            WHEN 4 THEN 'Vaupes' ELSE NULL END AS region
FROM nation"""

BINDINGS["b_message"] = """
SELECT concat('c', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS msg_id, text
FROM conversations WHERE role = 'user'
UNION ALL
SELECT concat('q', CAST(c.c_custkey AS STRING)) AS msg_id,
       replace(q.text, '#', CAST(c.c_nationkey AS STRING)) AS text
FROM customer c JOIN (VALUES
  (0, '¿Cuántos vehículos pasaron por el peaje # de Antioquia?'), (1, 'Precio del fertilizante este mes #'),
  (2, '¿Hay LLUVIA o sequía en el Valle, zona #?'), (3, 'Estado de los datos, registros #'),
  (4, 'Necesito ayuda: ¿cómo se usa el asistente?'), (5, 'nivel de vulnerabilidad del territorio #'),
  (6, 'Detección de valores atípicos en Chocó'), (7, 'Pronóstico y tendencia para los próximos meses #'),
  (8, 'zzz qqq #'), (9, '')) AS q(k, text) ON q.k = c.c_custkey % 10"""

NEEDS = {"b_site_month": ["b_toll", "b_climate_all"]}


_FRAMES: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; the resolved plan is kept so that a session reads each footer once."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FRAMES:
        _FRAMES[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _FRAMES[key]


def binding(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The binding as a DataFrame, or the table itself for a plain table name."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = BINDINGS[name]
    for t in TABLES:
        if re.search(rf"(FROM|JOIN) {t}\b", text):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    for other in NEEDS.get(name, []):
        binding(spark, sf_dir, other).createOrReplaceTempView(other)
    return spark.sql(text)


def with_bindings(sql: str, *names: str) -> str:
    """Oracle text: the bindings as leading CTEs, then the given statement."""
    wanted: list[str] = []
    for name in names:
        for item in [*NEEDS.get(name, []), name]:
            if item not in wanted:
                wanted.append(item)
    ctes = ",\n".join(f"{n} AS ({BINDINGS[n]})" for n in wanted)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = ",\n" + body[len("WITH RECURSIVE" if recursive else "WITH"):]
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"
