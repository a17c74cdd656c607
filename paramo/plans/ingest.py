"""Registered queries: sources, loads and reference rates (A)."""

from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo import schemas
from paramo.operators import features as f
from paramo.operators import normalise as n
from paramo.plans.catalog import Inputs, query
from paramo.plans.clean import TOLL_ORACLE, sql_values
from paramo.plans.features import NORMALS
from paramo.session import shared_path
from paramo.sources import feeds, loading, reference_rates

RAW_FIELDS = ["idpeaje", "peaje", "categoriatarifa", "desde", "hasta", "valortarifa", "cantidadtrafico",
              "cantidadevasores", "cantidadexentos787", "src_order", "src_line"]


@query("src_landed_json", f"""SELECT {', '.join(RAW_FIELDS[:9])}, CAST(src_order AS VARCHAR) AS src_order,
 CAST(src_line AS VARCHAR) AS src_line FROM r_toll WHERE src_order % 1009 <> 0""", "r_toll")
def src_landed_json(i: Inputs):
    path = shared_path(i.spark, "landed")
    text = F.to_json(F.struct(*RAW_FIELDS))
    # every 1009th order is cut off in the middle, as a broken page would be
    line = F.when(F.col("src_order") % 1009 == 0, F.substring(text, 1, 20)).otherwise(text)
    i("r_toll").select(line.alias("value")).write.text(path)
    df = feeds.landed_json(i.spark, path, RAW_FIELDS)
    return df.where(F.col(feeds.CORRUPT).isNull()).drop(feeds.CORRUPT)


@query("src_pushdown_scan", """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_quantity < 10 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 500""")
def src_pushdown_scan(i: Inputs):
    return feeds.scan(i("lineitem"), "l_shipdate >= timestamp_ntz '1997-01-01' AND l_quantity < 10",
                      ["l_orderkey", "l_linenumber", "l_extendedprice"],
                      [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"], 500)


@query("src_since_date", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def src_since_date(i: Inputs):
    return feeds.since(i("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "2000-01-01").orderBy("o_orderdate")


@query("src_last_n_days", """SELECT event_id, user_id, value FROM events
WHERE ts >= (SELECT CAST(max(ts) AS DATE) FROM events) - INTERVAL 7 DAY""")
def src_last_n_days(i: Inputs):
    return feeds.last_days(i("events").select("event_id", "user_id", "value", "ts"), "ts", 7).drop("ts")


@query("src_union_discriminator", """SELECT event_id, value, CASE event_type WHEN 'view' THEN 'precipitacion_mm' WHEN 'click' THEN 'temperatura_c' ELSE event_type END AS variable
FROM events""")
def src_union_discriminator(i: Inputs):
    ev = i("events").select("event_id", "value", "event_type")
    kinds = {fv.RAIN: "view", fv.TEMP: "click"} | {k: k for k in ("purchase", "signup", "error")}
    return feeds.stacked({name: ev.where(F.col("event_type") == kind).drop("event_type") for name, kind in kinds.items()})


@query("src_count", "SELECT count(*) AS rows FROM lineitem WHERE l_discount >= 0.05")
def src_count(i: Inputs):
    return feeds.count(i("lineitem"), F.col("l_discount") >= 0.05)


@query("src_sample", "SELECT * FROM events ORDER BY event_id LIMIT 3")
def src_sample(i: Inputs):
    return feeds.first_rows(i("events"), ["event_id"])


@query("src_column_subset", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def src_column_subset(i: Inputs):
    return feeds.scan(i("orders"), select=["o_orderkey", "o_orderdate", "o_totalprice"])


@query("src_station_catalog", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def src_station_catalog(i: Inputs):
    stations = i("supplier").join(i("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return feeds.catalog(stations, ["s_suppkey", "s_name", "n_name"], "s_suppkey")


@query("src_page_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 150")
def src_page_offset(i: Inputs):
    return feeds.page(i("orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 3, 50)


def _rates_sql(table, names, default):
    values = sql_values((k, *v) for k, v in table.items() if k != fv.DEFAULT_REGION)
    cols = ", ".join(f"coalesce(r.{n}, {d}) AS {n}" for n, d in zip(names, default))
    return f"SELECT p.place_id, {cols} FROM b_place p LEFT JOIN (VALUES {values}) AS r(region, {', '.join(names)}) ON r.region = p.region"


CONNECT_RATES = f"""SELECT place_id, zone, CASE zone WHEN 'rural' THEN 'movil' ELSE 'mixta' END AS connection,
 least(100, internet * CASE zone WHEN 'rural' THEN 0.42 ELSE 1 END) AS pct_internet,
 least(100, mobile * CASE zone WHEN 'rural' THEN 0.8 ELSE 1 END) AS pct_mobile,
 least(100, computer * CASE zone WHEN 'rural' THEN 0.42 ELSE 1 END) AS pct_computer, 'DANE-MinTIC-SIMULADO' AS fuente
FROM ({_rates_sql(fv.CONNECTIVITY_RATES, ['internet', 'mobile', 'computer'], (40.0, 82.0, 18.0))}) x,
 (VALUES ('urbana'), ('rural')) AS z(zone)"""


@query("src_fallback_fill", f"""WITH real AS (SELECT place_id, zone, avg(pct_internet) AS pct_internet, 'MinTIC' AS fuente
  FROM b_connect WHERE place_id % 3 <> 0 GROUP BY 1, 2)
SELECT * FROM real UNION ALL SELECT place_id, zone, pct_internet, fuente FROM ({CONNECT_RATES}) f
WHERE NOT EXISTS (SELECT 1 FROM real r WHERE r.place_id = f.place_id AND r.zone = f.zone)""", "b_connect b_place")
def src_fallback_fill(i: Inputs):
    # every third place has no measurements
    real = (i("b_connect").where("place_id % 3 <> 0").groupBy("place_id", "zone")
            .agg(F.avg("pct_internet").alias("pct_internet")).withColumn("fuente", F.lit(fv.SOURCE_CONNECTIVITY)))
    fallback = reference_rates.connectivity(i("b_place")).select("place_id", "zone", "pct_internet", "fuente")
    return feeds.fill_from(real, fallback, ["place_id", "zone"])


KEY = ["idpeaje", "fecha_inicio", "categoria_tarifa"]
ORDER = ["src_order", "src_line"]


def conformed_tolls(i: Inputs):
    return n.tolls(n.enrich_sites(i("r_toll")), keep=ORDER)


# rows an insert-ignore of the whole feed keeps, with an earlier load of the oldest orders
LOADED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idpeaje, fecha_inicio, categoria_tarifa
  ORDER BY CASE WHEN fecha < DATE '1997-01-01' THEN 0 ELSE 1 END, src_order, src_line) AS rn FROM ({TOLL_ORACLE}) t) u
WHERE rn = 1 OR idpeaje IS NULL OR fecha_inicio IS NULL OR categoria_tarifa IS NULL"""


@query("sink_insert_ignore", f"SELECT idpeaje, fecha_inicio, categoria_tarifa, src_order, src_line, cantidad_trafico FROM ({LOADED}) x", "r_toll")
def sink_insert_ignore(i: Inputs):
    batch = conformed_tolls(i).select(*KEY, *ORDER, "fecha", "cantidad_trafico")
    path = shared_path(i.spark, "tolls")
    loading.first_per_key(batch.where("fecha < date '1997-01-01'"), KEY, ORDER).write.parquet(path)
    loading.insert_ignore(i.spark, path, batch, KEY, ORDER, prune_by="fecha_inicio")
    return i.spark.read.parquet(path).drop("fecha")


@query("sink_declare_table", f"""WITH t AS ({TOLL_ORACLE}), d AS (SELECT count(*) AS c FROM t WHERE fecha_inicio IS NOT NULL
  AND idpeaje IS NOT NULL AND categoria_tarifa IS NOT NULL GROUP BY idpeaje, fecha_inicio, categoria_tarifa)
SELECT 'missing' AS "check", 'sector' AS "column", count(*) FILTER (WHERE sector IS NULL) AS failures FROM t
UNION ALL SELECT 'missing', 'fuente', count(*) FILTER (WHERE fuente IS NULL) FROM t
UNION ALL SELECT 'too_long', 'codigo_dane', count(*) FILTER (WHERE length(codigo_dane) > 5) FROM t
UNION ALL SELECT 'too_long', 'departamento', count(*) FILTER (WHERE length(departamento) > 100) FROM t
UNION ALL SELECT 'too_long', 'municipio', count(*) FILTER (WHERE length(municipio) > 100) FROM t
UNION ALL SELECT 'too_long', 'idpeaje', count(*) FILTER (WHERE length(idpeaje) > 20) FROM t
UNION ALL SELECT 'too_long', 'peaje', count(*) FILTER (WHERE length(peaje) > 150) FROM t
UNION ALL SELECT 'too_long', 'categoria_tarifa', count(*) FILTER (WHERE length(categoria_tarifa) > 10) FROM t
UNION ALL SELECT 'duplicate_key', 'idpeaje,fecha_inicio,categoria_tarifa', CAST(sum(c - 1) AS BIGINT) FROM d""", "r_toll")
def sink_declare_table(i: Inputs):
    table = schemas.TABLES["tolls"]
    return loading.quality_report(loading.declare(conformed_tolls(i), table), table)


@query("sink_partitioned_stage", """SELECT site_id, category, month, traffic, 2020 AS year, CAST(month(month) AS INTEGER) AS month_no
FROM b_toll WHERE year(month) = 2020 AND month(month) IN (3, 4)""", "b_toll")
def sink_partitioned_stage(i: Inputs):
    root = shared_path(i.spark, "stages")
    path = loading.stage(i("b_toll").select("site_id", "category", "month", "traffic"), root, "processed", "tolls", "month")
    return i.spark.read.parquet(path).where("year = 2020 AND month_no IN (3, 4)")


@query("etl_run_summary", f"""SELECT 'tolls' AS feed, (SELECT count(*) FROM r_toll) AS extracted, (SELECT count(*) FROM ({LOADED}) x) AS loaded
UNION ALL SELECT 'index', (SELECT count(*) FROM r_index), (SELECT count(DISTINCT fecha) FROM r_index)""", "r_toll r_index")
def etl_run_summary(i: Inputs):
    index = n.price_index(i("r_index"), keep=["src_order"])
    return loading.run_summary({
        "tolls": (i("r_toll"), loading.first_per_key(conformed_tolls(i), KEY, ORDER)),
        "index": (i("r_index"), loading.first_per_key(index, ["fecha"], ["src_order"]))})


@query("etl_dry_run", f"SELECT * FROM ({TOLL_ORACLE}) x ORDER BY src_order, src_line LIMIT 3", "r_toll")
def etl_dry_run(i: Inputs):
    return loading.dry_run(conformed_tolls(i), ORDER)


FREE = """SELECT region, category, CAST(sum(traffic) AS BIGINT) AS traffic, count(*) AS rows FROM b_toll
WHERE month >= DATE '2020-01-01' GROUP BY region, category HAVING count(*) > 2"""


@query("sql_free_query", FREE, "b_toll")
def sql_free_query(i: Inputs):
    return loading.run_sql(i.spark, FREE, b_toll=i("b_toll"))


@query("ref_rates_connectivity", CONNECT_RATES, "b_place")
def ref_rates_connectivity(i: Inputs):
    return reference_rates.connectivity(i("b_place"))


@query("ref_rates_education", f"""SELECT place_id, level, net_rate, share, 'MEN-SIMAT-SIMULADO' AS fuente, CAST(floor(e.n * share) AS BIGINT) AS enrolled
FROM (SELECT place_id, unnest(['preescolar', 'primaria', 'secundaria', 'media']) AS level,
  unnest([preescolar, primaria, secundaria, media]) AS net_rate,
  unnest([0.12::DOUBLE, 0.45::DOUBLE, 0.28::DOUBLE, 0.15::DOUBLE]) AS share
  FROM ({_rates_sql(fv.EDUCATION_RATES, fv.EDUCATION_LEVELS, (48.0, 87.0, 68.0, 34.0))}) x) y
JOIN (SELECT c_nationkey AS nk, count(*) AS n FROM customer GROUP BY 1) e ON e.nk = y.place_id""", "b_place")
def ref_rates_education(i: Inputs):
    sizes = i("customer").groupBy(F.col("c_nationkey").alias("place_id")).agg(F.count("*").alias("enrolled"))
    return reference_rates.education(i("b_place").join(sizes, "place_id"), enrolled="enrolled")


@query("seasonal_normals", f"""WITH s AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM b_index)
SELECT 'precipitacion_mm' AS variable, s.month, p.rain * 150 AS value FROM s JOIN {NORMALS} ON p.m = month(s.month)
UNION ALL SELECT 'temperatura_c', s.month, p.temp * 22 FROM s JOIN {NORMALS} ON p.m = month(s.month)""", "b_index")
def seasonal_normals(i: Inputs):
    span = i("b_index").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    a, b = span.select("a").scalar(), span.select("b").scalar()
    return feeds.stacked({v: f.seasonal_normals(i.spark, a, b, v) for v in (fv.RAIN, fv.TEMP)})
