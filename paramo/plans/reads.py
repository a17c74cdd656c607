"""Registered queries: filter and top-k reads (C)."""

from pyspark.sql import functions as F

from paramo.operators import normalise as n
from paramo.operators import query as q
from paramo.plans.catalog import Inputs, query
from paramo.plans.clean import TOLL_ORACLE


@query("q_tolls", """
SELECT * FROM b_toll WHERE month >= DATE '2019-03-01' AND month <= DATE '2023-06-01' AND lower(region) LIKE '%nation_1%'
ORDER BY month DESC, site_id, category LIMIT 100""", "b_toll")
def q_tolls(i: Inputs):
    return q.tolls(i("b_toll"), "2019-03-01", "2023-06-01", "Nation_1")


@query("q_tolls_by_code", "SELECT * FROM b_toll WHERE site_id = 3 ORDER BY month DESC, category LIMIT 50", "b_toll")
def q_tolls_by_code(i: Inputs):
    return q.by_code(i("b_toll"), 3, "site_id", "month", tiebreak=["category"])


@query("q_index_range", "SELECT * FROM b_index WHERE month BETWEEN DATE '2020-01-01' AND DATE '2022-12-01'", "b_index")
def q_index_range(i: Inputs):
    return q.index_range(i("b_index"), "2020-01-01", "2022-12-01")


TREND = """CASE WHEN idx_total <> 0 AND lag(idx_total) OVER (ORDER BY month) <> 0
  THEN (idx_total - lag(idx_total) OVER (ORDER BY month)) / lag(idx_total) OVER (ORDER BY month) * 100 END"""


@query("q_index_trend", f"SELECT month, idx_total, {TREND} AS change_pct FROM b_index", "b_index")
def q_index_trend(i: Inputs):
    return q.index_trend(i("b_index").select("month", "idx_total"), digits=None)


RECENT = "obs_date >= (SELECT max(obs_date) FROM b_sensor) - INTERVAL {d} DAY"


@query("q_climate_recent", f"""
SELECT * FROM b_sensor WHERE {RECENT.format(d=7)} AND variable = 'precipitacion_mm' AND lower(region) LIKE '%nation_2%'
ORDER BY obs_date DESC, obs_id LIMIT 200""", "b_sensor")
def q_climate_recent(i: Inputs):
    return q.climate_recent(i("b_sensor"), 7, "precipitacion_mm", "NATION_2")


@query("q_climate_by_code", f"""
SELECT * FROM b_sensor WHERE {RECENT.format(d=30)} AND station = 7 AND variable = 'temperatura_c'
ORDER BY obs_date DESC, obs_id LIMIT 500""", "b_sensor")
def q_climate_by_code(i: Inputs):
    return q.climate_recent(i("b_sensor"), 30, "temperatura_c", code=7, limit=500)


TABLES = {"tolls": ("b_toll", "month"), "index": ("b_index", "month"), "climate": ("b_sensor", "obs_date"),
          "connectivity": ("b_connect", None), "education": ("b_edu", None)}
SUMMARY_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows, {f'min({d})' if d else 'CAST(NULL AS DATE)'} AS first_date, "
    f"{f'max({d})' if d else 'CAST(NULL AS DATE)'} AS last_date FROM {b}" for t, (b, d) in TABLES.items())
USES = "b_toll b_index b_sensor b_connect b_edu"


def summary(i: Inputs):
    return q.table_summary({t: (i(b), d) for t, (b, d) in TABLES.items()})


@query("q_table_summary", f"""WITH s AS ({SUMMARY_SQL}) SELECT * FROM s
UNION ALL SELECT 'total', CAST(sum(rows) AS BIGINT), min(first_date), max(last_date) FROM s""", USES)
def q_table_summary(i: Inputs):
    return summary(i)


@query("q_connectivity", """
SELECT * FROM b_connect WHERE year = 2018 AND zone = 'rural' AND lower(region) LIKE '%nation%'
ORDER BY pct_internet DESC NULLS FIRST, row_id LIMIT 100""", "b_connect")
def q_connectivity(i: Inputs):
    return q.connectivity(i("b_connect"), "nation", 2018, "rural")


@query("q_education", """
SELECT * FROM b_edu WHERE level = 'media' AND region ILIKE '%r1%' ORDER BY region, place, row_id LIMIT 100""", "b_edu")
def q_education(i: Inputs):
    return q.education(i("b_edu"), "R1", "media")


@query("q_projection_shapes", """
SELECT site_id, site, category, strftime(month, '%Y-%m-%d') AS month, traffic, evaders FROM b_toll""", "b_toll")
def q_projection_shapes(i: Inputs):
    return q.projection(i("b_toll"), ["site_id", "site", "category", "month", "traffic", "evaders"], ["month"])


@query("q_health_warnings", f"""WITH s AS ({SUMMARY_SQL} UNION ALL SELECT 'empty', count(*), NULL, NULL FROM b_edu WHERE row_id < 0)
SELECT CASE WHEN count(*) FILTER (WHERE rows = 0) > 0 THEN 'warning' ELSE 'ok' END AS status, CAST(sum(rows) AS BIGINT) AS rows,
 coalesce(string_agg(table_name || ' is empty', '; ' ORDER BY table_name) FILTER (WHERE rows = 0), '') AS warnings,
 max(last_date) AS last_date FROM s""", USES)
def q_health_warnings(i: Inputs):
    tables = {t: (i(b), d) for t, (b, d) in TABLES.items()}
    tables["empty"] = (i("b_edu").where("row_id < 0"), None)
    return q.health(q.table_summary(tables))


@query("q_distinct_filter_values", "SELECT DISTINCT coalesce(peaje, 'Sin dato') AS peaje FROM r_toll", "r_toll")
def q_distinct_filter_values(i: Inputs):
    return q.distinct_values(i("r_toll"), "peaje")


@query("q_text_search", """
SELECT * FROM b_connect WHERE zone = 'urbana' AND (lower(place) LIKE '%00012%' OR lower(region) LIKE '%00012%')""", "b_connect")
def q_text_search(i: Inputs):
    return q.text_search(i("b_connect"), "00012", ["place", "region"], zone="urbana")


@query("q_geo_points", f"SELECT * FROM ({TOLL_ORACLE}) x WHERE latitud IS NOT NULL AND longitud IS NOT NULL", "r_toll")
def q_geo_points(i: Inputs):
    return q.geo_points(n.tolls(n.enrich_sites(i("r_toll")), keep=["src_order", "src_line"]))
