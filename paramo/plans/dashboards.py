"""Registered queries: dashboard aggregates (D)."""

from pyspark.sql import functions as F

from paramo.operators import aggregates as a
from paramo.operators import query as q
from paramo.plans.catalog import Inputs, query
from paramo.plans.reads import RECENT, SUMMARY_SQL, USES, summary


@query("agg_traffic_by_category", "SELECT category, CAST(sum(traffic) AS BIGINT) AS total FROM b_toll GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8", "b_toll")
def agg_traffic_by_category(i: Inputs):
    return a.top_sum(i("b_toll"), "category", "traffic", 8)


@query("agg_top_sites", "SELECT site, CAST(sum(traffic) AS BIGINT) AS total, min(region) AS region FROM b_toll GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", "b_toll")
def agg_top_sites(i: Inputs):
    return a.top_sum(i("b_toll"), "site", "traffic", 5, also={"region": F.min("region")})


@query("agg_traffic_kpis", """
SELECT CAST(sum(traffic) AS BIGINT) AS traffic, CAST(sum(evaders) AS BIGINT) AS evaders, count(DISTINCT site) AS sites,
 CASE WHEN sum(traffic) > 0 THEN sum(evaders) / sum(traffic) * 100 ELSE 0 END AS evasion_pct FROM b_toll""", "b_toll")
def agg_traffic_kpis(i: Inputs):
    return a.traffic_kpis(i("b_toll"))


EVASION = """SELECT CAST(sum(traffic) AS BIGINT) AS traffic, CAST(sum(evaders) AS BIGINT) AS evaders, count(*) AS periods,
 sum(evaders) / {d} * 100 AS evasion_pct FROM b_toll WHERE lower(region) LIKE '%nation_1%'"""


@query("agg_evasion_filtered", EVASION.format(d="sum(traffic)"), "b_toll")
def agg_evasion_filtered(i: Inputs):
    return a.evasion(i("b_toll"), "nation_1", digits=None)


@query("agg_evasion_alt_rate", EVASION.format(d="(sum(traffic) + sum(evaders))"), "b_toll")
def agg_evasion_alt_rate(i: Inputs):
    return a.evasion(i("b_toll"), "nation_1", denominator="all", digits=None)


CLIMATE_WINDOW = f"""SELECT variable, avg(value) AS mean, max(value) AS top, count(*) AS n FROM b_sensor
WHERE {RECENT.format(d=7)} AND lower(region) LIKE '%nation%' GROUP BY 1"""


@query("agg_climate_window", CLIMATE_WINDOW, "b_sensor")
def agg_climate_window(i: Inputs):
    return a.climate_window(i("b_sensor"), 7, "NATION")


@query("agg_region_pivot", """SELECT region, avg(value) FILTER (WHERE variable = 'precipitacion_mm') AS rain,
 avg(value) FILTER (WHERE variable = 'temperatura_c') AS temp FROM b_sensor GROUP BY 1 ORDER BY coalesce(rain, 0) DESC, region LIMIT 8""", "b_sensor")
def agg_region_pivot(i: Inputs):
    return a.region_pivot(i("b_sensor"))


@query("agg_climate_kpis", """SELECT avg(value) FILTER (WHERE variable = 'precipitacion_mm') AS mean_rain,
 avg(value) FILTER (WHERE variable = 'temperatura_c') AS mean_temp, count(*) FILTER (WHERE variable = 'precipitacion_mm') AS n_rain,
 count(*) FILTER (WHERE variable = 'temperatura_c') AS n_temp, count(DISTINCT station) AS stations FROM b_sensor""", "b_sensor")
def agg_climate_kpis(i: Inputs):
    return a.climate_kpis(i("b_sensor"))


@query("agg_region_topn", "SELECT region, avg(value) AS mean FROM b_sensor WHERE variable = 'temperatura_c' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "b_sensor")
def agg_region_topn(i: Inputs):
    return a.region_top(i("b_sensor").where("variable = 'temperatura_c'"), digits=None)


@query("agg_regions_covered", f"SELECT count(DISTINCT region) AS regions, count(*) AS rows FROM b_sensor WHERE {RECENT.format(d=7)}", "b_sensor")
def agg_regions_covered(i: Inputs):
    return a.regions_covered(i("b_sensor"))


@query("agg_urban_rural_gap", """WITH m AS (SELECT avg(coalesce(pct_internet, 0)) FILTER (WHERE zone = 'urbana') AS urban,
 avg(coalesce(pct_internet, 0)) FILTER (WHERE zone = 'rural') AS rural FROM b_connect)
SELECT urban, rural, urban - rural AS gap, urban - rural > 25 AS warn FROM m""", "b_connect")
def agg_urban_rural_gap(i: Inputs):
    return a.zone_gap(i("b_connect"))


@query("agg_coverage_by_level", """SELECT l.level, coalesce(avg(e.net_rate), 0) AS mean_net_rate
FROM (VALUES ('preescolar'), ('primaria'), ('secundaria'), ('media')) AS l(level) LEFT JOIN b_edu e ON e.level = l.level GROUP BY 1""", "b_edu")
def agg_coverage_by_level(i: Inputs):
    return a.coverage_by_level(i("b_edu"))


_LEVELS = ("preescolar", "primaria", "secundaria", "media")


@query("agg_pivot_levels", "WITH l AS (SELECT *, row_number() OVER (PARTITION BY place, year, level ORDER BY row_id DESC) AS rn FROM b_edu)\nSELECT place, year, "
       + ", ".join(f"max({v}) FILTER (WHERE level = '{lv}') AS {lv}_{v}" for lv in _LEVELS for v in ("net_rate", "dropout_rate"))
       + ", bool_or(dropout_rate > 6) AS high_dropout FROM l WHERE rn = 1 GROUP BY 1, 2", "b_edu")
def agg_pivot_levels(i: Inputs):
    return a.pivot_levels(i("b_edu"))


@query("agg_severity_counts", """SELECT CASE WHEN s < -0.2 THEN 'ALTA' WHEN s < -0.1 THEN 'MEDIA' ELSE 'BAJA' END AS band, count(*) AS rows
FROM (SELECT -(CAST(evaders AS DOUBLE) / traffic * 3) AS s FROM b_toll) x GROUP BY 1""", "b_toll")
def agg_severity_counts(i: Inputs):
    scored = i("b_toll").select((-(F.col("evaders").cast("double") / F.col("traffic") * 3)).alias("s"))
    return a.banded(scored, a.severity("s"))


@query("agg_twelve_month_change", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY month DESC) AS rn FROM b_multi_series)
SELECT n.series_key, n.month AS last, n.y AS now, p.y AS past, (n.y - p.y) / p.y * 100 AS change_pct
FROM r n LEFT JOIN r p ON p.series_key = n.series_key AND p.rn = 13 WHERE n.rn = 1""", "b_multi_series")
def agg_twelve_month_change(i: Inputs):
    return a.change_over(i("b_multi_series"), 12, "y", by=["series_key"], digits=None)


@query("agg_last_n_periods", "SELECT month, idx_total FROM b_index ORDER BY month DESC LIMIT 24", "b_index")
def agg_last_n_periods(i: Inputs):
    return a.last_periods(i("b_index").select("month", "idx_total"), 24)


SIX_MONTHS = """SELECT max(month) AS last, arg_min(idx_total, month) AS first_value, arg_max(idx_total, month) AS last_value,
 (SELECT idx_fert FROM b_index ORDER BY month DESC LIMIT 1) AS idx_fert, (SELECT idx_pest FROM b_index ORDER BY month DESC LIMIT 1) AS idx_pest,
 (arg_max(idx_total, month) - arg_min(idx_total, month)) / arg_min(idx_total, month) * 100 AS change_pct
FROM (SELECT * FROM b_index ORDER BY month DESC LIMIT 6) x"""


@query("agg_six_month_change", SIX_MONTHS, "b_index")
def agg_six_month_change(i: Inputs):

    return a.recent_change(i("b_index"), digits=None)


@query("agg_movement_label", """SELECT month, CASE WHEN c > 0.5 THEN 'sube' WHEN c < -0.5 THEN 'baja' ELSE 'estable' END AS movement
FROM (SELECT month, (idx_total - lag(idx_total) OVER (ORDER BY month)) / lag(idx_total) OVER (ORDER BY month) * 100 AS c FROM b_index) x""", "b_index")
def agg_movement_label(i: Inputs):
    return q.index_trend(i("b_index"), digits=None).select("month", a.movement("change_pct").alias("movement"))


@query("agg_coverage_band", """SELECT CASE WHEN pct_internet >= 65 THEN 'alta' WHEN pct_internet >= 40 THEN 'media' ELSE 'baja' END AS band,
 count(*) AS rows FROM b_connect GROUP BY 1""", "b_connect")
def agg_coverage_band(i: Inputs):
    return a.banded(i("b_connect"), a.coverage_band("pct_internet"))


@query("agg_price_band", """SELECT CASE WHEN p > 130 THEN 'critico' WHEN p > 110 THEN 'alto' WHEN p >= 95 THEN 'normal' ELSE 'bajo' END AS band,
 count(*) AS rows FROM (SELECT o_totalprice / 2500 AS p FROM orders) x GROUP BY 1""")
def agg_price_band(i: Inputs):
    return a.banded(i("orders").select((F.col("o_totalprice") / 2500).alias("p")), a.price_band("p"))


@query("agg_active_sources", f"SELECT table_name, rows, rows > 0 AS ok FROM ({SUMMARY_SQL}) s", USES)
def agg_active_sources(i: Inputs):
    return q.active_sources(summary(i))
