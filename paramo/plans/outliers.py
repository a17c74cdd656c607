"""Registered queries: clustering (I) and anomalies (J)."""

from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.functions import neighbours as nb
from paramo.operators import anomaly as an
from paramo.operators import cluster as cl
from paramo.plans.catalog import Inputs, query

M = fv.MEASURES
SHORT = ["upra_var_mensual_pct", "ideam_precipitacion_mm", "ideam_temperatura_c"]


def z_sql(columns, source, keep="row_id"):
    parts = ", ".join(f"(coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / CASE WHEN stddev_pop(coalesce({c}, 0)) OVER () > 0 "
                      f"THEN stddev_pop(coalesce({c}, 0)) OVER () ELSE 1 END AS {c}" for c in columns)
    return f"SELECT {keep}, {parts} FROM {source}"


def dist_sql(columns, a="a", b="b"):
    return "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in columns) + ")"


STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, greatest(stddev_samp({c}), 1e-6) AS std, quantile_cont({c}, 0.05) AS p05, quantile_cont({c}, 0.95) AS p95 FROM b_site_month"
    for c in M)


@query("ano_feature_stats", STATS, "b_site_month")
def ano_feature_stats(i: Inputs):
    return an.feature_stats(i("b_site_month"))


ZMAX = f"greatest({', '.join(f'abs(z_{c})' for c in M)})"
Z = f"SELECT row_id, mes, anio, upra_indice_total, {', '.join(f'({c} - avg({c}) OVER ()) / greatest(stddev_samp({c}) OVER (), 1e-6) AS z_{c}' for c in M)} FROM b_site_month"
# the rain and temperature columns and their distance from the normal have equal z up to rounding
ZTOP = f"""SELECT *, {ZMAX} AS max_z FROM ({Z}) z"""


@query("ano_zscore", f"SELECT row_id, {', '.join(f'z_{c}' for c in M)}, max_z FROM ({ZTOP}) t", "b_site_month")
def ano_zscore(i: Inputs):
    df = i("b_site_month")
    out = an.z_scores(df, an.feature_moments(df))
    return out.select("row_id", *[f"z_{c}" for c in M], "max_z")


@query("ano_percentile_rules", f"""WITH s AS ({STATS}) SELECT row_id,
 ideam_precipitacion_anomalia < (SELECT p05 FROM s WHERE feature = 'ideam_precipitacion_anomalia') AS drought,
 ideam_temperatura_anomalia > (SELECT p95 FROM s WHERE feature = 'ideam_temperatura_anomalia') AS heat_wave,
 (upra_var_mensual_pct - (SELECT mean FROM s WHERE feature = 'upra_var_mensual_pct')) / (SELECT std FROM s WHERE feature = 'upra_var_mensual_pct') > 3 AS price_spike
FROM b_site_month""", "b_site_month")
def ano_percentile_rules(i: Inputs):
    df = i("b_site_month")
    return an.percentile_rules(df, an.feature_stats(df)).select("row_id", "drought", "heat_wave", "price_spike")


KIND = """CASE WHEN abs(p) >= 2 AND abs(r) >= 2 THEN 'riesgo_compuesto' WHEN p >= 2 THEN 'precio_extremo' WHEN p <= -2 THEN 'precio_minimo'
 WHEN r <= -2 THEN 'sequia_extrema' WHEN r >= 2 THEN 'exceso_hidrico' WHEN t >= 2 THEN 'ola_calor' ELSE 'anomalia_multivariada' END"""
CLASSIFIED = f"""SELECT row_id, max_z, {KIND} AS kind, CASE WHEN max_z >= 3 THEN 'CRÍTICA' WHEN max_z >= 2.5 THEN 'ALTA' ELSE 'MODERADA' END AS severity
FROM (SELECT row_id, max_z, z_upra_var_mensual_pct AS p, z_ideam_precipitacion_anomalia AS r, z_ideam_temperatura_anomalia AS t FROM ({ZTOP}) a) b"""


def classified(i: Inputs):
    df = i("b_site_month")
    return an.classified(an.z_scores(df, an.feature_moments(df)))


@query("ano_classify", f"SELECT row_id, kind, severity FROM ({CLASSIFIED}) c", "b_site_month")
def ano_classify(i: Inputs):
    return classified(i).select("row_id", "kind", "severity")


LOF = f"""z AS ({z_sql(M, 'b_region_month')}),
 d AS (SELECT a.row_id AS p, b.row_id AS q, {dist_sql(M)} AS dist FROM z a JOIN z b ON a.row_id <> b.row_id),
 nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY dist, q) AS rn FROM d) x WHERE rn <= 20),
 kd AS (SELECT p, max(dist) AS kdist FROM nn GROUP BY 1),
 lrd AS (SELECT nn.p, 1 / (avg(greatest(dist, kdist)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.p = nn.q GROUP BY 1),
 trained AS (SELECT nn.p, avg(o.lrd) / any_value(s.lrd) AS lof FROM nn JOIN lrd o ON o.p = nn.q JOIN lrd s ON s.p = nn.p GROUP BY 1),
 ns AS (SELECT p, q, dist FROM nn WHERE rn <= 19 UNION ALL SELECT row_id, row_id, 0 FROM z),
 lrds AS (SELECT ns.p, 1 / (avg(greatest(dist, kdist)) + 1e-10) AS lrd FROM ns JOIN kd ON kd.p = ns.q GROUP BY 1),
 fresh AS (SELECT ns.p AS row_id, avg(o.lrd) / any_value(s.lrd) AS lof FROM ns JOIN lrd o ON o.p = ns.q JOIN lrds s ON s.p = ns.p GROUP BY 1),
 lofs AS (SELECT row_id, lof, -lof < (SELECT quantile_cont(-lof, 0.1) FROM trained) AS lof_outlier FROM fresh)"""


def lof(i: Inputs):
    return an.local_outlier_factor(i("b_region_month"), "row_id", M)


@query("ano_lof", f"WITH {LOF} SELECT * FROM lofs", "b_region_month")
def ano_lof(i: Inputs):
    return lof(i)


@query("ano_isolation_forest")
def ano_isolation_forest(i: Inputs):
    df = i("b_site_month")
    return an.fit_isolation_forest(df, "row_id").detect(df).select("row_id", "if_score", "if_outlier")


@query("ano_score_points")
def ano_score_points(i: Inputs):
    df = i("b_site_month")
    model = an.fit_isolation_forest(df.where("anio < 2023"), "row_id")
    return model.detect(df.where("anio >= 2023")).select("row_id", "if_score", "if_outlier")


# given scores: one from the index, one from the z-scores
GIVEN = f"""SELECT t.row_id, c.kind, c.severity, -0.4 - upra_indice_total / 10000 AS if_score, t.max_z AS lof, upra_indice_total > 400 AS if_outlier,
 t.max_z > 2.5 AS lof_outlier FROM ({ZTOP}) t JOIN ({CLASSIFIED}) c ON c.row_id = t.row_id"""
COMBINED = f"""SELECT row_id, kind, severity, if_outlier OR lof_outlier AS is_anomaly,
 0.6 * (-if_score - min(-if_score) OVER ()) / (max(-if_score) OVER () - min(-if_score) OVER () + 1e-9)
 + 0.4 * (lof - min(lof) OVER ()) / (max(lof) OVER () - min(lof) OVER () + 1e-9) AS combined FROM ({GIVEN}) g"""


def combined(i: Inputs):
    given = classified(i).withColumns({
        "if_score": -0.4 - F.col("upra_indice_total") / 10000, "lof": F.col("max_z"),
        "if_outlier": F.col("upra_indice_total") > 400, "lof_outlier": F.col("max_z") > 2.5})
    return an.combined(given).select("row_id", "kind", "severity", "is_anomaly", "combined")


@query("ano_combine", f"SELECT row_id, is_anomaly, combined FROM ({COMBINED}) c", "b_site_month")
def ano_combine(i: Inputs):
    return combined(i).select("row_id", "is_anomaly", "combined")


@query("ano_ranked", f"SELECT row_id, kind, combined FROM ({COMBINED}) c WHERE is_anomaly ORDER BY combined DESC, row_id LIMIT 10", "b_site_month")
def ano_ranked(i: Inputs):
    return an.ranked(combined(i), "row_id").select("row_id", "kind", "combined")


@query("ano_summary", f"""WITH c AS ({COMBINED}) SELECT count(*) AS rows, count(*) FILTER (WHERE is_anomaly) AS anomalies,
 count(*) FILTER (WHERE is_anomaly) * 100.0::DOUBLE / count(*) AS rate_pct, count(*) FILTER (WHERE is_anomaly AND severity = 'CRÍTICA') AS critical,
 (SELECT kind FROM c WHERE is_anomaly GROUP BY 1 ORDER BY count(*) DESC, kind DESC LIMIT 1) AS top_kind FROM c""", "b_site_month")
def ano_summary(i: Inputs):
    return an.summary(combined(i))


@query("ano_pipeline")
def ano_pipeline(i: Inputs):
    return an.ranked(an.detected(i("b_site_month"), "row_id"), "row_id", None).select(
        "row_id", "combined", "if_score", "lof", "kind", "severity", "max_z", "max_feature", "description")


# --- clustering ------------------------------------------------------------------------------
# a given assignment: one cluster per calendar quarter
GIVEN_CLUSTER = "CAST(row_id % 4 AS INTEGER)"
QUAL = f"""WITH p AS (SELECT row_id, {', '.join(M)}, {GIVEN_CLUSTER} AS k FROM ({z_sql(M, 'b_region_month')}) z),
 c AS (SELECT k, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in M)} FROM p GROUP BY 1),
 g AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in M)} FROM p),
 o AS (SELECT p.k, avg({dist_sql(M, 'p', 'c')}) AS spread, sum(pow({dist_sql(M, 'p', 'c')}, 2)) AS within FROM p JOIN c ON c.k = p.k GROUP BY 1),
 db AS (SELECT avg(w) AS v FROM (SELECT a.k, max((x.spread + y.spread) / {dist_sql(M)}) AS w FROM c a JOIN c b ON a.k <> b.k JOIN o x ON x.k = a.k JOIN o y ON y.k = b.k GROUP BY 1) q),
 ch AS (SELECT (SELECT sum(n * pow({dist_sql(M, 'c', 'g')}, 2)) FROM c, g) / (count(*) - 1) / (sum(within) / ((SELECT count(*) FROM p) - count(*))) AS v FROM o),
 m AS (SELECT a.row_id, a.k, b.k AS other, sum({dist_sql(M)}) AS total, count(*) AS n FROM p a JOIN p b ON true GROUP BY 1, 2, 3),
 ab AS (SELECT row_id, max(total / (n - 1)) FILTER (WHERE k = other) AS a, min(total / n) FILTER (WHERE k <> other) AS b FROM m GROUP BY 1)
SELECT (SELECT avg((b - a) / greatest(a, b)) FROM ab) AS silhouette, (SELECT v FROM db) AS davies_bouldin, (SELECT v FROM ch) AS calinski_harabasz"""


@query("clu_quality", QUAL, "b_region_month")
def clu_quality(i: Inputs):
    z = nb.standardised(i("b_region_month"), M, ["row_id"]).withColumn("cluster", F.expr(GIVEN_CLUSTER))
    return cl.quality(z, M)


@query("clu_kmeans")
def clu_kmeans(i: Inputs):
    out, _, _ = cl.kmeans(i("b_site_month"), "row_id", 4)
    return out


@query("clu_pipeline")
def clu_pipeline(i: Inputs):
    rows = i("b_site_month")
    return cl.periods(rows.where("anio < 2023"), rows.where("anio >= 2023"), "row_id", 4)[0]


@query("clu_best_k")
def clu_best_k(i: Inputs):
    return cl.best_k(i("b_region_month"), "row_id")


DBSCAN = f"""z AS ({z_sql(SHORT, 'b_region_month')}),
 e AS (SELECT a.row_id AS p, b.row_id AS q FROM z a JOIN z b ON {dist_sql(SHORT)} <= 0.25),
 core AS (SELECT p FROM e GROUP BY 1 HAVING count(*) >= 3),
 ce AS (SELECT e.p, e.q FROM e JOIN core a ON a.p = e.p JOIN core b ON b.p = e.q),
 reach(p, root) AS (SELECT p, p FROM core UNION SELECT ce.q, r.root FROM reach r JOIN ce ON ce.p = r.p),
 comp AS (SELECT p, min(root) AS root FROM reach GROUP BY 1),
 num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM comp) x),
 rim AS (SELECT e.p, min(num.cluster) AS cluster FROM e JOIN comp ON comp.p = e.q JOIN num USING (root) WHERE e.p NOT IN (SELECT p FROM core) GROUP BY 1),
 dbs AS (SELECT z.row_id, coalesce(num.cluster, rim.cluster, -1) AS cluster, comp.p IS NOT NULL AS is_core
  FROM z LEFT JOIN comp ON comp.p = z.row_id LEFT JOIN num ON num.root = comp.root LEFT JOIN rim ON rim.p = z.row_id)"""


def density(i: Inputs):
    return cl.dbscan(i("b_region_month"), "row_id", SHORT, eps=0.25)


@query("clu_dbscan", f"WITH RECURSIVE {DBSCAN} SELECT * FROM dbs", "b_region_month")
def clu_dbscan(i: Inputs):
    return density(i)


@query("clu_outlier_summary", f"""WITH RECURSIVE {DBSCAN} SELECT count(*) AS rows, count(*) FILTER (WHERE cluster = -1) AS outliers,
 count(*) FILTER (WHERE cluster = -1) * 100.0::DOUBLE / count(*) AS outlier_pct, count(DISTINCT cluster) FILTER (WHERE cluster >= 0) AS clusters FROM dbs""", "b_region_month")
def clu_outlier_summary(i: Inputs):
    return cl.outlier_summary(density(i))


@query("clu_profiles", f"""WITH p AS (SELECT *, CAST(mes AS INTEGER) % 4 AS cluster FROM b_site_month),
 m AS (SELECT cluster, count(*) AS rows, {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in M)} FROM p GROUP BY 1),
 l AS (SELECT quantile_cont(upra_indice_total, 0.6) AS line FROM p)
SELECT m.*, CASE WHEN upra_indice_total > line AND ideam_precipitacion_anomalia < -20 THEN 'ALTA' WHEN upra_indice_total > line THEN 'MEDIA-ALTA'
  WHEN ideam_precipitacion_anomalia > 20 THEN 'MEDIA' ELSE 'BAJA' END AS risk,
 CASE WHEN upra_indice_total > line AND ideam_precipitacion_anomalia < -20 THEN 'Precios altos con falta de lluvia' WHEN upra_indice_total > line THEN 'Presión de precios'
  WHEN ideam_precipitacion_anomalia > 20 THEN 'Exceso de lluvia' ELSE 'Condiciones favorables' END AS profile FROM m, l""", "b_site_month")
def clu_profiles(i: Inputs):
    return cl.profiles(i("b_site_month").withColumn("cluster", F.col("mes") % 4))


@query("clu_assign_new", f"""WITH z AS ({z_sql(M, 'b_site_month', 'row_id, anio')}),
 c AS (SELECT CAST(row_id % 5 AS INTEGER) AS cluster, {', '.join(f'avg({c}) AS {c}' for c in M)} FROM z WHERE anio < 2022 GROUP BY 1)
SELECT row_id, cluster, distance FROM (SELECT z.row_id, c.cluster, {dist_sql(M, 'z', 'c')} AS distance,
  row_number() OVER (PARTITION BY z.row_id ORDER BY {dist_sql(M, 'z', 'c')}, c.cluster) AS rn FROM z JOIN c ON z.anio >= 2022) x WHERE rn = 1""", "b_site_month")
def clu_assign_new(i: Inputs):
    z = nb.standardised(i("b_site_month"), M, ["row_id", "anio"])
    centres = z.where("anio < 2022").groupBy((F.col("row_id") % 5).cast("int").alias("cluster")).agg(*[F.avg(c).alias(c) for c in M])
    return cl.assign(z.where("anio >= 2022"), centres, M).select("row_id", "cluster", "distance")
