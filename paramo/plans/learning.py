"""Registered queries: supervised models, evaluation (H), attribution (L) and model insights (E11, E12).

The reference settings are the defaults of the operators (300 or 400 trees, 300 boosting rounds, 5 folds).  All queries
run with them over whole tables.
"""

from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.functions import neighbours as nb
from paramo.operators import anomaly as an
from paramo.operators import attribution as at
from paramo.operators import cluster as cl
from paramo.operators import evaluate as ev
from paramo.operators import forecast as fc
from paramo.operators import models as mo
from paramo.operators import rules as ru
from paramo.operators import score as sc
from paramo.operators import tree_attribution as ta
from paramo.plans.catalog import Inputs, query
from paramo.plans.features import CLASS, LABEL, MATRIX, SCORED, SITE_SCORED, matrix, score_sql
from paramo.plans.features import USES as MATRIX_USES
from paramo.plans.outliers import z_sql
from paramo.plans.texts import listed, with_actions
from paramo.session import cut_lineage, materialise, shared_path

SITES = "b_site_month"


def labelled(i: Inputs):
    """Scored and labelled site months, written out once because every fit reads them again; the score reads its rows twice."""
    return cut_lineage(sc.labelled(sc.score(materialise(i(SITES)), digits=None)).drop("color"))


def split(i: Inputs):
    rows = cut_lineage(mo.stratified_split(labelled(i), "row_id"))
    # below the least size is_test is null: every row trains and tests
    return rows.where("NOT coalesce(is_test, false)"), rows.where("coalesce(is_test, true)")


@query("ml_standardize", z_sql(fv.FEATURES, SITES), SITES)
def ml_standardize(i: Inputs):
    return nb.standardised(i(SITES), fv.FEATURES, ["row_id"])


@query("ml_stratified_split")
def ml_stratified_split(i: Inputs):
    return mo.stratified_split(labelled(i), "row_id").select("row_id", "class_id", "is_test")


@query("ml_class_weights", f"""WITH c AS (SELECT {CLASS} AS class_id, count(*) AS rows FROM ({SITE_SCORED}) q GROUP BY 1)
SELECT class_id, rows, CAST((SELECT sum(rows) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * rows) AS weight FROM c""", SITES)
def ml_class_weights(i: Inputs):
    return mo.class_weights(sc.labelled(sc.score(i(SITES), digits=None)))


TEST_SIZES = f"SELECT {CLASS} AS class_id, count(*) AS rows, CAST(ceil(count(*) * 0.2) AS BIGINT) AS test_rows FROM ({SITE_SCORED}) q GROUP BY 1"


@query("ml_stratified_split_sizes", TEST_SIZES, SITES)
def ml_stratified_split_sizes(i: Inputs):
    return mo.stratified_split(labelled(i), "row_id").groupBy("class_id").agg(F.count("*").alias("rows"), F.count_if("is_test").alias("test_rows"))


def spread(df, *keep):
    p = F.col("proba")
    return df.select(*keep, p[0].alias("p_baja"), p[1].alias("p_media"), p[2].alias("p_alta"), "predicted")


@query("ml_random_forest")
def ml_random_forest(i: Inputs):
    train, test = split(i)
    return spread(mo.predicted(mo.forest_proba(mo.fit_forest(train), test)), "row_id", "class_id")


@query("ml_gradient_boosting")
def ml_gradient_boosting(i: Inputs):
    train, test = split(i)
    return spread(mo.predicted(mo.fit_boosting(train).proba(test)), "row_id", "class_id")


@query("ml_calibrate")
def ml_calibrate(i: Inputs):
    train, test = split(i)
    model = mo.fit_ensemble(train, "row_id")
    return spread(model.predict(test), "row_id", "class_id")


@query("ml_evaluate_ensemble")
def ml_evaluate_ensemble(i: Inputs):
    train, test = split(i)
    rows = cut_lineage(mo.fit_ensemble(train, "row_id").predict(test).select(
        F.col("class_id").alias("actual"), "predicted", *[F.col("proba")[c].alias(f"s{c}") for c in range(3)]))
    report = ev.class_report(ev.confusion(rows))
    auc = ev.auc_one_vs_rest(rows, {0: "s0", 1: "s1", 2: "s2"})
    return report.join(auc, "name", "left").select("name", "precision", "recall", "f1", "support", "auc")


# given probabilities: two smooth functions of the score
def given_sql(c1, c2):
    parts = [f"exp(-abs(score - {c}) / {c1 if j == 0 else c2})" for j in (0, 1) for c in (15, 33, 50)]
    return parts[:3], parts[3:]


_PA, _PB = given_sql(6, 15)
GIVEN = f"""SELECT row_id, class_id, [a0 / (a0 + a1 + a2), a1 / (a0 + a1 + a2), a2 / (a0 + a1 + a2)] AS pa, [b0 / (b0 + b1 + b2), b1 / (b0 + b1 + b2), b2 / (b0 + b1 + b2)] AS pb
FROM (SELECT row_id, {CLASS} AS class_id, {', '.join(f'{e} AS a{j}' for j, e in enumerate(_PA))}, {', '.join(f'{e} AS b{j}' for j, e in enumerate(_PB))} FROM ({SITE_SCORED}) q) w"""
VOTED = f"""SELECT row_id, class_id, p0, p1, p2, greatest(p0, p1, p2) AS top, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS predicted
FROM (SELECT row_id, class_id, 0.45 * pa[1] + 0.55 * pb[1] AS p0, 0.45 * pa[2] + 0.55 * pb[2] AS p1, 0.45 * pa[3] + 0.55 * pb[3] AS p2 FROM ({GIVEN}) g) v"""


def voted(i: Inputs):
    df = sc.labelled(sc.score(i(SITES), digits=None))
    probs = {}
    for name, parts in (("pa", _PA), ("pb", _PB)):
        es = [F.expr(p) for p in parts]
        probs[name] = F.array(*[e / (es[0] + es[1] + es[2]) for e in es])
    return ev.soft_vote(df.withColumns(probs), "pa", "pb")


@query("ml_soft_vote", f"SELECT row_id, class_id, p0 AS p_baja, p1 AS p_media, p2 AS p_alta, predicted FROM ({VOTED}) v", SITES)
def ml_soft_vote(i: Inputs):
    return spread(voted(i), "row_id", "class_id")


@query("ml_confidence_level", f"""SELECT row_id, p0 AS p_baja, p2 AS p_alta, top AS confidence, CASE WHEN top >= 0.75 THEN 'Alta' WHEN top >= 0.5 THEN 'Media' ELSE 'Baja' END AS confidence_level
FROM ({VOTED}) v""", SITES)
def ml_confidence_level(i: Inputs):
    return ev.confidence(voted(i)).select("row_id", F.col("probabilities")["BAJA"].alias("p_baja"), F.col("probabilities")["ALTA"].alias("p_alta"), "confidence", "confidence_level")


@query("ml_cv_f1")
def ml_cv_f1(i: Inputs):
    return mo.cross_validate(labelled(i), "row_id")


CELLS = f"""v AS ({VOTED}), cells AS (SELECT a.c AS actual, p.c AS predicted, count(v.row_id) AS rows FROM (VALUES (0), (1), (2)) AS a(c)
  CROSS JOIN (VALUES (0), (1), (2)) AS p(c) LEFT JOIN v ON v.class_id = a.c AND v.predicted = p.c GROUP BY 1, 2),
 per AS (SELECT name, tp / nullif(claimed, 0) AS precision, tp / support AS recall, support FROM (
  SELECT a.label AS name, CAST(sum(rows) FILTER (WHERE actual = c AND predicted = c) AS DOUBLE) AS tp, CAST(sum(rows) FILTER (WHERE actual = c) AS BIGINT) AS support,
   CAST(sum(rows) FILTER (WHERE predicted = c) AS BIGINT) AS claimed FROM cells, (VALUES (0, 'BAJA'), (1, 'MEDIA'), (2, 'ALTA')) AS a(c, label) GROUP BY 1) x WHERE support > 0),
 per1 AS (SELECT name, coalesce(precision, 0) AS precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM per),
 rep AS (SELECT * FROM per1 UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per1
  UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per1
  UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT avg(CAST(class_id = predicted AS INTEGER)) AS a, count(*) AS n FROM v) q)"""


def pairs(i: Inputs):
    return voted(i).select("row_id", F.col("class_id").alias("actual"), "predicted", "proba")


@query("ml_confusion", f"WITH {CELLS} SELECT actual, predicted, rows, coalesce(CAST(rows AS DOUBLE) / nullif(sum(rows) OVER (PARTITION BY actual), 0), 0) AS share FROM cells", SITES)
def ml_confusion(i: Inputs):
    return ev.confusion(pairs(i))


@query("ml_class_report", f"WITH {CELLS} SELECT * FROM rep", SITES)
def ml_class_report(i: Inputs):
    return ev.class_report(ev.confusion(pairs(i)))


AUC = f"""r AS (SELECT k.name, k.c, v.class_id, CASE k.c WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS s FROM ({VOTED}) v, (VALUES (0, 'BAJA'), (1, 'MEDIA'), (2, 'ALTA')) AS k(c, name)),
 rk AS (SELECT *, rank() OVER (PARTITION BY name ORDER BY s) + (count(*) OVER (PARTITION BY name, s) - 1) / 2.0 AS rk FROM r),
 a AS (SELECT name, (sum(rk) FILTER (WHERE class_id = c) - count(*) FILTER (WHERE class_id = c) * (count(*) FILTER (WHERE class_id = c) + 1) / 2.0)
   / (count(*) FILTER (WHERE class_id = c) * count(*) FILTER (WHERE class_id <> c)) AS auc FROM rk GROUP BY name)"""


def scores(i: Inputs):
    return pairs(i).select("actual", *[F.col("proba")[c].alias(f"s{c}") for c in range(3)])


@query("ml_auc_ovr", f"WITH {AUC} SELECT name, auc FROM a UNION ALL SELECT 'macro', avg(auc) FROM a", SITES)
def ml_auc_ovr(i: Inputs):
    return ev.auc_one_vs_rest(scores(i), {0: "s0", 1: "s1", 2: "s2"})


@query("ml_metric_bands", f"""WITH {CELLS}, {AUC}, m AS (SELECT 'accuracy' AS metric, f1 AS value FROM rep WHERE name = 'accuracy'
 UNION ALL SELECT 'f1', f1 FROM rep WHERE name = 'macro' UNION ALL SELECT 'auc', avg(auc) FROM a)
SELECT metric, value, CASE WHEN value > CASE metric WHEN 'accuracy' THEN 0.85 WHEN 'f1' THEN 0.80 ELSE 0.90 END THEN 'Excelente'
 WHEN value > CASE metric WHEN 'accuracy' THEN 0.70 WHEN 'f1' THEN 0.65 ELSE 0.75 END THEN 'Aceptable' ELSE 'Mejorable' END AS rating FROM m""", SITES)
def ml_metric_bands(i: Inputs):
    rep = ev.class_report(ev.confusion(pairs(i)))
    auc = ev.auc_one_vs_rest(scores(i), {0: "s0", 1: "s1", 2: "s2"}).where("name = 'macro'")
    rows = rep.where("name = 'accuracy'").select(F.lit("accuracy").alias("metric"), F.col("f1").alias("value")).unionByName(
        rep.where("name = 'macro'").select(F.lit("f1").alias("metric"), F.col("f1").alias("value"))).unionByName(
        auc.select(F.lit("auc").alias("metric"), F.col("auc").alias("value")))
    return ev.metric_bands(rows)


@query("ml_feature_importance")
def ml_feature_importance(i: Inputs):
    train, _ = split(i)
    return mo.importances(mo.fit_forest(train), i.spark)


@query("ml_base_comparison")
def ml_base_comparison(i: Inputs):
    return mo.compare_base(*split(i))


@query("ml_predict_batch")
def ml_predict_batch(i: Inputs):
    train, test = split(i)
    return mo.predict_batch(mo.fit_forest(train), test).select("row_id", "ivt_clase", "ivt_etiqueta")


GRID_SQL = f"""SELECT site_id, row_id, upra_indice_total, v AS upra_var_mensual_pct, r AS ideam_precipitacion_mm, r - 150 AS ideam_precipitacion_anomalia,
 ideam_temperatura_anomalia, mes, anio FROM b_site_month b,
 (SELECT unnest(generate_series(0, 10)) * CAST(50 AS DOUBLE) AS r) q, (SELECT unnest(generate_series(0, 8)) * CAST(2.5 AS DOUBLE) - 5 AS v) p"""


@query("ml_scenarios", f"""SELECT upra_var_mensual_pct, ideam_precipitacion_mm, {CLASS} AS class_id, count(*) AS rows, avg(score) AS mean_score
FROM ({score_sql(f'({GRID_SQL})', '80', '200')}) q GROUP BY 1, 2, 3""", SITES)
def ml_scenarios(i: Inputs):
    base = i(SITES).drop("upra_var_mensual_pct", "ideam_precipitacion_mm", "ideam_precipitacion_anomalia")
    grid = mo.scenario_grid(base, {"ideam_precipitacion_mm": (0, 500, 50), "upra_var_mensual_pct": (-5, 15, 2.5)})
    grid = grid.withColumn("ideam_precipitacion_anomalia", F.col("ideam_precipitacion_mm") - fv.RAIN_NORMAL_MM)
    # every site month under 99 scenarios, reported per scenario and class
    return sc.labelled(sc.score(grid, (80, 200), digits=None)).groupBy("upra_var_mensual_pct", "ideam_precipitacion_mm", "class_id").agg(
        F.count("*").alias("rows"), F.avg("score").alias("mean_score"))


@query("ml_save_load", f"SELECT CAST(sum(test_rows) AS BIGINT) AS rows, 0 AS changed FROM ({TEST_SIZES}) t", SITES)
def ml_save_load(i: Inputs):
    train, test = split(i)
    model, path = mo.fit_forest(train), shared_path(i.spark, "forest")
    mo.save(model, path, mo.importances(model, i.spark))
    again, _ = mo.load(i.spark, path)
    a = mo.predict_batch(model, test).select("row_id", F.col("ivt_clase").alias("before"))
    both = a.join(mo.predict_batch(again, test).select("row_id", F.col("ivt_clase").alias("after")), "row_id")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("before") != F.col("after")).alias("changed"))


# --- attribution -----------------------------------------------------------------------------------
SPAN = (80.0, 200.0)
_COLS = [c for cs in at.GROUPS.values() for c in cs]
_MIX = ", ".join(f"CASE WHEN (m.k & {1 << j}) > 0 THEN r.{c} ELSE b.{c} END AS {c}" for j, cs in enumerate(at.GROUPS.values()) for c in cs)
SHAP = f"""mt AS ({MATRIX}), mix AS (SELECT r.fecha, m.k, {_MIX} FROM mt r, mt b, (SELECT unnest(generate_series(0, 15)) AS k) m),
 v AS (SELECT fecha, k, bit_count(CAST(k AS INTEGER)) AS size, avg(score) AS v FROM ({score_sql('mix', '80', '200')}) q GROUP BY 1, 2, 3),
 shap AS (SELECT fecha, g.feature, sum(CASE WHEN (k & g.bit) > 0 THEN v * CASE size WHEN 1 THEN 0.25 WHEN 2 THEN 1.0 / 12 WHEN 3 THEN 1.0 / 12 ELSE 0.25 END
   ELSE -v * CASE size WHEN 0 THEN 0.25 WHEN 1 THEN 1.0 / 12 WHEN 2 THEN 1.0 / 12 ELSE 0.25 END END) AS contribution
  FROM v, (VALUES {', '.join(f"('{n}', {1 << j})" for j, n in enumerate(at.GROUPS))}) AS g(feature, bit) GROUP BY 1, 2)"""


def shap(i: Inputs):
    # the matrix is written out: its rows meet one another as rows and as background
    rows = cut_lineage(matrix(i))
    return at.score_shapley(rows, rows, "fecha", SPAN)


@query("xai_shapley_rows", f"WITH {SHAP} SELECT * FROM shap", MATRIX_USES)
def xai_shapley_rows(i: Inputs):
    return shap(i)


@query("xai_shapley_model")
def xai_shapley_model(i: Inputs):
    train, test = split(i)
    return ta.tree_shapley(test, train, "row_id", mo.fit_forest(train), 2)


@query("xai_global_importance", f"WITH {SHAP} SELECT feature, avg(abs(contribution)) AS importance FROM shap GROUP BY 1", MATRIX_USES)
def xai_global_importance(i: Inputs):
    return at.global_importance(shap(i))


RANKED = f"""{SHAP}, rk AS (SELECT *, row_number() OVER (PARTITION BY fecha ORDER BY abs(round(contribution, 9)) DESC, feature) AS rank FROM shap)"""


def steady(df):
    # sums arrive in any order: nine decimals make equal contributions equal
    return df.withColumn("contribution", F.round("contribution", 9))


@query("xai_top_factors", f"""WITH {RANKED} SELECT fecha, feature, round(contribution, 9) AS contribution, CAST(rank AS INTEGER) AS rank, feature AS title,
 CASE WHEN round(contribution, 9) > 0 THEN '#EF4444' ELSE '#3B82F6' END AS color FROM rk WHERE rank <= 3""", MATRIX_USES)
def xai_top_factors(i: Inputs):
    return at.top_factors(steady(shap(i)), "fecha", 3)


@query("xai_importance_pct", f"""WITH {SHAP}, g AS (SELECT feature, avg(abs(contribution)) AS importance FROM shap GROUP BY 1)
SELECT feature, importance, importance / (SELECT sum(importance) FROM g) * 100 AS importance_pct FROM g""", MATRIX_USES)
def xai_importance_pct(i: Inputs):
    return at.importance_pct(at.global_importance(shap(i)))


@query("xai_text", f"""WITH {RANKED}, lab AS (SELECT fecha, {LABEL} AS label FROM ({SCORED}) q),
 u AS (SELECT *, sum(CAST(contribution > 0.5 AS INTEGER)) OVER w AS u, sum(CAST(contribution < -0.5 AS INTEGER)) OVER w AS d FROM rk WHERE rank <= 5 WINDOW w AS (PARTITION BY fecha ORDER BY rank)),
 t AS (SELECT fecha, CASE WHEN contribution > 0.5 THEN rank ELSE rank + 100 END AS o,
   CASE WHEN contribution > 0.5 AND u <= 3 THEN 'Sube el riesgo: ' || feature || '.' WHEN contribution < -0.5 AND d <= 2 THEN 'Baja el riesgo: ' || feature || '.' END AS t FROM u),
 body AS (SELECT fecha, coalesce(string_agg(t, ' ' ORDER BY o), 'Nada se aparta de lo normal.') AS b FROM t GROUP BY 1),
 tot AS (SELECT fecha, coalesce(sum(contribution) FILTER (WHERE contribution > 0), 0) AS total_positive, coalesce(sum(contribution) FILTER (WHERE contribution < 0), 0) AS total_negative FROM shap GROUP BY 1)
SELECT fecha, CASE label WHEN 'ALTA' THEN 'Riesgo alto.' WHEN 'MEDIA' THEN 'Riesgo moderado.' ELSE 'Condiciones favorables.' END || ' ' || b AS explanation, total_positive, total_negative
FROM tot JOIN body USING (fecha) JOIN lab USING (fecha)""", MATRIX_USES)
def xai_text(i: Inputs):
    labels = sc.labelled(sc.score(matrix(i), digits=None)).select("fecha", "label")
    return at.explanation(steady(shap(i)).join(labels, "fecha"), "fecha")


@query("xai_permutation_importance")
def xai_permutation_importance(i: Inputs):
    train, test = split(i)
    model = mo.fit_forest(train)
    return at.permutation_importance(test, "row_id", lambda df: mo.predicted(mo.forest_proba(model, df)))


# --- insights over model outputs ----------------------------------------------------------------------
_ZANY = " OR ".join(f"abs(coalesce({c}, 0) - (SELECT avg(coalesce({c}, 0)) FROM m)) / (SELECT greatest(stddev_samp(coalesce({c}, 0)), 1e-6) FROM m) >= 2.5" for c in fv.MEASURES)
STATE = f"""m AS ({MATRIX}), st AS (SELECT (SELECT {LABEL} FROM ({SCORED}) q ORDER BY fecha DESC LIMIT 1) AS label,
  (SELECT regr_slope(upra_indice_total, x) / arg_max(upra_indice_total, fecha) * 100 FROM (SELECT *, row_number() OVER (ORDER BY fecha) AS x FROM m) y) AS ch,
  (SELECT count(*) FROM m WHERE {_ZANY}) AS n)"""


def insight_state(i: Inputs):
    rows = cut_lineage(matrix(i))
    scored = sc.labelled(sc.score(rows, digits=None))
    label = scored.agg(F.max_by("label", "fecha")).scalar()
    series = rows.select(F.lit("index").alias("series_key"), F.col("fecha").alias("month"), F.col("upra_indice_total").alias("y"))
    first = fc.linear_trend(series, 1).select("trend").scalar()
    last = rows.agg(F.max_by("upra_indice_total", "fecha")).scalar()
    filled = an.filled(rows, fv.MEASURES)
    odd = an.z_scores(filled, an.feature_moments(filled)).where(F.col("max_z") >= fv.Z_HIGH).agg(F.count("*")).scalar()
    return i.spark.range(1).select(label.alias("label"), first.alias("_f"), last.alias("_l"), odd.alias("n_anomalies")).select(
        "label", ((F.col("_f") - F.col("_l")) / F.col("_l") * 100).alias("forecast_change_pct"), "n_anomalies")


@query("rec_model_insights", f"""WITH {STATE}, r AS (SELECT 1 AS seq, 'modelo_alta' AS rule, 'ALERTA' AS kind, 'ALTA' AS priority, CAST(2 AS DOUBLE) AS metric, CAST(2 AS DOUBLE) AS threshold FROM st WHERE label = 'ALTA'
 UNION ALL SELECT 2, 'modelo_media', 'MONITOREO', 'MEDIA', 1, 1 FROM st WHERE label = 'MEDIA' UNION ALL SELECT 3, 'alza_prevista', 'PREVENCIÓN', 'MEDIA', ch, 5 FROM st WHERE ch > 5
 UNION ALL SELECT 4, 'muchas_anomalias', 'INVESTIGACIÓN', 'BAJA', n, 5 FROM st WHERE n > 5
 UNION ALL SELECT 5, 'todo_estable', 'INFO', 'BAJA', 0, 0 FROM st WHERE label = 'BAJA' AND NOT coalesce(ch, 0) > 5 AND n <= 5) {with_actions('SELECT * FROM r')}""", MATRIX_USES)
def rec_model_insights(i: Inputs):
    return listed(ru.model_insights(insight_state(i)))


@query("rec_executive_summary")
def rec_executive_summary(i: Inputs):
    rows = cut_lineage(matrix(i).withColumn("row_id", F.col("anio") * 12 + F.col("mes")))
    scored = sc.labelled(sc.score(rows, digits=None))

    def metric(model, name, value):
        return i.spark.range(1).select(F.lit(model).alias("model"), F.lit(name).alias("metric"), value.cast("string").alias("value"))

    series = rows.select(F.lit("upra_indice_total").alias("series_key"), F.col("fecha").alias("month"), F.col("upra_indice_total").alias("y"))
    ahead = fc.output(series, fc.holt_winters_forecast(fc.holt_winters(fc.regularise(series), kind="log"), 3)
                      .select("series_key", "month", F.col("hw").alias("value"), F.col("hw").alias("low"), F.col("hw").alias("high")))
    groups, _, _ = cl.kmeans(rows, "row_id", 4)
    forest = an.fit_isolation_forest(rows, "row_id").detect(rows)
    lof = an.local_outlier_factor(rows, "row_id", fv.MEASURES)
    odd = cut_lineage(forest.join(lof, "row_id").select((F.col("if_outlier") | F.col("lof_outlier")).alias("odd")))
    importances = mo.importances(mo.fit_forest(scored), i.spark).where("rank <= 5")
    return (metric("score", "label", scored.agg(F.max_by("label", "fecha")).scalar())
            .unionByName(metric("forecast", "change_first_pct", ahead.agg(F.max("change_first_pct")).scalar()))
            .unionByName(metric("clusters", "profiles", groups.agg(F.countDistinct("cluster")).scalar()))
            .unionByName(metric("anomalies", "count", odd.agg(F.count_if("odd")).scalar()))
            .unionByName(metric("anomalies", "rate_pct", odd.agg(F.count_if("odd") * 100.0 / F.count("*")).scalar()))
            .unionByName(importances.select(F.lit("importance").alias("model"), F.col("feature").alias("metric"), F.col("importance").cast("string").alias("value"))))
