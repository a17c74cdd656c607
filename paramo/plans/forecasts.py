"""Registered queries: forecasting (K)."""

from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.operators import arima
from paramo.operators import forecast as fc
from paramo.plans.catalog import Inputs, query
from paramo.plans.features import MATRIX, lerp, matrix
from paramo.plans.features import USES as MATRIX_USES

B = "b_multi_series"
# every ninth month of each series is left out, so that there are gaps to fill
GAPPY = f"SELECT * FROM {B} WHERE (year(month) * 12 + month(month)) % 9 <> 0"
REGULAR = f"""cal AS (SELECT series_key, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month
  FROM (SELECT series_key, min(month) AS a, max(month) AS b, count(*) AS n FROM ({{src}}) q GROUP BY 1 HAVING count(*) >= 12) s),
 reg AS (SELECT series_key, month, {lerp('y', 'PARTITION BY series_key')} FROM
  (SELECT c.series_key, c.month, g.y, row_number() OVER (PARTITION BY c.series_key ORDER BY c.month) AS pos FROM cal c LEFT JOIN ({{src}}) g USING (series_key, month)) k)"""


def gappy(i: Inputs):
    return i(B).where((F.year("month") * 12 + F.month("month")) % 9 != 0)


def regular(i: Inputs):
    return fc.regularise(i(B))


WHOLE = f"SELECT * FROM {B}"


@query("fc_regularise", f"WITH {REGULAR.format(src=GAPPY)} SELECT * FROM reg", B)
def fc_regularise(i: Inputs):
    return fc.regularise(gappy(i))


@query("fc_transform", f"""SELECT series_key, month, t, CASE k WHEN 'log' THEN exp(t) WHEN 'sqrt' THEN t * t ELSE t END AS back FROM (
 SELECT series_key, month, k, CASE k WHEN 'log' THEN ln(greatest(y, 0.01)) WHEN 'sqrt' THEN sqrt(greatest(y, 0)) ELSE y END AS t FROM (
  SELECT *, CASE month(month) % 3 WHEN 0 THEN 'log' WHEN 1 THEN 'sqrt' ELSE 'none' END AS k FROM {B}) a) b""", B)
def fc_transform(i: Inputs):
    kind = F.when(F.month("month") % 3 == 0, "log").when(F.month("month") % 3 == 1, "sqrt").otherwise("none")
    df = i(B).withColumn("k", kind).withColumn("t", fc.forward(F.col("y"), F.col("k")))
    return df.select("series_key", "month", "t", fc.inverse(F.col("t"), F.col("k")).alias("back"))


FIXED = (0.3, 0.1, 0.2, 0.95)
_A, _B, _G, _P = (f"CAST({v} AS DOUBLE)" for v in FIXED)
HW = f"""{REGULAR.format(src=WHOLE)},
 arr AS (SELECT series_key, max(month) AS last_month, list(ln(greatest(y, 0.01)) ORDER BY month) AS y FROM reg GROUP BY 1 HAVING count(*) >= 24),
 init AS (SELECT *, list_avg(y[1:12]) AS l, (list_avg(y[13:24]) - list_avg(y[1:12])) / 12 AS b FROM arr),
 fold(series_key, last_month, y, i, l, b, s, e) AS (
  SELECT series_key, last_month, y, 0, l, b, [v / l for v in y[1:12]], CAST(0 AS DOUBLE) FROM init
  UNION ALL SELECT series_key, last_month, y, i + 1,
   {_A} * y[i + 1] / s[i % 12 + 1] + (1 - {_A}) * (l + {_P} * b),
   {_B} * ({_A} * y[i + 1] / s[i % 12 + 1] + (1 - {_A}) * (l + {_P} * b) - l) + (1 - {_B}) * {_P} * b,
   s[1:i % 12] || [{_G} * y[i + 1] / (l + {_P} * b) + (1 - {_G}) * s[i % 12 + 1]] || s[i % 12 + 2:12],
   e + y[i + 1] - (l + {_P} * b) * s[i % 12 + 1] FROM fold WHERE i < len(y))"""


@query("fc_holt_winters", f"""WITH RECURSIVE {HW} SELECT series_key, CAST(h AS INTEGER) AS step, CAST(last_month + to_months(CAST(h AS INTEGER)) AS DATE) AS month,
 exp((l + {_P} * (1 - pow({_P}, h)) / (1 - {_P}) * b) * s[(i + h - 1) % 12 + 1] + e / i) AS hw
FROM fold, (SELECT unnest(generate_series(1, 6)) AS h) q WHERE i = len(y)""", B)
def fc_holt_winters(i: Inputs):
    return fc.holt_winters_forecast(fc.holt_winters(regular(i), kind="log", grid=[FIXED]))


@query("fc_holt_winters_grid")
def fc_holt_winters_grid(i: Inputs):
    return fc.holt_winters_forecast(fc.holt_winters(regular(i), kind="log"))


@query("fc_holt_winters_search")
def fc_holt_winters_search(i: Inputs):
    return fc.holt_winters_forecast(fc.holt_winters(regular(i), kind="log", search=True))


@query("fc_sarima")
def fc_sarima(i: Inputs):
    return arima.forecast(arima.fit(regular(i), kind="log"))


@query("fc_sarima_two_stage")
def fc_sarima_two_stage(i: Inputs):
    return fc.sarima_forecast(fc.sarima_fit(regular(i), kind="log"))


@query("fc_stationarity")
def fc_stationarity(i: Inputs):
    return fc.stationarity(regular(i))


@query("fc_stationarity_no_lags", f"""WITH {REGULAR.format(src=WHOLE)}, d AS (SELECT series_key, lag(y) OVER w AS x, y - lag(y) OVER w AS dy FROM reg WINDOW w AS (PARTITION BY series_key ORDER BY month)),
 r AS (SELECT series_key, count(*) AS n, regr_slope(dy, x) AS b, regr_sxx(dy, x) AS sxx, regr_syy(dy, x) AS syy, regr_sxy(dy, x) AS sxy FROM d WHERE x IS NOT NULL GROUP BY 1)
SELECT series_key, 0 AS lag, b / sqrt((syy - b * sxy) / (n - 2) / sxx) AS t_stat, -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.040 / (n * n * n) AS critical,
 b / sqrt((syy - b * sxy) / (n - 2) / sxx) < -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.040 / (n * n * n) AS stationary FROM r""", B)
def fc_stationarity_no_lags(i: Inputs):
    return fc.stationarity(regular(i), max_lag=0)


@query("fc_intervals")
def fc_intervals(i: Inputs):
    return fc.holt_winters_intervals(fc.holt_winters(regular(i), kind="log", search=True))


@query("fc_pipeline")
def fc_pipeline(i: Inputs):
    return fc.pipeline(i(B), {f"NATION_{k}": kind for k, kind in ((0, "log"), (1, "sqrt"), (2, "log"), (3, "none"))})


NAIVE = f"SELECT series_key, month, y, lag(y, 12) OVER (PARTITION BY series_key ORDER BY month) AS guess FROM {B}"


def naive(i: Inputs):
    from pyspark.sql import Window as W
    return i(B).withColumn("guess", F.lag("y", 12).over(W.partitionBy("series_key").orderBy("month")))


@query("fc_metrics", f"""SELECT series_key, coalesce(sqrt(avg((y - guess) * (y - guess))), 0) AS rmse, coalesce(avg(abs(y - guess)), 0) AS mae,
 coalesce(avg(abs((y - guess) / y)) * 100, 0) AS mape FROM ({NAIVE}) q WHERE y <> 0 GROUP BY 1""", B)
def fc_metrics(i: Inputs):
    return fc.metrics(naive(i), "y", "guess", ["series_key"], digits=None)


# given forecasts: shares of the trend, each missing for some series
TREND = f"""tr AS (SELECT series_key, regr_slope(y, x) AS slope, arg_max(y, month) AS last, max(month) AS last_month FROM
  (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY month) - 1 AS x FROM {B}) q GROUP BY 1),
 trend AS (SELECT series_key, CAST(last_month + to_months(CAST(h AS INTEGER)) AS DATE) AS month, CAST(h AS INTEGER) AS step, last + slope * h AS trend FROM tr, (SELECT unnest(generate_series(1, 6)) AS h) k)"""


@query("fc_linear_trend", f"WITH {TREND} SELECT * FROM trend", B)
def fc_linear_trend(i: Inputs):
    return fc.linear_trend(i(B))


NUMBER = "CAST(substr(series_key, 8) AS INTEGER)"
ENSEMBLE = f"""{TREND}, hw AS (SELECT series_key, month, trend * 1.1 AS v, trend * 1.0 AS lo, trend * 1.2 AS hi FROM trend WHERE {NUMBER} % 3 <> 0),
 ar AS (SELECT series_key, month, trend * 0.9 AS v, trend * 0.8 AS lo, trend * 1.3 AS hi FROM trend WHERE {NUMBER} % 2 <> 0),
 ens AS (SELECT t.series_key, t.month,
  CASE WHEN h.v IS NOT NULL AND a.v IS NOT NULL THEN 0.6 * h.v + 0.4 * a.v ELSE coalesce(h.v, a.v, t.trend) END AS value,
  CASE WHEN h.v IS NOT NULL AND a.v IS NOT NULL THEN 0.6 * h.lo + 0.4 * a.lo ELSE coalesce(h.lo, a.lo, t.trend * 0.95) END AS low,
  CASE WHEN h.v IS NOT NULL AND a.v IS NOT NULL THEN 0.6 * h.hi + 0.4 * a.hi ELSE coalesce(h.hi, a.hi, t.trend * 1.05) END AS high,
  CASE WHEN h.v IS NOT NULL AND a.v IS NOT NULL THEN 'ensemble' WHEN h.v IS NOT NULL THEN 'holt_winters' WHEN a.v IS NOT NULL THEN 'sarima' ELSE 'trend' END AS model
  FROM trend t LEFT JOIN hw h USING (series_key, month) LEFT JOIN ar a USING (series_key, month))"""


def given_ensemble(i: Inputs):
    trend = fc.linear_trend(i(B)).drop("step")
    v, no = F.col("trend"), F.expr(NUMBER)
    hw = trend.where(no % 3 != 0).select("series_key", "month", (v * 1.1).alias("hw"), v.alias("low"), (v * 1.2).alias("high"))
    ar = trend.where(no % 2 != 0).select("series_key", "month", (v * 0.9).alias("arima"), (v * 0.8).alias("arima_low"), (v * 1.3).alias("arima_high"))
    return fc.ensemble(hw, ar, trend)


@query("fc_ensemble", f"WITH {ENSEMBLE} SELECT * FROM ens", B)
def fc_ensemble(i: Inputs):
    return given_ensemble(i)


@query("fc_output", f"""WITH {ENSEMBLE}, c AS (SELECT e.*, tr.last, (first_value(value) OVER w - tr.last) / tr.last * 100 AS cf, (last_value(value) OVER w - tr.last) / tr.last * 100 AS cl
  FROM ens e JOIN tr USING (series_key) WINDOW w AS (PARTITION BY series_key ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT series_key, month, 'actual' AS part, y AS value, NULL AS low, NULL AS high, NULL AS direction, NULL AS change_first_pct, NULL AS change_last_pct, NULL AS intensity
FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY month DESC) AS rn FROM {B}) q WHERE rn <= 12
UNION ALL SELECT series_key, month, 'forecast', value, low, high, CASE WHEN value > last THEN 'alcista' ELSE 'bajista' END, cf, cl,
 CASE WHEN abs(cf) < 1 THEN 'levemente' WHEN abs(cf) < 5 THEN 'moderadamente' WHEN abs(cf) < 15 THEN 'significativamente' ELSE 'de forma pronunciada' END FROM c""", B)
def fc_output(i: Inputs):
    return fc.output(i(B), given_ensemble(i).drop("model"))


LISTED = " UNION ALL ".join(f"SELECT '{c}' AS series_key, fecha AS month, {c} AS y FROM m" for c in fv.FORECAST_SERIES)


@query("fc_series_list", f"""WITH m AS ({MATRIX}), s AS ({LISTED})
SELECT series_key, title, unit, transform, count(*) AS points, min(month) AS first_month, max(month) AS last_month
FROM s JOIN (VALUES {', '.join(f"('{k}', '{v[0]}', '{v[1]}', '{v[3]}')" for k, v in fv.FORECAST_SERIES.items())}) AS c(k, title, unit, transform) ON k = series_key
WHERE y IS NOT NULL GROUP BY 1, 2, 3, 4""", MATRIX_USES)
def fc_series_list(i: Inputs):
    from paramo.functions.ranks import long_form
    rows = long_form(matrix(i), list(fv.FORECAST_SERIES), ["fecha"], "series_key", "y").withColumnRenamed("fecha", "month")
    return fc.series_list(rows)
