"""Registered queries: streaming (S).  Each drains the events table as a file stream and reads the result back."""

from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.plans.catalog import Inputs, query
from paramo.session import cut_lineage, shared_path
from paramo.sources import loading
from paramo.streaming import streams as st


def event_stream(i: Inputs):
    # a glob matches the table whether it is one file or a folder of files
    return st.file_stream(i.spark, f"{i.sf_dir}/events.parque[t]", i("events").schema)


def observations(df):
    variable = (F.when(F.col("event_type") == "view", fv.RAIN).when(F.col("event_type") == "click", fv.TEMP)
                .when(F.col("event_type") == "purchase", "humedad_pct").when(F.col("event_type") == "signup", "viento_ms").otherwise("presion_hpa"))
    return df.select("event_id", F.col("user_id").alias("station"), "ts", variable.alias("variable"), "value")


KEYS = ["station", "variable", "day"]


@query("stream_insert_ignore", """SELECT event_id, station, variable, day, value FROM (
 SELECT obs_id AS event_id, station, variable, obs_date AS day, value, row_number() OVER (PARTITION BY station, variable, obs_date ORDER BY ts, obs_id) AS rn FROM b_sensor) q WHERE rn = 1""", "b_sensor")
def stream_insert_ignore(i: Inputs):
    rows = observations(event_stream(i)).withColumn("day", F.col("ts").cast("date"))
    table = shared_path(i.spark, "observations")
    loading.create(i.spark, table, rows.schema)
    st.insert_ignore(rows, table, KEYS, ["ts", "event_id"], shared_path(i.spark, "offsets")).awaitTermination()
    return loading.loaded(i.spark, table).drop("ts")


@query("stream_climate_alerts", """WITH w AS (SELECT date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS s, variable, value FROM b_sensor, (SELECT unnest(generate_series(0, 6)) AS k) q)
SELECT CAST(s AS DATE) AS window_start, variable, avg(value) AS mean, max(value) AS top, count(*) AS n,
 CASE WHEN variable = 'precipitacion_mm' AND avg(value) < 5 AND max(value) < 10 THEN 'sequia' WHEN variable = 'precipitacion_mm' AND avg(value) > 150 THEN 'inundacion'
  WHEN variable = 'temperatura_c' AND avg(value) > 30 THEN 'calor' END AS alert
FROM w GROUP BY 1, 2""", "b_sensor")
def stream_climate_alerts(i: Inputs):
    out = shared_path(i.spark, "alerts")
    st.upsert(st.climate_alerts(observations(event_stream(i))), out, shared_path(i.spark, "offsets"), keys=["window_start", "variable"]).awaitTermination()
    rows = st.latest(i.spark, out, ["window_start", "variable"])
    return rows.withColumn("window_start", F.col("window_start").cast("date")).drop("window_end")


@query("stream_zscore_flags", """WITH s AS (SELECT variable, avg(value) AS m, greatest(stddev_samp(value), 1e-6) AS d FROM b_sensor WHERE obs_date < DATE '2024-01-15' GROUP BY 1)
SELECT obs_id AS event_id, variable, value, (value - m) / d AS z, CASE WHEN abs((value - m) / d) >= 3 THEN 'CRÍTICA' WHEN abs((value - m) / d) >= 2.5 THEN 'ALTA'
 WHEN abs((value - m) / d) >= 2 THEN 'MODERADA' WHEN m IS NOT NULL THEN 'NORMAL' END AS severity FROM b_sensor LEFT JOIN s USING (variable)""", "b_sensor")
def stream_zscore_flags(i: Inputs):
    past = observations(i("events")).where("ts < timestamp_ntz '2024-01-15'")
    moments = past.groupBy(F.col("variable").alias("feature")).agg(F.avg("value").alias("mean"), F.greatest(F.stddev_samp("value"), F.lit(1e-6)).alias("std"))
    out = shared_path(i.spark, "flags")
    flags = st.zscore_flags(observations(event_stream(i)), cut_lineage(moments)).select("event_id", "variable", "value", "z", "severity")
    st.to_files(flags, out, shared_path(i.spark, "offsets")).awaitTermination()
    return i.spark.read.parquet(out)
