"""Continuous versions of the load, the climate alerts and the outlier flags.

Sources and sinks are files, offsets and state live under the shared checkpoint folder, and each job
can be stopped and started again.  ``available_now`` drains what has arrived and ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paramo import fixed_values as fv
from paramo.session import remove
from paramo.sources import loading


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermark on a zoned timestamp (zone-less ones are rejected by the engine)."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def insert_ignore(stream: DataFrame, table: str, keys: Sequence[str], order: Sequence[str], checkpoint: str,
                  ts: str | None = None, delay: str | None = None, available_now: bool = True, name: str = "stream"):
    """Load the stream into a table of ``loading.create``, first row of a key wins.

    Each micro-batch is a load under its own id, so a batch that runs again replaces what it wrote before, rows
    with a null in the key included.  ``name`` tells the loads of several streams into one table apart.  With ``ts`` and
    ``delay`` a bounded state drops repeats before they reach the table; rows later than the delay are
    then dropped too, so the default keeps every row and lets the table decide.
    """
    if ts and delay:
        stream = event_time(stream, ts, delay).dropDuplicatesWithinWatermark(list(keys))

    def load(batch: DataFrame, number: int) -> None:
        loading.insert_once(batch.sparkSession, table, batch, keys, order, f"{name}-{number}")

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def climate_alerts(obs: DataFrame, ts: str = "ts", delay: str | None = None, width: str = "7 days", slide: str = "1 day",
                   by: Sequence[str] = ()) -> DataFrame:
    """Sliding mean, maximum and count per variable with the drought, flood and heat rules.

    State is one partial aggregate per window, variable and group.  Without a ``delay`` every window stays open and no row is too
    late; with one, windows close and rows later than that are dropped.
    """
    rows = (event_time(obs, ts, delay) if delay else obs.withColumn(ts, F.col(ts).cast("timestamp"))).groupBy(F.window(ts, width, slide), "variable", *by).agg(
        F.avg("value").alias("mean"), F.max("value").alias("top"), F.count("*").alias("n"))
    rain, temp = F.col("variable") == fv.RAIN, F.col("variable") == fv.TEMP
    alert = (F.when(rain & (F.col("mean") < fv.RAIN_LOW_MEAN) & (F.col("top") < fv.RAIN_LOW_MAX), "sequia")
             .when(rain & (F.col("mean") > fv.RAIN_HIGH_MEAN), "inundacion")
             .when(temp & (F.col("mean") > fv.TEMP_HIGH_MEAN), "calor"))
    return rows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                       "variable", *by, "mean", "top", "n", alert.alias("alert"))


def zscore_flags(obs: DataFrame, stats: DataFrame) -> DataFrame:
    """Each observation with its z-score and severity against fitted statistics.

    ``stats`` is a written table with one row per variable (feature, mean, std); Spark broadcasts it if it is small.
    An observation whose variable has no statistics stays, with a null z and severity.
    """
    known = stats.select(F.col("feature").alias("variable"), F.col("mean").alias("_m"), F.col("std").alias("_s"))
    z = (F.col("value") - F.col("_m")) / F.col("_s")
    size = F.abs("z")
    level = (F.when(size >= fv.Z_CRITICAL, "CRÍTICA").when(size >= fv.Z_HIGH, "ALTA").when(size >= fv.Z_MODERATE, "MODERADA").when(size.isNotNull(), "NORMAL"))
    return obs.join(known, "variable", "left").withColumn("z", z).withColumn("severity", level).drop("_m", "_s")


def to_files(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append the stream to a Parquet folder."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_version(path: str, batch: DataFrame, number: int, keys: Sequence[str], every: int) -> None:
    """Write a micro-batch as its version, and before every ``every``-th one make one version of all earlier ones.

    Those are of batches that are done and never run again.  The merged version has a name of its own, between the last
    it holds and the next, and is complete before the others go; a batch that runs again after a crash finds it complete, or
    all that it is made of.  So every group's newest row is there at any time."""
    spark = batch.sparkSession
    if keys and number and number % every == 0:
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = jvm_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(jvm_path(path))] if files.exists(jvm_path(path)) else []
        merged = f"version={number - 0.5}"
        earlier = [n for n in names if n.startswith("version=") and float(n.split("=")[1]) < number - 0.5]
        if earlier and not files.exists(jvm_path(f"{path}/{merged}/_SUCCESS")):
            rows = spark.read.option("basePath", path).parquet(*[f"{path}/{n}" for n in earlier])
            newest(rows, keys).write.mode("overwrite").parquet(f"{path}/{merged}")
        for n in earlier:
            remove(spark, f"{path}/{n}")
    batch.write.mode("overwrite").parquet(f"{path}/version={number}")


def upsert(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, keys: Sequence[str] = (), every: int = 20):
    """Keep every group of a streaming aggregate up to date, open windows included.

    Each micro-batch writes the groups it changed to a folder of its own, which a batch that runs again
    replaces; ``latest`` reads the newest version of each group.  With the ``keys`` of a group, all versions are merged into one
    every ``every`` batches, so there are never more than that many.
    """
    def write(batch: DataFrame, number: int) -> None:
        write_version(path, batch, number, keys, every)

    writer = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest version of each group that ``upsert`` has written."""
    return newest(spark.read.parquet(path), keys)


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "version")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_row")).select(*keys, "_row.*")
