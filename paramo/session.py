"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "paramo", **conf) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, skew-join splitting)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="paramo-"))
    return configured or sc.getCheckpointDir()


def run_root(spark: SparkSession) -> str:
    """The run's own folder below the shared one; the file system removes it when the driver ends."""
    sc = spark.sparkContext
    root = f"{shared_root(spark).rstrip('/')}/run-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the run's folder; gone when the driver ends."""
    return f"{run_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and ends the recomputation chain."""
    shared_root(df.sparkSession)
    return df.checkpoint()


#: Whether Spark deletes the shuffle files of a query as soon as it has ended, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write the rows once as a table in the shared folder and read that: for inputs that several
    later passes scan column by column.  Like a checkpoint it survives executor loss; it lasts as long as the driver
    or until it is ``dropped``.  What was shuffled for it goes when it is written."""
    path, spark = shared_path(df.sparkSession, "table"), df.sparkSession
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote, and of nothing else; it must not be read again."""
    root = run_root(df.sparkSession)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("table-") and folder.rsplit("/", 2)[1] == root.rsplit("/", 1)[1]:
            remove(df.sparkSession, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours on whatever file system it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def staged(df: DataFrame):
    """Like ``materialise``, for a table that is needed within a block only: a load that runs for ever leaves nothing behind."""
    path = shared_path(df.sparkSession, "stage")
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove(df.sparkSession, path)


def fan_out(spark: SparkSession) -> int:
    """How many pieces a large ordered set is cut into: the session's shuffle width."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
