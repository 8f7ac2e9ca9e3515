"""SparkSession factory, and tables in the shared folder that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "loam", cores: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session with the settings the plans assume (UTC, AQE, Arrow)."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOAM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary one, and any other is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: state between stages needs a folder that all executors share")
        at = tempfile.mkdtemp(prefix="loam-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def _files(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends, or with removed()."""
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, path = _files(spark, at)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def removed(spark: SparkSession, at: str) -> None:
    fs, path = _files(spark, at)
    fs.delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: the files survive lost executors and cut the lineage.

    The files go when the driver ends, or with discard() where nothing reads them any more.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    fs, path = _files(spark, at)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later action reads."""
    for t in tables:
        fs, path = _files(t.sparkSession, t.written_at)
        fs.delete(path, True)
