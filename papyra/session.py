"""A session with the settings this package expects."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Used only on a local master whose session names no checkpoint folder.
LOCAL_FOLDER = "file:///tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where driver and executors are one process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or LOCAL_FOLDER).rstrip("/")


def session(master: str = "local[*]", partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans with skew handling; ``partitions`` is for small local runs only (AQE sizes larger ones)."""
    b = SparkSession.builder.master(master).appName("papyra")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def steady(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder (one of our own only where none is set)."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def removed(spark: SparkSession, *folders: str) -> None:
    """The folders go, and Spark may remove the shuffle files of finished steps."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def kept(df: DataFrame, *folders: str) -> DataFrame:
    """The rows as a checkpoint, so that the folders they were read from can go; these are removed."""
    rows = steady(df)
    removed(df.sparkSession, *folders)
    return rows


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as compressed files in the shared folder, and that folder, for ``removed``: what a round no longer needs can go, a checkpoint stays."""
    folder = fresh_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder
