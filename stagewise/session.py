"""Session factory for local work; on a cluster pass the session you already have."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stagewise")
        .config("spark.driver.memory", os.environ.get("STAGEWISE_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; where that is unset, one of this machine, if all tasks run here."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("stagewise.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is unset: executors would write to folders that the driver cannot see")
        folder = tempfile.mkdtemp(prefix="stagewise-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("stagewise.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver's Python ends, since results are read from it until then."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(removed, spark, path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system, whichever it is; nothing happens if the JVM has ended before us."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except Exception:  # noqa: S110
        pass


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage at a table that survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
