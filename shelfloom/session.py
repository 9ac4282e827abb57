"""Settings that the library needs of any session it is given."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def workers_find_library(spark: SparkSession) -> None:
    """Put this library's folder on the path of Python workers, wherever the driver runs."""
    own, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if own not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [own, env.get("PYTHONPATH", "")]))


def batches_by_size(spark: SparkSession, most: int = 1 << 22) -> None:
    """Arrow batches to Python of `most` bytes, or one row, rather than Spark's 64 MB, each of which a worker holds several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the cluster names; in a local session without one (tests), a fresh folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, where nothing is yet. What is written there goes when the driver ends."""
    parent = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(parent)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    system.deleteOnExit(folder)
    return f"{parent}/data"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later jobs neither recompute it nor depend on executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
