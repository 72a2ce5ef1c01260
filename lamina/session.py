"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset a temporary one stands in,
    but only on a local master: elsewhere executors could not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lamina-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in ``spark.checkpoint.dir`` and read it back.

    A table drops the plan's constraints too, which grow from round to round in a loop.
    It goes when the session ends, or earlier by ``free``. A table of ``cut`` is given back as it is.
    """
    if getattr(df, "_lamina_path", None):
        return df
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lamina-cut-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lamina_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that no later plan reads."""
    for df in tables:
        target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._lamina_path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Broadcast a side of few rows; beyond ``limit`` Spark chooses the join."""
    return F.broadcast(df) if df.count() <= limit else df
