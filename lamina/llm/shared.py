"""Session helpers: the shared folder, tables written there, and size checks.

Executors and the driver share only the folder in ``spark.checkpoint.dir``, so
every intermediate table goes there and is read back through Spark.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WS = " \t\n\x0b\f\r"  # the class [\x20\x09-\x0D]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_made: list[list[str]] = []  # paths of the open blocks of ``scratch``
LAST_ID = 9223372036854775807  # stands for a null id, which sorts after every other


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset a temporary one stands in,
    but only on a local master: elsewhere executors could not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lamina-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark)}/lamina-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of ``new_path`` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lamina_path = path
    if _made:
        _made[-1].append(path)
    return out


def release(*tables: DataFrame) -> None:
    """Delete the tables behind frames made by ``written``, which no later plan reads."""
    for df in tables:
        drop_path(df.sparkSession, df._lamina_path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables written in the block are deleted at its end; yields a function that spares one."""
    _made.append([])
    spared: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        spared.append(df._lamina_path)
        return df

    try:
        yield keep
    finally:
        for path in _made.pop():
            if path not in spared:
                drop_path(spark, path)
        if _made:
            _made[-1].extend(spared)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While an action runs, send few rows at once to Python: texts are long, and a batch
    is held by the JVM and by the worker at the same time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    return F.translate(col, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
