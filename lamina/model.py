"""The data model: voxels, runs, boxes and edges as relations.

A label volume is a sparse table ``voxel(volume, z, y, x, id)`` without background, and
``volume_meta(volume, nz, ny, nx)`` gives its shape. ``run(volume, z, y, x0, x1, id)`` is
the compact form: maximal horizontal runs [x0, x1). Volumes are independent, so every
operator carries ``volume`` as its first key and many volumes run in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOXEL = "volume long, z int, y int, x int, id long"
RUN = "volume long, z int, y int, x0 int, x1 int, id long"
META = "volume long, nz int, ny int, nx int"
BOX = "image_name string, z int, ord int, x0 int, y0 int, x1 int, y1 int"
PLACE = ["volume", "z", "y", "x"]
# The order of the features that the edge classifier takes.
FEATURES = ["overlap_px", "IoU", "area_src", "area_tgt", "area_ratio", "dy", "dx", "d_centroid"]
EDGE = ["volume", "z", "dz", "c_src", "c_tgt", "gid_src", "gid_tgt", *FEATURES]
UINT16 = 65_535


def to_runs(voxels: DataFrame) -> DataFrame:
    """Gaps and islands along x: consecutive voxels of one id share ``x - row_number``."""
    line = Window.partitionBy("volume", "z", "y", "id").orderBy("x")
    marked = voxels.select(*PLACE, "id").withColumn("_k", F.col("x") - F.row_number().over(line))
    return marked.groupBy("volume", "z", "y", "id", "_k").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).select("volume", "z", "y", "x0", "x1", "id")


def as_runs(volume: DataFrame) -> DataFrame:
    """Runs of a volume given as runs or as voxels."""
    return volume if "x0" in volume.columns else to_runs(volume)


def to_voxels(runs: DataFrame) -> DataFrame:
    return runs.select("volume", "z", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), "id")


def area(runs: DataFrame, *keys: str) -> DataFrame:
    """Voxels of each group of runs."""
    return runs.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("n"))


def transposed(voxels: DataFrame) -> DataFrame:
    """The view from the side: x becomes the slice, z the row and y the column."""
    return voxels.select("volume", F.col("x").alias("z"), F.col("z").alias("y"), F.col("y").alias("x"), "id")


def untransposed(voxels: DataFrame) -> DataFrame:
    return voxels.select("volume", F.col("y").alias("z"), F.col("x").alias("y"), F.col("z").alias("x"), "id")


def check_ids(voxels: DataFrame, limit: int = UINT16) -> DataFrame:
    """Fail when an id doesn't fit an unsigned sink, instead of wrapping."""
    fits = F.col("id").between(1, limit)
    return voxels.withColumn("id", F.when(fits, F.col("id")).otherwise(F.raise_error(F.concat(F.lit(f"id out of 1..{limit}: "), F.col("id").cast("string"))).cast("long")))


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
