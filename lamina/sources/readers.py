"""Reading slices, stacks, boxes and probabilities into relations, and writing them.

Files come through Spark's ``binaryFile`` and ``text`` sources, so any store will do.
Storage of our own is Parquet: ``write_table`` partitions by volume and sorts by z and y,
so that a filter on either prunes files and row groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions.expressions import corners, file_stem, natural_key
from lamina.model import META, VOXEL
from lamina.session import small
from lamina.sources import codecs

SIDECAR = "._"


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(name, content) of the files, without the side files of some systems; fails if there are none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    out = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").filter(~F.col("name").startswith(SIDECAR))
    if not out.select("name").limit(1).count():
        raise FileNotFoundError(f"no {pattern} files in {path}")
    return out


def slice_order(names: DataFrame) -> DataFrame:
    """(name, z): slices in natural order of their names. One row a slice."""
    return names.select("name").withColumn("z", (F.row_number().over(Window.orderBy(natural_key(F.col("name")), "name")) - 1).cast("int"))


def decode(data: bytes) -> np.ndarray:
    """A stack (pages, H, W) from PNG, TIFF, npy or npz bytes; the first channel only."""
    if data[:8] == codecs.PNG_MAGIC:
        image = codecs.read_png(data)
        return (image if image.ndim == 2 else image[..., 0])[None]
    if data[:2] in (b"II", b"MM"):
        return codecs.read_tiff(data)
    image = codecs.read_array(data)
    return image[None] if image.ndim == 2 else image[..., 0] if image.ndim == 4 and image.shape[-1] == 1 else image


def _sparse(decoder: Callable[[bytes], np.ndarray], volume: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for z, data in zip(batch["z"], batch["content"], strict=True):
                for k, image in enumerate(decoder(data)):
                    y, x = np.nonzero(image)
                    yield pd.DataFrame({"volume": volume, "z": np.int32(z + k), "y": y.astype(np.int32), "x": x.astype(np.int32), "id": image[y, x].astype(np.int64)})

    return run


def read_volume(spark: SparkSession, path: str, *, pattern: str = "*.png", volume: int = 0, decoder: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """Voxels of a folder of slices, or of one stack file; background rows are left out."""
    found = files(spark, path, pattern)
    ordered = found.join(small(slice_order(found)), "name")  # one row a slice
    return ordered.select("z", "content").mapInPandas(_sparse(decoder, volume), VOXEL)


def read_shape(spark: SparkSession, path: str, *, pattern: str = "*.tif", volume: int = 0) -> DataFrame:
    """The shape of TIFF stacks from their headers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                yield pd.DataFrame([(volume, *codecs.tiff_shape(data))], columns=["volume", "nz", "ny", "nx"])

    return files(spark, path, pattern).select("content").mapInPandas(run, META)


def load_volume(spark: SparkSession, volume: DataFrame | str, **options) -> DataFrame:
    """A frame of voxels as it is; a Parquet table or a folder by its path."""
    if isinstance(volume, DataFrame):
        return volume
    return read_volume(spark, volume, **options) if options else spark.read.parquet(volume)


def read_yolo(spark: SparkSession, path: str, *, image_size: int = 1024, suffix: str = ".png") -> tuple[DataFrame, DataFrame]:
    """(boxes, rejected): boxes of ``class x y w h conf`` lines by image, and skipped lines by image.

    Lines with fewer than six fields are skipped; an image with an empty file has no boxes.
    Boxes keep the order of their lines.
    """
    raw = spark.read.option("wholetext", True).text(path, pathGlobFilter="*.txt")
    named = raw.select(F.concat(file_stem(F.col("_metadata.file_name")), F.lit(suffix)).alias("image_name"), F.posexplode(F.split("value", "\\r?\\n")).alias("line", "said"))
    parts = named.withColumn("f", F.split(F.trim(F.regexp_replace("said", "\\s+", " ")), " ")).filter(F.trim("said") != "")
    good = parts.filter(F.size("f") >= 6)
    number = lambda k: F.col("f")[k].cast("double")
    boxes = good.select("image_name", (F.row_number().over(Window.partitionBy("image_name").orderBy("line")) - 1).alias("ord"), *corners(number(1), number(2), number(3), number(4), image_size))
    rejected = parts.groupBy("image_name").agg(F.count_if(F.size("f") < 6).alias("rejected"))
    return boxes, rejected


def yolo_images(spark: SparkSession, path: str, *, suffix: str = ".png") -> DataFrame:
    """(image_name): the images that have a file of boxes, be it empty."""
    # Spark's sources skip empty files, so the names come from the folder; one a slice
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = [f.getPath().getName() for f in found]
    rows = [(n.removesuffix(".txt") + suffix,) for n in names if n.endswith(".txt") and not n.startswith(SIDECAR)]
    return spark.createDataFrame(rows, "image_name string")


def boxes_by_slice(boxes: DataFrame, names: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Boxes with the z of their image.

    Boxes of an image that isn't in ``names(image_name, z)`` fail, and so does an image
    without an entry: one that is neither in ``listed(image_name)`` (those with a file of
    boxes) nor, without ``listed``, has a box. So lists of images and boxes can't slip apart.
    """
    lacking = names.join(boxes if listed is None else listed, "image_name", "left_anti").select("image_name").limit(1).collect()
    strange = boxes.join(names, "image_name", "left_anti").select("image_name").limit(1).collect()
    if strange:
        raise KeyError(f"boxes for {strange[0][0]}, which isn't an image of the stack")
    if lacking:
        raise KeyError(f"no entry of boxes for {lacking[0][0]}")
    return boxes.join(small(names), "image_name").select("image_name", "z", "ord", "x0", "y0", "x1", "y1")


def read_probabilities(spark: SparkSession, path: str, *, channel: int = 1, volume: int = 0, above: float | None = None) -> DataFrame:
    """(volume, z, y, x, p) of npz slices (classes, 1, H, W), in the order of their names.

    ``above`` leaves out rows at or below it, which is all that refinement needs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for z, data in zip(batch["z"], batch["content"], strict=True):
                p = np.squeeze(codecs.read_array(data)[channel]).astype(np.float32)
                y, x = np.nonzero(p > above if above is not None else np.ones(p.shape, bool))
                yield pd.DataFrame({"volume": volume, "z": np.int32(z), "y": y.astype(np.int32), "x": x.astype(np.int32), "p": p[y, x]})

    found = files(spark, path, "*.npz")
    number = (F.row_number().over(Window.orderBy("name")) - 1).cast("int")
    ordered = found.join(small(found.select("name").withColumn("z", number)), "name")  # one row a slice
    return ordered.select("z", "content").mapInPandas(run, "volume long, z int, y int, x int, p float")


def probability_stats(prob: DataFrame, shape: DataFrame) -> DataFrame:
    """low, high, mean over all voxels of ``shape``; rows that aren't stored count as 0."""
    stored = prob.groupBy("volume").agg(F.min("p").alias("_lo"), F.max("p").alias("high"), F.sum("p").alias("_s"), F.count("*").alias("_n"))
    all_ = F.col("nz").cast("long") * F.col("ny") * F.col("nx")
    return stored.join(shape, "volume").select("volume", F.when(F.col("_n") < all_, F.least("_lo", F.lit(0.0))).otherwise(F.col("_lo")).alias("low"), "high", (F.col("_s") / all_).alias("mean"))


def write_table(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Parquet by volume, sorted by z and y inside each file."""
    by = [c for c in ("z", "y") if c in df.columns]
    df.repartition("volume", *by[:1]).sortWithinPartitions("volume", *by).write.mode(mode).option("compression", "zstd").partitionBy("volume").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """An edge table from CSV; columns go by name and have fixed types."""
    doubles = {"IoU", "area_ratio", "dy", "dx", "d_centroid", "p_link"}
    ints = {"z", "dz", "c_src", "c_tgt", "label_same"}
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(c).cast("double").cast("double" if c in doubles else "int" if c in ints else "long").alias(c) for c in raw.columns])


def encode_slices(voxels: DataFrame, shape: tuple[int, int], kind: str = "png") -> DataFrame:
    """(volume, z, content): every slice that holds a voxel as PNG or TIFF bytes."""
    if kind not in ("png", "tif"):
        raise ValueError("kind can be 'png' or 'tif'")

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros(shape, np.uint16 if kind == "png" else np.uint32)
        if kind == "png" and rows["id"].max() > 65_535:
            raise ValueError(f"slice {key[1]} holds an id above 65535")
        image[rows["y"], rows["x"]] = rows["id"]
        return pd.DataFrame({"volume": [key[0]], "z": [key[1]], "content": [codecs.write_png(image) if kind == "png" else codecs.write_tiff(image[None], True)]})

    return voxels.groupBy("volume", "z").applyInPandas(one, "volume long, z int, content binary")


@contextmanager
def _sink(spark: SparkSession, path: str):
    """A function that appends bytes to a new file of any store that Spark writes to."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        yield lambda data: out.write(bytearray(data))
    finally:
        out.close()


def write_slices(voxels: DataFrame, shape: tuple[int, int], path: str, *, kind: str = "png", depth: int | None = None) -> int:
    """One file a slice and volume, named by number; empty slices are written up to ``depth``.

    Slices are encoded in parallel and pass through the driver one at a time, since files
    with names of their own have no writer in Spark. Returns the number of files.
    """
    spark, n, seen = voxels.sparkSession, 0, set()
    for volume, z, content in encode_slices(voxels, shape, kind).orderBy("volume", "z").toLocalIterator():
        with _sink(spark, f"{path}/{volume}/{z:05d}.{kind}") as put:
            put(bytes(content))
        seen.add((volume, z))
        n += 1
    blank = np.zeros(shape, np.uint16 if kind == "png" else np.uint32)
    empty = codecs.write_png(blank) if kind == "png" else codecs.write_tiff(blank[None], True)
    for volume in {v for v, _ in seen}:
        for z in range(depth or 0):
            if (volume, z) not in seen:
                with _sink(spark, f"{path}/{volume}/{z:05d}.{kind}") as put:
                    put(empty)
                n += 1
    return n


def write_stack(voxels: DataFrame, shape: tuple[int, int, int], path: str, *, big: bool | None = None) -> None:
    """One volume as a TIFF stack of 32-bit ids, page by page; BigTIFF where 4 GB could be passed."""
    depth, *image = shape
    big = depth * image[0] * image[1] * 4 > 0xF0000000 if big is None else big
    rows = voxels.groupBy("z").agg(F.sort_array(F.collect_list(F.struct("y", "x", "id"))).alias("p")).orderBy("z").toLocalIterator()  # one slice at a time

    def pages() -> Iterator[np.ndarray]:
        at = next(rows, None)
        for z in range(depth):
            page = np.zeros(image, np.uint32)
            if at is not None and at["z"] == z:
                y, x, ids = zip(*at["p"], strict=True)
                page[list(y), list(x)] = ids
                at = next(rows, None)
            yield page

    with _sink(voxels.sparkSession, path) as put:
        for part in codecs.tiff_stream(pages(), depth, True, big):
            put(part)


def load_prediction(spark: SparkSession, prediction: DataFrame | str, shape: tuple[int, int, int], target: tuple[int, int, int], **options) -> DataFrame:
    """A prediction of ``shape`` (nz, ny, nx) for a ground truth of ``target``.

    Another number of slices fails; slices of another size are resized, nearest by the
    floor rule.
    """
    from lamina.operators.resample import resize_slices

    if shape[0] != target[0]:
        raise ValueError(f"the prediction has {shape[0]} slices, the ground truth {target[0]}")
    voxels = load_volume(spark, prediction, **options)
    return voxels if shape[1:] == target[1:] else resize_slices(voxels, shape[1:], target[1:], "floor")
