"""The workload's steps in order: segmentation loop, post-processing, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.model import to_runs, to_voxels
from lamina.operators import clean, evaluate, link, postproc, resample
from lamina.session import cut
from lamina.sources.segmenter import Segmenter, segment


def segmentation_loop(boxes: DataFrame, names: DataFrame | None, model: Segmenter, shape: tuple[int, int], *, iterations: int = 3, update_after=(1, 2), min_area: int = 500, min_score: float = 0.45, resume: list[DataFrame] | None = None, finished: list[DataFrame] | None = None, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cleaned runs, boxes) after the last iteration.

    Every iteration segments the boxes, cleans the slices and, after those in
    ``update_after``, adds boxes of objects that vanish. Iterations are cut in the
    shared folder. ``names(image_name, z)``: by default the images of the boxes in natural
    order. ``resume``: voxels of iterations that an earlier run finished in part; only
    their missing slices are segmented. ``finished(z)`` lists the finished slices of each
    of them, among which may be slices that came out empty; without it those with voxels.
    ``store``: a folder that keeps runs and boxes of each iteration as tables ``runs_1``,
    ``boxes_1`` and so on; iterations found there aren't run again.
    """
    spark, runs = boxes.sparkSession, None
    names = image_names(boxes) if names is None else names
    for i in range(1, iterations + 1):
        if store and _exists(spark, f"{store}/boxes_{i}/_SUCCESS"):
            runs, boxes = spark.read.parquet(f"{store}/runs_{i}"), spark.read.parquet(f"{store}/boxes_{i}")
            continue
        old = resume[i - 1] if resume and len(resume) >= i else None
        done = finished[i - 1] if finished and len(finished) >= i else old
        made = segment(boxes, model, shape, done=done)
        voxels = cut(made if old is None else made.unionByName(old))
        runs = cut(clean.clean_slices(to_runs(voxels), min_area=min_area, min_score=min_score))
        if i in update_after:
            boxes = cut(clean.update_boxes(boxes, to_voxels(runs), names, min_area=min_area))
        if store:
            runs.write.mode("overwrite").parquet(f"{store}/runs_{i}")
            boxes.write.mode("overwrite").parquet(f"{store}/boxes_{i}")
    return runs, boxes


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def postprocess(voxels: DataFrame, shape: tuple[int, int], *, target: int = 1024, cfg: postproc.Repair | None = None, min_area: int = 500, overlap: float = 0.95) -> dict[str, DataFrame]:
    """Downsample, repair from the side, merge and absorb, harmonize ids; all four results."""
    small = cut(resample.resize_slices(voxels, shape, (target, target)))
    fixed, log = postproc.repair(small, cfg)
    fixed = cut(fixed)
    merged = cut(postproc.merge_repaired(small, fixed, min_area))
    return {"downsampled": small, "repaired": fixed, "log": log, "merged": merged, "final": postproc.harmonize_ids(merged, overlap)}


def high_resolution(voxels: DataFrame, prob: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int], threshold: float = 0.98) -> DataFrame:
    """Instances at high resolution, grown by the confident regions that touch them."""
    return resample.refine(cut(resample.upscale_instances(voxels, low, high)), prob, threshold)


def link_and_score(runs: DataFrame, gt: DataFrame, *, trees: int = 400, depth: int = 30, split: str = "edge") -> tuple[DataFrame, DataFrame]:
    """(linked runs, summary): a forest trained on ``gt`` links ``runs``, which are then scored.

    ``split``: training edges are drawn by ``edge``, or by whole ``slice``.
    """
    from lamina.operators.overlap import training_edges, with_global_ids
    from lamina.operators.regions import slice_components

    train, _ = (link.slice_split if split == "slice" else link.stratified_split)(training_edges(with_global_ids(slice_components(gt))))
    _, linked = link.link_full(runs, link.train_forest(train, trees=trees, depth=depth))
    linked = cut(linked)
    return linked, evaluate.summary(gt, linked)


def image_names(boxes: DataFrame) -> DataFrame:
    """(image_name, z) in natural order of the names. One row an image."""
    from lamina.sources.readers import slice_order

    return slice_order(boxes.select(F.col("image_name").alias("name")).distinct()).withColumnRenamed("name", "image_name")
