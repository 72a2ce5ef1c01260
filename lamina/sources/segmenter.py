"""The place of a neural segmenter: boxes of a slice in, labelled voxels out.

Detectors and segmenters are models with weights of their own and not part of this
library. ``segment`` runs any ``Segmenter`` over the slices that have no output yet.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.model import VOXEL


class Segmenter(Protocol):
    def __call__(self, z: int, boxes: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """Labels (H, W) of a slice for its boxes (n, 4) of x0, y0, x1, y1."""


class PaintBoxes:
    """A stand-in for tests: an ellipse in each box, later boxes on top."""

    def __call__(self, z: int, boxes: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        out = np.zeros(shape, np.int64)
        y, x = np.mgrid[: shape[0], : shape[1]]
        for k, (x0, y0, x1, y1) in enumerate(boxes, 1):
            ry, rx = max(1, y1 - y0) / 2, max(1, x1 - x0) / 2
            out[((y + 0.5 - y0 - ry) / ry) ** 2 + ((x + 0.5 - x0 - rx) / rx) ** 2 <= 1] = k
        return out


def segment(boxes: DataFrame, model: Segmenter, shape: tuple[int, int], *, done: DataFrame | None = None, volume: int = 0) -> DataFrame:
    """Voxels of the slices of ``boxes`` that ``done(z)`` doesn't list; slices run in parallel.

    Slices without boxes are empty, so they have no rows.
    """
    todo = boxes if done is None else boxes.join(done.select("z").distinct(), "z", "left_anti")

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        image = model(int(key[0]), rows[["x0", "y0", "x1", "y1"]].to_numpy(), shape)
        y, x = np.nonzero(image)
        return pd.DataFrame({"volume": volume, "z": key[0], "y": y.astype(np.int32), "x": x.astype(np.int32), "id": image[y, x].astype(np.int64)})

    return todo.select(F.col("z").cast("int").alias("z"), "ord", "x0", "y0", "x1", "y1").groupBy("z").applyInPandas(one, VOXEL)
