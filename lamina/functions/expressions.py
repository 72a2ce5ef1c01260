"""Scalar expressions over boxes, counts and edges; all stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# IoU thresholds of the sweep.
THRESHOLDS = [round(0.10 + 0.05 * k, 2) for k in range(17)]


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def corners(xc: Column, yc: Column, w: Column, h: Column, size: int) -> list[Column]:
    """Pixel corners x0, y0, x1, y1 of a normalised centre box; truncated, clipped to the image."""
    side = float(size)
    low = lambda c, d: F.greatest(F.lit(0), (c * side - d * side / 2.0).cast("int"))
    high = lambda c, d: F.least(F.lit(size), (c * side + d * side / 2.0).cast("int"))
    return [low(xc, w).alias("x0"), low(yc, h).alias("y0"), high(xc, w).alias("x1"), high(yc, h).alias("y1")]


def swap_axes(box: Sequence[Column]) -> list[Column]:
    """(row, column) corners to (x, y) corners and back."""
    return [box[1], box[0], box[3], box[2]]


def _overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    side = lambda i: F.greatest(F.lit(0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    return (side(0) * side(1)).cast("double")


def _size(a: Sequence[Column]) -> Column:
    return (F.greatest(F.lit(0), a[2] - a[0]) * F.greatest(F.lit(0), a[3] - a[1])).cast("double")


def box_iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """With a small constant below the line; disjoint boxes give 0."""
    inter = _overlap(a, b)
    return F.when(inter > 0, inter / (_size(a) + _size(b) - inter + F.lit(1e-9))).otherwise(0.0)


def bbox_iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Without the constant; an empty union gives 0."""
    inter = _overlap(a, b)
    return ratio(inter, _size(a) + _size(b) - inter)


def iou(inter: Column, a: Column, b: Column) -> Column:
    return ratio(inter, a + b - inter)


def dice(inter: Column, a: Column, b: Column) -> Column:
    return ratio(2 * inter, a + b)


def edge_features(overlap: Column, a0: Column, a1: Column, y0: Column, x0: Column, y1: Column, x1: Column) -> list[Column]:
    """The classifier's features, in its order; offsets are target minus source."""
    dy, dx = y1 - y0, x1 - x0
    return [
        overlap.cast("long").alias("overlap_px"), (overlap.cast("double") / (a0 + a1 - overlap)).alias("IoU"), a0.alias("area_src"), a1.alias("area_tgt"),
        (F.least(a0, a1).cast("double") / F.greatest(a0, a1)).alias("area_ratio"), dy.alias("dy"), dx.alias("dx"), F.hypot(dy, dx).alias("d_centroid"),
    ]


def pair_score(iou_dil: Column, contact: Column, dmin: Column, gap: Column, r: float) -> Column:
    """How well two touching pieces belong together; a null gap costs nothing."""
    return 0.2 * iou_dil + 0.8 * contact + 0.5 * F.exp(-dmin / 2.0) - 0.25 * F.coalesce(gap / (r + 1e-6), F.lit(0.0))


def confusion(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {"dice": ratio(2 * tp, 2 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn), "prec": ratio(tp, tp + fp), "rec": ratio(tp, tp + fn)}


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")


def natural_key(name: Column) -> Column:
    """Digits padded, so that text order is natural order."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")
