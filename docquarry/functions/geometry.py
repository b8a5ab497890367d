"""Boxes [x1, y1, x2, y2] as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _area(b: Column) -> Column:
    return F.greatest((b[2] - b[0]) * (b[3] - b[1]), F.lit(1))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; areas are at least 1, disjoint boxes give 0."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(inter / (_area(a) + _area(b) - inter))


def centre_x(b: Column) -> Column:
    return (b[0] + b[2]) / 2


def centre_y(b: Column) -> Column:
    return (b[1] + b[3]) / 2


def in_region(b: Column, x1: int, y1: int, x2: int, y2: int) -> Column:
    """The centre lies in the region, edges included."""
    return centre_x(b).between(x1, x2) & centre_y(b).between(y1, y2)


def offset(b: Column, dx: Column | int, dy: Column | int) -> Column:
    return F.array(b[0] + dx, b[1] + dy, b[2] + dx, b[3] + dy)


def clamp(b: Column, width: Column | int, height: Column | int) -> Column:
    w, h = (x if isinstance(x, Column) else F.lit(x) for x in (width, height))
    return F.array(F.greatest(F.lit(0), b[0]), F.greatest(F.lit(0), b[1]), F.least(w, b[2]), F.least(h, b[3]))


def polygon_box(points: Column) -> Column:
    """Smallest box around an array of [x, y]."""
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def padded_union(boxes: Column, pad: int = 0) -> Column:
    """Box around an array of boxes, padded; the low side stays at 0 or above."""
    low = lambda k: F.greatest(F.array_min(F.transform(boxes, lambda b: b[k])) - pad, F.lit(0))
    high = lambda k: F.array_max(F.transform(boxes, lambda b: b[k])) + pad
    return F.array(low(0), low(1), high(2), high(3))


def denormalise(box: Column, width: Column, height: Column) -> Column:
    """[y0, x0, y1, x1] in thousandths to [x0, y0, x1, y1] in pixels, truncated; null unless four numbers."""
    scale = lambda v, size: (v / 1000 * size).cast("int")
    out = F.array(scale(box[1], width), scale(box[0], height), scale(box[3], width), scale(box[2], height))
    return F.when(F.size(box) == 4, out)


def model_size(width: Column, height: Column, longest: int) -> Column:
    """Size after capping the long side (rounded)."""
    scale = F.lit(longest) / F.greatest(width, height)
    small = F.greatest(width, height) <= longest
    size = lambda v: F.when(small, v).otherwise(F.greatest(F.lit(1), F.rint(v * scale).cast("int")))
    return F.struct(size(width).alias("w"), size(height).alias("h"))


def working_size(width: Column, height: Column, longest: int = 2048, shortest: int = 800) -> Column:
    """Size that brings the long side down to ``longest``, or else the short side up to ``shortest``; changes of less
    than one percent are left."""
    long, short = F.greatest(width, height), F.least(width, height)
    scale = F.when(long > longest, F.lit(longest) / long).when(short < shortest, F.lit(shortest) / short).otherwise(1.0)
    scale = F.when(F.abs(scale - 1) < 0.01, 1.0).otherwise(scale)
    size = lambda v: F.greatest(F.lit(1), F.floor(v * scale).cast("int"))
    return F.struct(size(width).alias("w"), size(height).alias("h"))
