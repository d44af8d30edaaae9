"""Box arithmetic over ``array<double>`` (x0, y0, x1, y1) columns; corners may come in any order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(b: Column, i: int) -> Column:
    a, o = b[i], b[(i + 2) % 4]
    return F.least(a, o) if i < 2 else F.greatest(a, o)


def width(b: Column) -> Column:
    return _c(b, 2) - _c(b, 0)


def height(b: Column) -> Column:
    return _c(b, 3) - _c(b, 1)


def area(b: Column) -> Column:
    return width(b) * height(b)


def aspect(b: Column) -> Column:
    return F.when(height(b) > 0, width(b) / height(b)).otherwise(0.0)


def center(b: Column) -> tuple[Column, Column]:
    return (_c(b, 0) + _c(b, 2)) / 2, (_c(b, 1) + _c(b, 3)) / 2


def h_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(_c(a, 2), _c(b, 2)) - F.greatest(_c(a, 0), _c(b, 0)))


def v_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(_c(a, 3), _c(b, 3)) - F.greatest(_c(a, 1), _c(b, 1)))


def intersection(a: Column, b: Column) -> Column:
    return h_overlap(a, b) * v_overlap(a, b)


def iou(a: Column, b: Column) -> Column:
    i = intersection(a, b)
    return F.when(i > 0, i / (area(a) + area(b) - i)).otherwise(0.0)


def track_ratio(a: Column, b: Column) -> Column:
    """Overlap of two column tracks, by the wider one."""
    w = F.greatest(width(a), width(b))
    return F.when(w > 0, h_overlap(a, b) / w).otherwise(0.0)


def contains(a: Column, b: Column) -> Column:
    return (_c(a, 0) <= _c(b, 0)) & (_c(a, 1) <= _c(b, 1)) & (_c(a, 2) >= _c(b, 2)) & (_c(a, 3) >= _c(b, 3))


def union(a: Column, b: Column) -> Column:
    return F.array(F.least(_c(a, 0), _c(b, 0)), F.least(_c(a, 1), _c(b, 1)), F.greatest(_c(a, 2), _c(b, 2)), F.greatest(_c(a, 3), _c(b, 3)))


def distance(a: Column, b: Column) -> Column:
    """Distance of two boxes, 0 where they touch."""
    dx = F.greatest(F.lit(0.0), _c(b, 0) - _c(a, 2), _c(a, 0) - _c(b, 2))
    dy = F.greatest(F.lit(0.0), _c(b, 1) - _c(a, 3), _c(a, 1) - _c(b, 3))
    return F.sqrt(dx * dx + dy * dy)


def normalized(b: Column, page_width: float, page_height: float) -> Column:
    """Box in shares of the page, four digits."""
    return F.array(*[F.round(_c(b, i) / (page_width if i % 2 == 0 else page_height), 4) for i in range(4)])
