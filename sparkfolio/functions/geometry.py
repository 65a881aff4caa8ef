"""Boxes and points as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The four columns of a box: x0, y0, x1, y1 after the prefix."""
    return tuple(F.col(f"{prefix}{k}") for k in ("x0", "y0", "x1", "y1"))


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def overlap(a: Box, b: Box) -> Column:
    """Area that both boxes cover."""
    w, h = (F.greatest(F.least(a[k + 2], b[k + 2]) - F.greatest(a[k], b[k]), F.lit(0.0)) for k in (0, 1))
    return w * h


def iou(a: Box, b: Box) -> Column:
    """Area of the intersection over that of the union; 0 where both are empty."""
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def vertical_overlap(a: Box, b: Box) -> Column:
    """Shared height over that of the lower box."""
    least = F.least(a[3] - a[1], b[3] - b[1])
    return F.when(least > 0, F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0)) / least).otherwise(F.lit(0.0))


def horizontal_overlap(a: Box, b: Box) -> Column:
    """Shared width over that of the narrower box."""
    least = F.least(a[2] - a[0], b[2] - b[0])
    return F.when(least > 0, F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) / least).otherwise(F.lit(0.0))


def bounds(prefix: str = "") -> list[Column]:
    """Aggregates of the box around all boxes."""
    b = box(prefix)
    return [F.min(b[0]).alias("x0"), F.min(b[1]).alias("y0"), F.max(b[2]).alias("x1"), F.max(b[3]).alias("y1")]


def quarter_turned(x: Column, y: Column, width: Column, height: Column, turns: Column) -> Column:
    """A point of a displayed page on the page before it was turned clockwise by so many quarters."""
    t = F.pmod(turns, F.lit(4))
    return (
        F.when(t == 0, F.struct(x.alias("x"), y.alias("y")))
        .when(t == 1, F.struct(y.alias("x"), (height - x).alias("y")))
        .when(t == 2, F.struct((width - x).alias("x"), (height - y).alias("y")))
        .otherwise(F.struct((width - y).alias("x"), x.alias("y")))
    )
