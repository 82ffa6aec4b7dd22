"""Boxes in points, origin top left. A box is four columns in the order x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", names: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> Box:
    return tuple(F.col(f"{prefix}{n}") for n in names)  # type: ignore[return-value]


def field_box(struct: Column) -> Box:
    return tuple(struct[n] for n in ("x0", "y0", "x1", "y1"))  # type: ignore[return-value]


def width(b: Box) -> Column:
    return b[2] - b[0]


def height(b: Box) -> Column:
    return b[3] - b[1]


def area(b: Box) -> Column:
    """Zero for a box with a negative side."""
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def is_straight_line(b: Box, thickness: float = 3.0) -> Column:
    return F.least(width(b), height(b)) <= thickness


def shared(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share; negative where they are apart."""
    return F.least(a1, b1) - F.greatest(a0, b0)


def overlap_area(a: Box, b: Box) -> Column:
    dx, dy = shared(a[0], a[2], b[0], b[2]), shared(a[1], a[3], b[1], b[3])
    return F.when((dx > 0) & (dy > 0), dx * dy).otherwise(0.0)


def containment(inner: Box, outer: Box) -> Column:
    """The share of ``inner``'s area inside ``outer``; 0 where it has none."""
    size = width(inner) * height(inner)
    return F.when(size > 0, overlap_area(inner, outer) / size).otherwise(0.0)


def gap(a: Box, b: Box) -> Column:
    """The larger of the two axes' distances, 0 for boxes that touch."""
    dx = F.greatest(b[0] - a[2], a[0] - b[2], F.lit(0.0))
    dy = F.greatest(b[1] - a[3], a[1] - b[3], F.lit(0.0))
    return F.greatest(dx, dy)


def x_overlap_ratio(a: Box, b: Box) -> Column:
    """Shared width by the narrower width; 0 where a box has none."""
    narrow = F.least(width(a), width(b))
    return F.when(narrow > 0, shared(a[0], a[2], b[0], b[2]) / narrow).otherwise(0.0)


def column_of(x: Column, edges: Column) -> Column:
    """The index of the half-open column that x lies in. ``edges`` holds all borders in
    order, the page's own included; past the last one is the last column, and so is
    anything before the first."""
    n = F.size(edges) - 1
    inside = F.size(F.filter(edges, lambda e: e <= x)) - 1
    return F.when((inside < 0) | (inside >= n), n - 1).otherwise(inside).cast("int")


def crosses_columns(b: Box, edges: Column) -> Column:
    return column_of(b[0] + 1.0, edges) != column_of(F.greatest(b[2] - 1.0, b[0]), edges)


def scale(dpi: Column) -> Column:
    """Pixels per point."""
    return dpi / F.lit(72.0)
