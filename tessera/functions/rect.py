"""Rectangles as four double columns, in a struct or apart. Touching counts as colliding."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rect(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column


def rect(prefix: str = "") -> Rect:
    return Rect(*[F.col(f"{prefix}{c}") for c in ("x_min", "y_min", "x_max", "y_max")])


def width(r: Rect) -> Column:
    return r.x1 - r.x0


def height(r: Rect) -> Column:
    return r.y1 - r.y0


def area(r: Rect) -> Column:
    return width(r) * height(r)


def diameter(r: Rect) -> Column:
    return F.sqrt(width(r) * width(r) + height(r) * height(r))


def centroid(r: Rect) -> tuple[Column, Column]:
    return (r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2


def valid(r: Rect) -> Column:
    return (r.x0 < r.x1) & (r.y0 < r.y1)


def from_corners(xa: Column, ya: Column, xb: Column, yb: Column) -> Rect:
    return Rect(F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb))


def overlaps(a: Rect, b: Rect, tolerance: float = 0.0) -> Column:
    return (a.x0 <= b.x1 + tolerance) & (b.x0 <= a.x1 + tolerance) & (a.y0 <= b.y1 + tolerance) & (b.y0 <= a.y1 + tolerance)


def contains(a: Rect, b: Rect, tolerance: float = 0.0) -> Column:
    return (a.x0 <= b.x0 + tolerance) & (a.y0 <= b.y0 + tolerance) & (a.x1 + tolerance >= b.x1) & (a.y1 + tolerance >= b.y1)


def has_point(r: Rect, x: Column, y: Column) -> Column:
    return x.between(r.x0, r.x1) & y.between(r.y0, r.y1)


def relation(a: Rect, b: Rect, tolerance: float = 0.0) -> Column:
    """Of a to b; equal rectangles surround each other."""
    return F.when(~overlaps(a, b, tolerance), "Disjoint").when(contains(a, b, tolerance), "Surrounding").when(contains(b, a, tolerance), "Enclosed").otherwise("Intersecting")


def intersection(a: Rect, b: Rect) -> Rect:
    return Rect(F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1))


def overlap_area(a: Rect, b: Rect) -> Column:
    """Null where the interiors don't meet."""
    i = intersection(a, b)
    return F.when(valid(i), area(i))


def bounding(a: Rect, b: Rect) -> Rect:
    return Rect(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def resized(r: Rect, by: Column | float) -> Rect:
    """Each side moved outwards by `by`; test valid() for one that inverts."""
    return Rect(r.x0 - by, r.y0 - by, r.x1 + by, r.y1 + by)


def scaled(r: Rect, factor: float) -> Rect:
    (cx, cy), w, h = centroid(r), width(r) * factor / 2, height(r) * factor / 2
    return Rect(cx - w, cy - h, cx + w, cy + h)


def squared(r: Rect) -> Rect:
    """The square around the same centre."""
    (cx, cy), half = centroid(r), F.greatest(width(r), height(r)) / 2
    return Rect(cx - half, cy - half, cx + half, cy + half)


def corners(r: Rect) -> Column:
    """Counter-clockwise from the upper right, as the quadrants of a plane are numbered."""
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((r.x1, r.y1), (r.x0, r.y1), (r.x0, r.y0), (r.x1, r.y0))])


def quadrants(r: Rect) -> Column:
    cx, cy = centroid(r)
    parts = [from_corners(x, y, cx, cy) for x, y in ((r.x1, r.y1), (r.x0, r.y1), (r.x0, r.y0), (r.x1, r.y0))]
    return F.array(*[F.struct(p.x0.alias("x_min"), p.y0.alias("y_min"), p.x1.alias("x_max"), p.y1.alias("y_max")) for p in parts])


def distance(r: Rect, x: Column, y: Column) -> Column:
    dx, dy = F.greatest(r.x0 - x, x - r.x1, F.lit(0.0)), F.greatest(r.y0 - y, y - r.y1, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def separation(r: Rect, x: Column, y: Column) -> tuple[Column, Column]:
    """(Interior or Exterior, distance to the boundary)."""
    inside = has_point(r, x, y)
    depth = F.least(x - r.x0, r.x1 - x, y - r.y0, r.y1 - y)
    return F.when(inside, "Interior").otherwise("Exterior"), F.when(inside, depth).otherwise(distance(r, x, y))
