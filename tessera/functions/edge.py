"""Segments as columns x1, y1, x2, y2."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.rect import Rect, corners, from_corners, has_point


class Edge(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def edge(prefix: str = "") -> Edge:
    return Edge(*[F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")])


def valid(e: Edge) -> Column:
    return (e.x1 != e.x2) | (e.y1 != e.y2)


def length(e: Edge) -> Column:
    return F.sqrt((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1))


def centroid(e: Edge) -> tuple[Column, Column]:
    return (e.x1 + e.x2) / 2, (e.y1 + e.y2) / 2


def bbox(e: Edge) -> Rect:
    return from_corners(*e)


def reverse(e: Edge) -> Edge:
    return Edge(e.x2, e.y2, e.x1, e.y1)


def extend(e: Edge, front: float = 0.0, back: float = 0.0) -> Edge:
    """Longer by front before the start and by back after the end."""
    n = length(e)
    ux, uy = (e.x2 - e.x1) / n, (e.y2 - e.y1) / n
    return Edge(e.x1 - ux * front, e.y1 - uy * front, e.x2 + ux * back, e.y2 + uy * back)


def scale(e: Edge, factor: float) -> Edge:
    """About the midpoint."""
    cx, cy = centroid(e)
    return Edge(cx + (e.x1 - cx) * factor, cy + (e.y1 - cy) * factor, cx + (e.x2 - cx) * factor, cy + (e.y2 - cy) * factor)


def _along(e: Edge, x: Column, y: Column) -> tuple[Column, Column, Column]:
    """The share of the edge up to its closest point, and the edge's step."""
    dx, dy = e.x2 - e.x1, e.y2 - e.y1
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e.x1) * dx + (y - e.y1) * dy) / (dx * dx + dy * dy))), dx, dy


def closest(e: Edge, x: Column, y: Column) -> tuple[Column, Column]:
    t, dx, dy = _along(e, x, y)
    return e.x1 + t * dx, e.y1 + t * dy


def distance(e: Edge, x: Column, y: Column) -> Column:
    """Differences from the edge's start: a closest point of its own, rounded at its own size, would lose shapes that touch."""
    t, dx, dy = _along(e, x, y)
    gx, gy = x - e.x1 - t * dx, y - e.y1 - t * dy
    return F.sqrt(gx * gx + gy * gy)


def _cross(a: Edge, b: Edge) -> tuple[Column, Column, Column]:
    """(denominator, and the places along a and b times it)."""
    ax, ay, bx, by = a.x2 - a.x1, a.y2 - a.y1, b.x2 - b.x1, b.y2 - b.y1
    sx, sy = b.x1 - a.x1, b.y1 - a.y1
    return ax * by - ay * bx, sx * by - sy * bx, sx * ay - sy * ax


def collides(a: Edge, b: Edge) -> Column:
    """Proper or touching; parallel segments never do, even on one line."""
    d, t, u = _cross(a, b)
    return (d != 0) & (F.when(d > 0, t).otherwise(-t).between(F.lit(0.0), F.abs(d))) & (F.when(d > 0, u).otherwise(-u).between(F.lit(0.0), F.abs(d)))


def meeting(a: Edge, b: Edge) -> tuple[Column, Column]:
    """Where they collide; null elsewhere."""
    d, t, _ = _cross(a, b)
    hit = collides(a, b)
    s = t / F.when(d != 0, d)
    return F.when(hit, a.x1 + s * (a.x2 - a.x1)), F.when(hit, a.y1 + s * (a.y2 - a.y1))


def hits_rect(e: Edge, r: Rect) -> Column:
    """An endpoint inside, or the boxes overlap and the corners aren't all on one side."""
    box = from_corners(*e)
    near = (box.x0 <= r.x1) & (r.x0 <= box.x1) & (box.y0 <= r.y1) & (r.y0 <= box.y1)
    side = F.transform(corners(r), lambda p: (e.x2 - e.x1) * (p["y"] - e.y1) - (e.y2 - e.y1) * (p["x"] - e.x1))
    apart = (F.array_min(side) > 0) | (F.array_max(side) < 0)
    return near & (has_point(r, e.x1, e.y1) | has_point(r, e.x2, e.y2) | ~apart)
