"""Circles as columns cx, cy, r. Touching counts as colliding."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import edge as E
from tessera.functions import rect as R


class Circle(NamedTuple):
    x: Column
    y: Column
    r: Column


def circle(prefix: str = "") -> Circle:
    return Circle(*[F.col(f"{prefix}{c}") for c in ("cx", "cy", "r")])


def area(c: Circle) -> Column:
    return c.r * c.r * math.pi


def bbox(c: Circle) -> R.Rect:
    return R.Rect(c.x - c.r, c.y - c.r, c.x + c.r, c.y + c.r)


def _square(a: Column) -> Column:
    return a * a


def hits_point(c: Circle, x: Column, y: Column) -> Column:
    return _square(c.x - x) + _square(c.y - y) <= _square(c.r)


def hits_circle(a: Circle, b: Circle) -> Column:
    return _square(a.x - b.x) + _square(a.y - b.y) <= _square(a.r + b.r)


def hits_edge(c: Circle, e: E.Edge) -> Column:
    return E.distance(e, c.x, c.y) <= c.r


def hits_rect(c: Circle, r: R.Rect) -> Column:
    return R.distance(r, c.x, c.y) <= c.r


def _signed(gap: Column) -> tuple[Column, Column]:
    return F.when(gap <= 0, "Interior").otherwise("Exterior"), F.abs(gap)


def separation_point(c: Circle, x: Column, y: Column) -> tuple[Column, Column]:
    return _signed(F.sqrt(_square(c.x - x) + _square(c.y - y)) - c.r)


def separation_circle(a: Circle, b: Circle) -> tuple[Column, Column]:
    return _signed(F.sqrt(_square(a.x - b.x) + _square(a.y - b.y)) - a.r - b.r)


def separation_edge(c: Circle, e: E.Edge) -> tuple[Column, Column]:
    return _signed(E.distance(e, c.x, c.y) - c.r)


def bounding(circles: Column) -> Column:
    """Fold over an array of struct(cx, cy, r), in its order: each circle not yet inside widens the last one just enough."""
    first = circles[0]

    def widen(a: Column, b: Column) -> Column:
        dx, dy = b["cx"] - a["cx"], b["cy"] - a["cy"]
        d = F.sqrt(dx * dx + dy * dy)
        grown = (d + a["r"] + b["r"]) / 2
        part = F.when(d > 0, (grown - a["r"]) / d).otherwise(F.lit(0.0))
        wide = F.struct((a["cx"] + dx * part).alias("cx"), (a["cy"] + dy * part).alias("cy"), grown.alias("r"))
        return F.when(d + b["r"] <= a["r"], a).when(d + a["r"] <= b["r"], b).otherwise(wide)

    return F.aggregate(circles, first, widen)
