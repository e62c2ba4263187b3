"""Rigid and affine maps as six columns: (x, y) -> (a x + b y + tx, c x + d y + ty)."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Affine(NamedTuple):
    a: Column
    b: Column
    tx: Column
    c: Column
    d: Column
    ty: Column


def identity() -> Affine:
    return Affine(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)])


def rigid(angle: Column, tx: Column, ty: Column) -> Affine:
    """Rotation about the origin by radians, then translation."""
    return Affine(F.cos(angle), -F.sin(angle), tx, F.sin(angle), F.cos(angle), ty)


def then(m: Affine, n: Affine) -> Affine:
    """First m, then n."""
    return Affine(n.a * m.a + n.b * m.c, n.a * m.b + n.b * m.d, n.a * m.tx + n.b * m.ty + n.tx, n.c * m.a + n.d * m.c, n.c * m.b + n.d * m.d, n.c * m.tx + n.d * m.ty + n.ty)


def inverse(m: Affine) -> Affine:
    k = m.a * m.d - m.b * m.c
    a, b, c, d = m.d / k, -m.b / k, -m.c / k, m.a / k
    return Affine(a, b, -(a * m.tx + b * m.ty), c, d, -(c * m.tx + d * m.ty))


def apply(m: Affine, x: Column, y: Column) -> tuple[Column, Column]:
    return m.a * x + m.b * y + m.tx, m.c * x + m.d * y + m.ty


def decompose(m: Affine) -> tuple[Column, Column, Column]:
    """Of a rigid map: angle, tx, ty."""
    return F.atan2(m.c, m.a), m.tx, m.ty


def normal_angle(angle: Column) -> Column:
    """In [0, 2 pi)."""
    return F.pmod(angle, F.lit(2 * math.pi))


def is_identity(m: Affine) -> Column:
    return (m.a == 1) & (m.b == 0) & (m.tx == 0) & (m.c == 0) & (m.d == 1) & (m.ty == 0)
