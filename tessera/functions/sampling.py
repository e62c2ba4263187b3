"""Reproducible draws: functions of a seed and keys, whatever the partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """In [0, 1): 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)


def normal(mean: Column, deviation: Column, seed: int, *keys: Column) -> Column:
    """Box and Muller's transform of two uniforms."""
    u, v = uniform(2 * seed, *keys), uniform(2 * seed + 1, *keys)
    return mean + deviation * F.sqrt(-2 * F.log(1 - u)) * F.cos(v * (2 * math.pi))


def decayed(first: float, last: float, progress: Column) -> Column:
    """From first to last, geometrically, as progress goes from 0 to 1."""
    return F.lit(first) * F.pow(F.lit(last / first), progress)


def loss(x_max: Column, y_max: Column) -> Column:
    return x_max * 10 + y_max
