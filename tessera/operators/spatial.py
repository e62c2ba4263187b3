"""Spatial joins: shapes meet in grid cells, an equi-join, and are tested exactly.

Both sides list the cells that their boxes touch; a pair counts only in the cell of the
lower left corner of the boxes' intersection, which both touch, so no distinct is needed.
Shapes over MANY cells skip the grid: they join on the partition key alone, in joins that are
left out where the greatest box is too small for that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rect as R

MANY = 256


def extents(shapes: DataFrame, prefix: str, sides: bool = True) -> tuple[float, float, float]:
    """Measured: the 90th percentile of box sides, unless sides are not asked for, and the greatest width and height."""
    r = R.rect(prefix)
    got = shapes.agg(F.percentile_approx(F.greatest(R.width(r), R.height(r)), 0.9) if sides else F.lit(None), F.max(R.width(r)), F.max(R.height(r))).first()
    return max(float(got[0] or 0.0), 1e-6), float(got[1] or 0.0), float(got[2] or 0.0)


def _count(prefix: str, cell: float) -> Column:
    r = R.rect(prefix)
    return (F.floor(r.x1 / cell) - F.floor(r.x0 / cell) + 1) * (F.floor(r.y1 / cell) - F.floor(r.y0 / cell) + 1)


def _small(df: DataFrame, prefix: str, cell: float) -> DataFrame:
    return df.where(_count(prefix, cell) <= MANY)


def _cells(df: DataFrame, prefix: str, cell: float) -> tuple[DataFrame, DataFrame]:
    """Small shapes once for each cell that they touch, and the large ones."""
    r = R.rect(prefix)
    few = _small(df, prefix, cell).withColumn("_cx", F.explode(F.sequence(F.floor(r.x0 / cell), F.floor(r.x1 / cell))))
    few = few.withColumn("_cy", F.explode(F.sequence(F.floor(r.y0 / cell), F.floor(r.y1 / cell))))
    return few, df.where(_count(prefix, cell) > MANY)


def spatial_join(a: DataFrame, b: DataFrame, exact: Callable[[], Column] | None = None, key: tuple[str, str] = ("a_sheet", "b_sheet"), cell: float | None = None, dealt: bool = False) -> DataFrame:
    """Pairs of rows of a (columns a_x_min ... a_y_max) and b (b_x_min ...) of equal key whose boxes and, if given, exact() meet.

    dealt: small rows whose exact() is much work; adaptive execution would join them in few tasks.
    """
    sizes = [extents(a, "a_", cell is None), extents(b, "b_", cell is None)]
    cell = cell or max(x[0] for x in sizes)
    large = [(w / cell + 2) * (h / cell + 2) > MANY for _, w, h in sizes]
    ra, rb = R.rect("a_"), R.rect("b_")
    meet = R.overlaps(ra, rb)
    if exact is not None:
        meet = meet & exact()
    same = F.col(key[0]) == F.col(key[1])
    (fa, ma), (fb, mb) = _cells(a, "a_", cell), _cells(b, "b_", cell)
    fa = fa.withColumnsRenamed({"_cx": "_ax", "_cy": "_ay"})
    if dealt:
        n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        fa, fb = fa.repartition(n, key[0], "_ax", "_ay"), fb.repartition(n, key[1], "_cx", "_cy")
    home = (F.col("_ax") == F.floor(F.greatest(ra.x0, rb.x0) / cell)) & (F.col("_ay") == F.floor(F.greatest(ra.y0, rb.y0) / cell))
    pairs = fa.join(fb, same & (F.col("_ax") == F.col("_cx")) & (F.col("_ay") == F.col("_cy")) & home & meet).drop("_ax", "_ay", "_cx", "_cy")
    # large shapes, if there can be any: of a against all of b, of b against those of a that the grid holds
    if large[0]:
        pairs = pairs.unionByName(ma.join(b, same & meet))
    return pairs.unionByName(_small(a, "a_", cell).join(mb, same & meet)) if large[1] else pairs


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def collect(shapes: DataFrame, hazards: DataFrame, exact: Callable[[], Column] | None = None, irrelevant: Column | None = None, cell: float | None = None, dealt: bool = False) -> DataFrame:
    """All colliding pairs; irrelevant: a condition on a_ and b_ columns of pairs that a filter takes out."""
    out = spatial_join(prefixed(shapes, "a_"), prefixed(hazards, "b_"), exact, cell=cell, dealt=dealt)
    return out if irrelevant is None else out.where(~irrelevant)


def detect(shapes: DataFrame, hazards: DataFrame, exact: Callable[[], Column] | None = None, irrelevant: Column | None = None, cell: float | None = None) -> DataFrame:
    """Shapes with a column hit: whether any relevant hazard collides."""
    ids = collect(shapes, hazards, exact, irrelevant, cell).select(F.col("a_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    return shapes.join(ids, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def feasible(placed: DataFrame, exact: Callable[[], Column] | None = None, cell: float | None = None) -> DataFrame:
    """(sheet, feasible): whether no two shapes of a sheet collide."""
    pairs = collect(placed, placed, exact, F.col("a_id") >= F.col("b_id"), cell)
    bad = pairs.select(F.col("a_sheet").alias("sheet")).distinct().withColumn("bad", F.lit(True))
    return placed.select("sheet").distinct().join(bad, "sheet", "left").select("sheet", F.col("bad").isNull().alias("feasible"))
