"""From requests to placements: each request goes to the cheapest packer that suits its parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import kernels as K
from tessera.operators import packing as P


def classes(parts: DataFrame, sheet: tuple[float, float]) -> DataFrame:
    """parts (request, id, w, h, demand, area, vertices, holes, angles) -> with class; parts of a null request go."""
    rect = F.col("area") / (F.col("w") * F.col("h"))
    facts = {"_types": F.count("*"), "_box": F.max(F.col("w") * F.col("h")), "_most": F.max(rect), "_least": F.min(rect), "_n": F.max("vertices"), "_holes": F.max("holes")}
    got = parts.where("request is not null").withColumns({k: v.over(Window.partitionBy("request")) for k, v in facts.items()})
    kind = P.classify(F.col("_types"), F.col("_box") / (sheet[0] * sheet[1]), F.col("_most"), F.col("_n"), F.col("_holes"), F.col("_least"))
    return got.withColumn("class", kind).drop(*facts)


def nest(parts: DataFrame, sheet: tuple[float, float], gap: float, mode: str = "auto", general: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(request, id, page, copies of the page, x, y: centre, turned or rot) placements; pages of equal content are one page with a count.

    Single rectangles and parts that nearly fill a sheet: periodic grids. A few rectangular
    types: full sheets of each, the rest on shelves. Others, and all in mode "general": the
    general packer, left-bottom-fill over boxes if none is given.
    """
    rows = classes(parts, sheet)
    flat, turned = P.orientations(F.col("angles"))
    rows = rows.withColumns({"sheet_w": F.lit(float(sheet[0])), "sheet_h": F.lit(float(sheet[1])), "spacing": F.lit(float(gap)), "turn": turned & (F.col("class") != "MixedFewTypes"), "flat": flat})
    gridded = F.col("class").isin("SingleRectangle", "SingleHighFill", "MixedFewTypes") & F.col("flat") & F.lit(mode != "general")
    grid = P.grid(rows.where(gridded)).withColumn("capacity", P.capacity(F.col("regions")))
    full, rest, _ = P.pages(F.col("demand"), F.col("capacity"))
    grid = grid.withColumn("full", full).withColumn("rest", rest)
    sheets = P.stencil(grid.where("full > 0"), ["request", "id", "full"])
    sheets = sheets.select("request", "id", F.concat_ws("-", F.lit("full"), F.col("id").cast("string")).alias("page"), F.col("full").alias("copies"), "x", "y", F.when(F.col("turned"), 90.0).otherwise(0.0).alias("rot"))
    left = grid.where("rest > 0 and capacity > 0").select("request", "id", "w", "h", F.explode(F.sequence(F.lit(1), F.col("rest").cast("int"))).alias("_n")).drop("_n")
    shelf = K.shelves(left, sheet, gap, sizes=True).select("request", "id", F.concat_ws("-", F.lit("rest"), F.col("page").cast("string")).alias("page"), F.lit(1).cast("long").alias("copies"), (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"), F.lit(0.0).alias("rot"))
    other = rows.where(~gridded).select("request", "id", "w", "h", "demand")
    if general is None:
        got = K.fill_bins(other, [(0, float(sheet[0]), float(sheet[1]), 1_000_000)], gap, samples=100)
        placed = got.select("request", "id", F.concat_ws("-", F.lit("page"), F.col("layout").cast("string")).alias("page"), F.lit(1).cast("long").alias("copies"), ((F.col("x_min") + F.col("x_max")) / 2).alias("x"), ((F.col("y_min") + F.col("y_max")) / 2).alias("y"), F.lit(0.0).alias("rot"))
    else:
        placed = general(other)
    return sheets.unionByName(shelf).unionByName(placed)


def max_fit(parts: DataFrame, sheet: tuple[float, float], gap: float) -> DataFrame:
    """Most copies of each rectangular part on one sheet: the capacity of its full sheet, by construction."""
    flat, turned = P.orientations(F.col("angles"))
    rows = parts.withColumns({"sheet_w": F.lit(float(sheet[0])), "sheet_h": F.lit(float(sheet[1])), "spacing": F.lit(float(gap)), "turn": turned})
    return P.grid(rows.where(flat)).select("request", "id", P.capacity(F.col("regions")).alias("copies"))
