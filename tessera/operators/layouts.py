"""Placement state as data: layouts are rows of `placed` by sheet; every change is a new DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def place(placed: DataFrame, new: DataFrame) -> DataFrame:
    return placed.unionByName(new)


def remove(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the rows of ids (sheet, id)."""
    return placed.join(ids, ["sheet", "id"], "left_anti")


def remove_layouts(placed: DataFrame, sheets: DataFrame) -> DataFrame:
    return placed.join(sheets, "sheet", "left_anti")


def changes(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to remove, to add): what turns one version into the other."""
    return old.exceptAll(new), new.exceptAll(old)


def same(a: DataFrame, b: DataFrame) -> bool:
    """As multisets of rows."""
    gone, added = changes(a, b)
    return gone.isEmpty() and added.isEmpty()


def widen(strips: DataFrame, failed: DataFrame, factor: float = 1.1) -> DataFrame:
    """strips (sheet, width, max_width or not): those of failed (sheet) by a tenth wider, up to their limit."""
    rows = strips.join(failed.select("sheet").distinct().withColumn("_f", F.lit(True)), "sheet", "left")
    wide = F.when(F.col("_f"), F.col("width") * factor).otherwise(F.col("width"))
    if "max_width" in strips.columns:
        wide = F.least(wide, F.col("max_width"))
    return rows.withColumn("width", wide).drop("_f")


def strip_containers(strips: DataFrame) -> DataFrame:
    """strips (sheet, width, height) with their outline."""
    x, y, zero = F.col("width").cast("double"), F.col("height").cast("double"), F.lit(0.0)
    return strips.withColumn("ring", F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((zero, zero), (x, zero), (x, y), (zero, y))]))


def add_strips(strips: DataFrame, new: DataFrame) -> DataFrame:
    """Numbers the new strips (width, height, max_width) after those there are."""
    top = strips.agg(F.coalesce(F.max("sheet") + 1, F.lit(0)).alias("_top"))
    numbered = new.withColumn("_n", F.row_number().over(Window.orderBy("width", "height")) - 1).crossJoin(F.broadcast(top))
    return strips.unionByName(numbered.withColumn("sheet", (F.col("_top") + F.col("_n")).cast("long")).drop("_n", "_top"), allowMissingColumns=True)


def fit_strips(strips: DataFrame, placed: DataFrame, offset: float = 0.0) -> DataFrame:
    """Each strip as wide as its rightmost item and the offset need; empty ones as they are."""
    far = placed.groupBy("sheet").agg(F.max("x_max").alias("_far"))
    return strips.join(far, "sheet", "left").withColumn("width", F.coalesce(F.col("_far") * 1.00001 + offset, F.col("width"))).drop("_far")


def resize(strips: DataFrame, placed: DataFrame, widths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strips at the widths (sheet, new_width), and the items that no longer lie inside."""
    new = strips.join(widths, "sheet", "left").withColumn("width", F.coalesce("new_width", "width")).drop("new_width")
    out = placed.join(new.select("sheet", F.col("width").alias("_w")), "sheet").where(F.col("x_max") > F.col("_w")).drop("_w")
    return new, out


def open_bins(bins: DataFrame, used: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (bin, n) new layouts, no more of a bin than its stock leaves: (bin, opened)."""
    spent = used.groupBy("bin").agg(F.countDistinct("sheet").alias("_used"))
    left = bins.select(F.col("id").alias("bin"), "stock").join(spent, "bin", "left").withColumn("_left", F.greatest(F.col("stock") - F.coalesce("_used", F.lit(0)), F.lit(0)))
    return wanted.join(left, "bin").select("bin", F.least("n", "_left").cast("long").alias("opened"))


def close_empty(layouts: DataFrame, placed: DataFrame) -> DataFrame:
    """Layouts (sheet, ...) in which something lies."""
    return layouts.join(placed.select("sheet").distinct(), "sheet", "left_semi")


def included(placed: DataFrame, demand: DataFrame) -> DataFrame:
    """demand (item, demand) with how many are placed and still missing; more placed than asked for is negative."""
    got = placed.groupBy("item").agg(F.count("*").alias("placed"))
    return demand.join(got, "item", "left").select("item", "demand", F.coalesce("placed", F.lit(0)).alias("placed"), (F.col("demand") - F.coalesce("placed", F.lit(0))).alias("missing"))


def by_order(pages: DataFrame, layouts: DataFrame) -> DataFrame:
    """Pages and layouts of a request paired by their order: (request, k, page, sheet)."""
    a = pages.select("request", "page", (F.row_number().over(Window.partitionBy("request").orderBy("page")) - 1).alias("k"))
    b = layouts.select("request", "sheet", (F.row_number().over(Window.partitionBy("request").orderBy("sheet")) - 1).alias("k"))
    return a.join(b, ["request", "k"])


def dangling(hazards: DataFrame, placed: DataFrame) -> DataFrame:
    """Hazards (sheet, id) of items that are no longer placed: none in a sound state."""
    return hazards.join(placed.select("sheet", "id"), ["sheet", "id"], "left_anti")
