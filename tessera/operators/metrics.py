"""Bookkeeping of instances and layouts: demand, stock, cost, density, utilisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import rect as R


def totals(items: DataFrame) -> DataFrame:
    """Area and quantity of items (w, h, demand), by demand."""
    return items.agg(F.sum(F.col("w") * F.col("h") * F.col("demand")).alias("area"), F.sum("demand").alias("quantity"), F.count(F.when(F.col("demand") > 0, 1)).alias("types"))


def layout_density(placed: DataFrame, sheets: DataFrame) -> DataFrame:
    """sheets (sheet, area) -> placed area, density and count of each; empty sheets have density 0."""
    used = placed.groupBy("sheet").agg(F.sum(R.area(R.rect())).alias("placed"), F.count("*").alias("n"))
    out = sheets.join(used, "sheet", "left").select("sheet", "area", F.coalesce("placed", F.lit(0.0)).alias("placed"), F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("density", F.col("placed") / F.col("area"))


def remaining(items: DataFrame, placed: DataFrame) -> DataFrame:
    """items (id, demand), placed (item): quantities placed and still asked for."""
    used = placed.groupBy(F.col("item").alias("id")).agg(F.count("*").alias("placed"))
    out = items.join(used, "id", "left").withColumn("placed", F.coalesce("placed", F.lit(0)))
    return out.select("id", "demand", "placed", (F.col("demand") - F.col("placed")).alias("remaining"))


def cost(bins: DataFrame, used: DataFrame) -> DataFrame:
    """bins (id, stock, cost), used (bin, layout): layouts opened, stock left, cost."""
    opened = used.distinct().groupBy(F.col("bin").alias("id")).agg(F.count("*").alias("used"))
    out = bins.join(opened, "id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return out.select("id", "stock", "used", (F.col("stock") - F.col("used")).alias("left"), (F.col("cost") * F.col("used")).alias("cost"))


def fit_strip(placed: DataFrame, margin: float = 1.00001, offset: float = 0.0) -> DataFrame:
    """Width that holds each sheet's shapes."""
    return placed.groupBy("sheet").agg((F.max("x_max") * margin + offset).alias("width"), F.count("*").alias("n"))


def utilisation(placed: DataFrame, sheet_w: float, sheet_h: float, spacing: float) -> DataFrame:
    """Share of each sheet that its shapes take with half the spacing around them, at most 1, and without."""
    r = R.rect()
    return placed.groupBy("sheet").agg(F.least(F.sum(R.area(R.resized(r, spacing / 2))) / (sheet_w * sheet_h), F.lit(1.0)).alias("with_halo"), (F.sum(R.area(r)) / (sheet_w * sheet_h)).alias("bare"))
