"""Hazards as rows of grid cells: which shapes reach a cell, how strongly, and with how many edges.

A fixed grid stands for a tree of cells: it is computed anew from the shapes, in parallel,
instead of being changed in place, so a lost partition is repeated and none dangles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import rect as R
from tessera.functions import ring as P


def cells(polygons: DataFrame, cell: float) -> DataFrame:
    """polygons (sheet, id, ring) -> (sheet, cx, cy, id, presence, edges) of the cells that a polygon's box touches and the polygon reaches."""
    box = P.bbox(F.col("ring"))
    at = polygons.withColumn("cx", F.explode(F.sequence(F.floor(box.x0 / cell), F.floor(box.x1 / cell))))
    at = at.withColumn("cy", F.explode(F.sequence(F.floor(box.y0 / cell), F.floor(box.y1 / cell))))
    own = R.Rect(F.col("cx") * cell, F.col("cy") * cell, (F.col("cx") + 1) * cell, (F.col("cy") + 1) * cell)
    presence, n = P.presence(F.col("ring"), own)
    return at.select("sheet", "cx", "cy", "id", presence.alias("presence"), n.cast("long").alias("edges")).where("presence <> 'None'")


def strongest(found: DataFrame) -> DataFrame:
    """The hazard of each cell that is strongest (Entire before Partial), of most edges, first by id; and the cell's active edges and hazards."""
    best = F.struct(F.col("presence") == "Partial", -F.col("edges"), F.col("id"))
    return found.groupBy("sheet", "cx", "cy").agg(F.min_by("id", best).alias("id"), F.min("presence").alias("presence"), F.sum("edges").alias("edges"), F.count("*").alias("hazards"))
