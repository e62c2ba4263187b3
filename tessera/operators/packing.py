"""Packers with a closed form: grids, periodic sheets, pairs, and the classes that route to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The router's thresholds.
HIGH_FILL, RECTANGLE, PAIR_LOW, PAIR_HIGH, MIXED_TYPES, MIXED_RECTANGLE, PAIR_VERTICES = 0.95, 0.98, 0.40, 0.62, 4, 0.90, 5


def cells(room: Column, cell: Column, spacing: Column) -> Column:
    """How many cells fit along a room, with a gap between them."""
    return F.when(cell > 0, F.greatest(F.floor((room + spacing) / (cell + spacing)), F.lit(0))).otherwise(F.lit(0)).cast("long")


def orientations(angles: Column) -> tuple[Column, Column]:
    """(unturned allowed, turned allowed) from allowed angles in degrees; null or empty allows both, slanted ones too."""
    half = F.transform(angles, lambda a: F.pmod(a.cast("double"), F.lit(180.0)))
    flat = F.exists(half, lambda a: (a < 1) | (a > 179))
    upright = F.exists(half, lambda a: F.abs(a - 90) < 1)
    slanted = F.exists(half, lambda a: (a >= 1) & (a <= 179) & (F.abs(a - 90) >= 1))
    any_ = F.coalesce(F.size(angles) <= 0, F.lit(True)) | angles.isNull()
    return F.when(any_, F.lit(True)).otherwise(flat | slanted), F.when(any_, F.lit(True)).otherwise(upright | slanted)


def grid(parts: DataFrame) -> DataFrame:
    """parts (w, h, sheet_w, sheet_h, spacing, turn) -> regions: array of up to three regular blocks of cells.

    The orientation with more cells fills the sheet, unturned on a tie; the other one fills
    the strip to its right, of full height, and the one above it, as wide as the block.
    """
    w, h, bw, bh, gap = (F.col(c) for c in ("w", "h", "sheet_w", "sheet_h", "spacing"))
    flat = cells(bw, w, gap) * cells(bh, h, gap)
    upright = F.when(F.col("turn"), cells(bw, h, gap) * cells(bh, w, gap)).otherwise(F.lit(0))
    out = parts.withColumn("_flat", flat >= upright).withColumn("_any", F.greatest(flat, upright) > 0)
    out = out.withColumn("_w", F.when(F.col("_flat"), w).otherwise(h)).withColumn("_h", F.when(F.col("_flat"), h).otherwise(w))
    out = out.withColumn("_nx", cells(bw, F.col("_w"), gap)).withColumn("_ny", cells(bh, F.col("_h"), gap))
    used_w = F.col("_nx") * (F.col("_w") + gap) - gap
    used_h = F.col("_ny") * (F.col("_h") + gap) - gap

    def region(x, y, room_w, room_h, cw, ch, turned, allowed) -> Column:
        ok = F.col("_any") & allowed & (room_w > 0) & (room_h > 0)
        nx, ny = cells(room_w, cw, gap), cells(room_h, ch, gap)
        return F.when(ok & (nx > 0) & (ny > 0), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), nx.alias("nx"), ny.alias("ny"), cw.alias("cw"), ch.alias("ch"), turned.alias("turned")))

    other = F.col("turn") | ~F.col("_flat")
    zero = F.lit(0.0)
    right, above = used_w + gap, used_h + gap
    regions = F.array_compact(F.array(
        region(zero, zero, bw, bh, F.col("_w"), F.col("_h"), ~F.col("_flat"), F.lit(True)),
        region(right, zero, bw - right, bh, F.col("_h"), F.col("_w"), F.col("_flat"), other),
        region(zero, above, used_w, bh - above, F.col("_h"), F.col("_w"), F.col("_flat"), other),
    ))
    # a generator: filters on what follows stay above it; below, each mention of the regions would be their whole expression
    return out.select(*parts.columns, F.inline(F.array(F.struct(regions.alias("regions")))))


def capacity(regions: Column) -> Column:
    return F.aggregate(regions, F.lit(0).cast("long"), lambda a, r: a + r["nx"] * r["ny"])


def stencil(parts: DataFrame, keep: list[str]) -> DataFrame:
    """A row per cell of grid()'s regions: centre, turned, and its number from 0."""
    rows = (parts if "regions" in parts.columns else grid(parts)).select(*keep, "spacing", F.posexplode("regions").alias("region", "r"))
    rows = rows.select(*keep, "spacing", "region", "r", F.explode(F.sequence(F.lit(0), F.col("r.nx") - 1)).alias("i"))
    rows = rows.select(*keep, "spacing", "region", "r", "i", F.explode(F.sequence(F.lit(0), F.col("r.ny") - 1)).alias("j"))
    gap = F.col("spacing")
    x = F.col("r.x") + F.col("i") * (F.col("r.cw") + gap) + F.col("r.cw") / 2
    y = F.col("r.y") + F.col("j") * (F.col("r.ch") + gap) + F.col("r.ch") / 2
    return rows.select(*keep, "region", "i", "j", x.alias("x"), y.alias("y"), F.col("r.turned").alias("turned"))


def pages(quantity: Column, per_page: Column) -> tuple[Column, Column, Column]:
    """(full pages, parts on the last page, all pages)."""
    full = F.when(per_page > 0, F.floor(quantity / per_page)).otherwise(F.lit(0)).cast("long")
    rest = F.when(per_page > 0, quantity - full * per_page).otherwise(quantity).cast("long")
    return full, rest, (full + ((rest > 0) & (per_page > 0)).cast("long"))


def classify(types: Column, fill: Column, rectangular: Column, vertices: Column, holes: Column, least_rectangular: Column) -> Column:
    """The packer of a request with so many part types; the middle four are of its only part."""
    single = F.when(fill > HIGH_FILL, "SingleHighFill").when(rectangular >= RECTANGLE, "SingleRectangle").when(rectangular.between(PAIR_LOW, PAIR_HIGH) & (vertices <= PAIR_VERTICES) & (holes == 0), "SinglePairable").otherwise("SingleIrregular")
    return F.when(types == 1, single).when(types.between(2, MIXED_TYPES) & (least_rectangular >= MIXED_RECTANGLE), "MixedFewTypes").otherwise("General")


def pair_cell(w: Column, h: Column, spacing: Column) -> tuple[Column, Column, Column, Column]:
    """Two right triangles of one box, a kerf apart: width and height of the pair's cell and the first one's offset from its centre.

    The right angle is at the lower left; the hypotenuse's unit normal towards it is -(h, w) / diagonal.
    """
    diagonal = F.sqrt(w * w + h * h)
    nx, ny = h / diagonal, w / diagonal
    return w + spacing * nx, h + spacing * ny, -w / 6 - nx * spacing / 2, -h / 6 - ny * spacing / 2


def unplaced(parts: DataFrame, sheet: tuple[float, float], gap: float) -> DataFrame:
    """parts (id, w, h, n: copies that found no place) -> (id, k, x, y) on a grid centred on the sheet; rows may run over it."""
    columns = F.greatest(F.floor((sheet[0] - gap) / (F.col("w") + gap)), F.lit(1))
    rows = parts.where("n > 0 and w > 0 and h > 0").withColumn("columns", F.least(columns, F.col("n"))).withColumn("rows", F.ceil(F.col("n") / F.col("columns")))
    x0 = (sheet[0] - F.col("columns") * (F.col("w") + gap) + gap) / 2
    y0 = (sheet[1] - F.col("rows") * (F.col("h") + gap) + gap) / 2
    at = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return at.select("id", "k", (x0 + F.col("k") % F.col("columns") * (F.col("w") + gap)).alias("x"), (y0 + F.floor(F.col("k") / F.col("columns")) * (F.col("h") + gap)).alias("y"))
