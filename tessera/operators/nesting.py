"""Polygon nesting over DataFrames: measuring, routing, left-bottom-fill, lattices, and the pages of a result.

A request is packed by one call of a kernel; requests are packed in parallel. Rings, outcomes
and checks are columns, so what a kernel places can be tested by the spatial operators.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Search
from tessera.functions import affine as A
from tessera.functions import ring as P
from tessera.functions import svg as G
from tessera.functions.rect import rect
from tessera.kernels import geometry as K
from tessera.kernels import nesting as N
from tessera.kernels import repair as Q
from tessera.kernels.svgpath import rings
from tessera.operators.kernels import per_group
from tessera.operators.packing import classify
from tessera.operators.spatial import collect
from tessera.schema import RING

PLACED = "request long, layout int, bin long, id long, copy int, rot double, tx double, ty double, width double"
#: Parts a lattice or a grid serves alone.
ALONE = ("SingleRectangle", "SingleHighFill", "SinglePairable", "SingleIrregular")


def measured(parts: DataFrame) -> DataFrame:
    """parts (ring, and holes if there are any) -> with w, h, area, vertices, n_holes, rectangular."""
    box = P.bbox(F.col("ring"))
    holes = F.size("holes") if "holes" in parts.columns else F.lit(0)
    rows = parts.withColumns({"w": box.x1 - box.x0, "h": box.y1 - box.y0, "area": F.abs(P.signed_area(F.col("ring"))), "vertices": F.size(P.without_repeats(F.col("ring"), 1e-6)), "n_holes": F.greatest(holes, F.lit(0))})
    return rows.withColumn("rectangular", F.greatest(F.least(F.when(F.col("w") * F.col("h") > 0, F.col("area") / (F.col("w") * F.col("h"))).otherwise(0.0), F.lit(1.0)), F.lit(0.0)))


def internal(ring: np.ndarray, config: Search, grow: bool = True) -> np.ndarray:
    """A ring as the search takes it: without crossings, widened by half the separation, simplified, narrow bays closed; steps that would break it are left out."""
    ring = Q.sanitize(Q.distinct(ring))
    ring = ring if K.area(ring) > 0 else ring[::-1]
    whole = K.area(ring)
    steps = []
    if config.separation:
        steps.append(lambda r: K.offset(r, config.separation / 2 if grow else -config.separation / 2))
    if config.simplify:
        steps.append(lambda r: K.simplify(r, config.simplify, grow))
    if config.concavity:
        steps.append(lambda r: Q.close_bays(r, *config.concavity, grow))
    for step in steps:
        new = step(ring)
        if len(new) >= 3 and not K.crossings(new) and K.area(new) > 0.1 * whole:
            ring = new
    return ring


def _array(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring])


def _parts(f: dict[str, list]) -> list[N.Part]:
    out = []
    for i, ring, demand, turns, quality in zip(*(f[c] for c in ("id", "ring", "demand", "turns", "quality")), strict=True):
        out.append(N.Part(i, _array(ring), demand, None if turns is None else tuple(map(float, turns)) or (0.0,), quality))
    return out


def _rows(request: int, layouts: list[N.Layout]) -> list[tuple]:
    return [(request, k, l.sheet.id, i, c, rot, x, y, float(l.sheet.ring[:, 0].max())) for k, l in enumerate(layouts) for c, (i, rot, x, y, _) in enumerate(l.placed)]


def polygon_bins(parts: DataFrame, sheets: list[N.Sheet], gap: float, config: Search = Search()) -> DataFrame:
    """parts (request, id, ring about its origin, demand, turns: radians or null for any, quality) -> PLACED; parts without a place have no row."""
    return per_group(parts.select("request", "id", "ring", "demand", "turns", "quality"), "request", PLACED, lambda q, f: _rows(q, N.fill_bins(_parts(f), sheets, gap, (config.seed or 0) * 1_000_003 + q, config.samples, config.local)), ["id"])


def polygon_strips(parts: DataFrame, height: float, gap: float, most: float = math.inf, config: Search = Search()) -> DataFrame:
    """The same for strips of one height: one that grows, or several up to a width of most."""
    return per_group(parts.select("request", "id", "ring", "demand", "turns", "quality"), "request", PLACED, lambda q, f: _rows(q, N.fill_strips(_parts(f), height, gap, (config.seed or 0) * 1_000_003 + q, most, config.samples, config.local)), ["id"])


def placed_rings(placed: DataFrame, parts: DataFrame) -> DataFrame:
    """placed (request, id, rot, tx, ty) with ring, where it lies, and its box."""
    rows = placed.join(parts.select(F.col("request").alias("_q"), F.col("id").alias("_i"), F.col("ring").alias("_ring")), (F.col("request") == F.col("_q")) & (F.col("id") == F.col("_i")))
    rows = rows.withColumn("ring", P.moved(F.col("_ring"), A.rigid(F.col("rot"), F.col("tx"), F.col("ty")))).drop("_q", "_i", "_ring")
    return rows.withColumns(dict(zip(("x_min", "y_min", "x_max", "y_max"), P.bbox(F.col("ring")), strict=True)))


def overlaps(rows: DataFrame, page: Column) -> DataFrame:
    """Colliding pairs of rows (ring and box) of one page: (request, a, b numbers)."""
    keyed = rows.select("request", page.alias("sheet"), F.monotonically_increasing_id().alias("id"), "ring", "x_min", "y_min", "x_max", "y_max")
    pairs = collect(keyed, keyed, lambda: (F.col("a_id") < F.col("b_id")) & P.collides(F.col("a_ring"), F.col("b_ring"), (rect("a_"), rect("b_"))), dealt=True)
    return pairs.select(F.col("a_request").alias("request"), F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def lattice_pages(parts: DataFrame, sheet: tuple[float, float], gap: float, directions: int = 12) -> DataFrame:
    """parts (request, id, ring, demand, half: may be turned by a half) -> copies on one full sheet: (request, id, copy, rot, tx, ty, full, rest).

    The best lattice of single parts or nestled pairs; the grid of boxes is the floor.
    """

    def one(request: int, f: dict[str, list]) -> list[tuple]:
        out = []
        for i, ring, demand, half in zip(*(f[c] for c in ("id", "ring", "demand", "half")), strict=True):
            ring = _array(ring)
            at = N.lattice_sheet(ring, gap, sheet, directions, bool(half))
            low, size = ring.min(0), np.ptp(ring, axis=0)
            nx, ny = (max(0, math.floor((s + 1e-9) / (d + gap))) for s, d in zip(sheet, size, strict=True))
            if nx * ny > len(at):
                at = [(0.0, gap / 2 + i * (size[0] + gap) - low[0], gap / 2 + j * (size[1] + gap) - low[1]) for i in range(nx) for j in range(ny)]
            n = len(at)
            out += [(request, i, k, float(a), float(x), float(y), demand // n, demand % n) for k, (a, x, y) in enumerate(at)]
        return out

    return per_group(parts.select("request", "id", "ring", "demand", "half"), "request", "request long, id long, copy int, rot double, tx double, ty double, full long, rest long", one, ["id"])


def classes(parts: DataFrame, sheet: tuple[float, float]) -> DataFrame:
    """measured parts -> with class, of their requests."""
    got = parts.groupBy("request").agg(F.count("*").alias("_types"), F.max(F.col("w") * F.col("h")).alias("_box"), F.max("rectangular").alias("_most"), F.min("rectangular").alias("_least"), F.max("vertices").alias("_n"), F.max("n_holes").alias("_holes"))
    kind = classify(F.col("_types"), F.col("_box") / (sheet[0] * sheet[1]), F.col("_most"), F.col("_n"), F.col("_holes"), F.col("_least"))
    return parts.join(got.select("request", kind.alias("class")), "request")


def nest(parts: DataFrame, sheet: tuple[float, float], gap: float, config: Search = Search(), max_fit: bool = False) -> DataFrame:
    """parts (request, id, ring, holes, demand, turns, quality) -> pages: (request, page, copies: sheets of it, id, rot, tx, ty).

    Requests of one part type go to lattices (a full sheet, as often as it is filled, and one
    of the rest); the others to left-bottom-fill. max_fit: one full sheet of each part, whatever is asked for.
    """
    rows = classes(measured(parts), sheet)
    single = F.col("class").isin(*ALONE)
    half = F.col("turns").isNull() | F.exists("turns", lambda t: F.abs(t - math.pi) < 0.02)
    full = lattice_pages(rows.where(single | F.lit(max_fit)).withColumn("half", half), sheet, gap)
    if max_fit:
        return full.select("request", F.concat(F.lit("fit-"), F.col("id")).alias("page"), F.lit(1).cast("long").alias("copies"), "id", "rot", "tx", "ty")
    # both pages of a copy from one row: two queries of the lattices would find them twice
    both = F.array(F.struct(F.lit("full").alias("page"), F.col("full").alias("copies"), (F.col("full") > 0).alias("used")), F.struct(F.lit("rest").alias("page"), F.lit(1).cast("long").alias("copies"), (F.col("copy") < F.col("rest")).alias("used")))
    pages = full.select("request", F.explode(F.filter(both, lambda p: p["used"])).alias("p"), "id", "rot", "tx", "ty").select("request", "p.page", "p.copies", "id", "rot", "tx", "ty")
    general = polygon_bins(rows.where(~single), [N.Sheet(0, N.box(*sheet), 1 << 40)], gap, config)
    return pages.unionByName(general.select("request", F.concat(F.lit("page-"), F.col("layout")).alias("page"), F.lit(1).cast("long").alias("copies"), "id", "rot", "tx", "ty"))


def parts_of_svgs(svgs: DataFrame) -> DataFrame:
    """svgs (request, id, demand, turns, path) -> parts with ring about its centroid, without crossings, and holes; parts without a ring have a null one."""
    schema = f"request long, id long, demand long, turns array<double>, quality int, ring {RING}, holes array<{RING}>, cx double, cy double"

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                got = rings(r.path)
                ring, centre, holes = None, (None, None), []
                if got:
                    ring = Q.sanitize(Q.distinct(got[0]))
                    x, y = ring[:, 0], ring[:, 1]
                    step = x * np.roll(y, -1) - y * np.roll(x, -1)
                    centre = tuple((((v + np.roll(v, -1)) * step).sum() / (3 * step.sum())) for v in (x, y))
                    holes = [[{"x": p[0] - centre[0], "y": p[1] - centre[1]} for p in h.tolist()] for h in got[1:]]
                    ring = [{"x": p[0] - centre[0], "y": p[1] - centre[1]} for p in ring.tolist()]
                out.append((r.request, r.id, r.demand, r.turns, None, ring, holes, *centre))
            yield pd.DataFrame(out, columns=["request", "id", "demand", "turns", "quality", "ring", "holes", "cx", "cy"]).astype({"quality": "Int32"})

    return svgs.select("request", "id", "demand", F.col("turns").cast("array<double>").alias("turns"), "path").mapInPandas(run, schema)


def results(pages: DataFrame, parts: DataFrame, sheet: tuple[float, float]) -> DataFrame:
    """pages of nest() and its parts -> (request, page, copies, parts_placed, utilisation, placements as structs, svg)."""
    rows = placed_rings(pages, parts).join(parts.select("request", "id", F.abs(P.signed_area(F.col("ring"))).alias("_area")), ["request", "id"])
    one = F.struct("id", F.col("tx").alias("x"), F.col("ty").alias("y"), F.degrees("rot").alias("rotation"))
    body = F.concat(F.lit('<path fill="#bbb" fill-rule="evenodd" d="'), G.path(F.col("ring"), 2), F.lit('"/>'))
    got = rows.groupBy("request", "page", "copies").agg(F.count("*").alias("parts_placed"), F.sum("_area").alias("_area"), F.array_sort(F.collect_list(one)).alias("placements"), F.array_sort(F.collect_list(body)).alias("_bodies"))
    return got.select("request", "page", "copies", "parts_placed", F.least(F.col("_area") / (sheet[0] * sheet[1]), F.lit(1.0)).alias("utilisation"), "placements", G.document(F.lit(float(sheet[0])), F.lit(float(sheet[1])), F.col("_bodies")).alias("svg"))


def solution_output(placed: DataFrame, instance: str, config: Search) -> DataFrame:
    """placed (PLACED) as one JSON a request, with the instance's name and the configuration beside the solution."""
    one = F.struct(F.col("id").alias("item_id"), F.struct(F.degrees("rot").alias("rotation"), F.array("tx", "ty").alias("translation")).alias("transformation"))
    lay = placed.groupBy("request", "layout", "bin").agg(F.array_sort(F.collect_list(F.struct("copy", one.alias("p")))).alias("ps"))
    lay = lay.select("request", F.struct("layout", F.struct(F.col("bin").alias("container_id"), F.transform("ps", lambda p: p["p"]).alias("placed_items")).alias("l")).alias("l"))
    got = lay.groupBy("request").agg(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["l"]).alias("layouts"))
    return got.select("request", F.concat(F.lit(f'{{"instance":{json.dumps(instance)},"config":{json.dumps(asdict(config))},"solution":'), F.to_json(F.struct("layouts")), F.lit("}")).alias("value"))
