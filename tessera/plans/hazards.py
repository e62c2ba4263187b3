"""Queries of polygons as hazards, of ring repair, of the adaptive search and of its results."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions import edge as E
from tessera.functions import ring as P
from tessera.functions import svg as G
from tessera.kernels import repair as Q
from tessera.operators import hazards as H
from tessera.operators import kernels as K
from tessera.operators import packing
from tessera.operators import waves as W
from tessera.plans.searches import NESTED, _requests
from tessera.plans.shapes import _NEAR, _V, _pairs, bent
from tessera.plans.views import ctes, view
from tessera.sources import instances as I

CELL, SHEET, GAP = 16.0, (40.0, 12.0), 1.0


def polygon_collisions(s, d):
    """Pairs of polygons whose edges meet or of which one holds the other."""
    rows = _pairs(s, d, "g_poly", "g_poly", lambda: (F.col("a_id") < F.col("b_id")) & P.collides(F.col("a_ring"), F.col("b_ring")))
    return rows.select("a_id", "b_id")


_MEET = "(b.nx - b.x) * (a.ny - a.y) - (b.ny - b.y) * (a.nx - a.x)"
POLYGON_COLLISIONS = ctes("g_poly") + _V + f""", q as (select v.id, any_value(sheet) as sheet, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max, arg_min(x, i) as fx, arg_min(y, i) as fy from v join g_poly using (id) group by v.id),
 n as (select a.id as a_id, b.id as b_id, a.fx as ax, a.fy as ay, b.fx as bx, b.fy as b_y from q a join q b on {_NEAR} and a.id < b.id),
 m as (select a_id, b_id, -({_MEET}) as det, (b.x - a.x) * (b.ny - b.y) - (b.y - a.y) * (b.nx - b.x) as t, (b.x - a.x) * (a.ny - a.y) - (b.y - a.y) * (a.nx - a.x) as u from n join v a on a.id = a_id join v b on b.id = b_id),
 e as (select distinct a_id, b_id from m where det <> 0 and case when det > 0 then t else -t end between 0 and abs(det) and case when det > 0 then u else -u end between 0 and abs(det)),
 c as (select a_id, b_id, v.id, case when v.id = b_id then ax else bx end as cx, case when v.id = b_id then ay else b_y end as cy, x, y, nx, ny from n join v on v.id in (a_id, b_id)),
 i as (select a_id, b_id from c where ((y < cy and ny >= cy) or (ny < cy and y >= cy)) and cx < x + (cy - y) / (ny - y) * (nx - x) group by a_id, b_id, id having count(*) % 2 = 1)
 select a_id, b_id from e union select a_id, b_id from i"""


def cell_presence(s, d):
    """How each polygon is present in the cells that it reaches."""
    return H.cells(view(s, d, "g_poly"), CELL)


_CELLS = ctes("g_poly") + _V + f""", q as (select v.id, any_value(sheet) as sheet, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max from v join g_poly using (id) group by v.id),
 gx as (select *, unnest(range(floor(x_min / {CELL})::BIGINT, floor(x_max / {CELL})::BIGINT + 1)) as cx from q), g as (select *, unnest(range(floor(y_min / {CELL})::BIGINT, floor(y_max / {CELL})::BIGINT + 1)) as cy from gx),
 k as (select sheet, id, cx, cy, cx * {CELL}::DOUBLE as x0, (cx + 1) * {CELL}::DOUBLE as x1, cy * {CELL}::DOUBLE as y0, (cy + 1) * {CELL}::DOUBLE as y1 from g),
 f as (select k.*, (x0 + x1) / 2 as mx, (y0 + y1) / 2 as my, x, y, nx, ny, nx - x as dx, ny - y as dy from k join v using (id)),
 h as (select *, dx * (y0 - y) - dy * (x0 - x) as s1, dx * (y0 - y) - dy * (x1 - x) as s2, dx * (y1 - y) - dy * (x0 - x) as s3, dx * (y1 - y) - dy * (x1 - x) as s4 from f),
 r as (select sheet, id, cx, cy, count(*) filter (where least(x, nx) <= x1 and x0 <= greatest(x, nx) and least(y, ny) <= y1 and y0 <= greatest(y, ny) and not (least(s1, s2, s3, s4) > 0 or greatest(s1, s2, s3, s4) < 0)) as edges,
   count(*) filter (where ((y < my and ny >= my) or (ny < my and y >= my)) and mx < x + (my - y) / (ny - y) * (nx - x)) % 2 = 1 as within from h group by sheet, id, cx, cy),
 p as (select sheet, cx, cy, id, case when edges > 0 then 'Partial' else 'Entire' end as presence, edges from r where edges > 0 or within)"""
CELL_PRESENCE = _CELLS + " select * from p"


def strongest_hazard(s, d):
    return H.strongest(cell_presence(s, d))


STRONGEST = _CELLS + " select sheet, cx, cy, arg_min(id, (case when presence = 'Entire' then 0 else 1 end, -edges, id)) as id, min(presence) as presence, sum(edges)::BIGINT as edges, count(*) as hazards from p group by sheet, cx, cy"


def fit_check(s, d):
    """Items against a small sheet less the gap: error is null for those that fit in an allowed orientation."""
    grain = F.col("grain")
    angles = F.when(grain == 1, F.array(F.lit(0.0))).when(grain == 2, F.array(F.lit(90.0))).when(grain == 3, F.array(F.lit(0.0), F.lit(90.0)))
    return W.checked(view(s, d, "g_item").withColumn("angles", angles), SHEET, GAP).select("id", "error")


FIT_CHECK = ctes("g_item") + f""" select id, case when not (grain <> 2 and w <= {SHEET[0] - GAP} and h <= {SHEET[1] - GAP} or grain <> 1 and h <= {SHEET[0] - GAP} and w <= {SHEET[1] - GAP})
 then printf('part of %.2f x %.2f is too large for a sheet of {SHEET[0]:.2f} x {SHEET[1]:.2f} with spacing {GAP:.2f}', w, h) end as error from g_item"""


def surrogates(s, d):
    """Poles and piers: circles inside, segments that meet no edge, as many piers as were asked for."""
    rows = view(s, d, "g_poly")
    got = K.surrogates(rows).join(rows, "id")
    ring = F.col("ring")
    circle = P.has_point(ring, F.col("a"), F.col("b")) & (P.distance(ring, F.col("a"), F.col("b")) >= F.col("c") - 1e-6)
    middle = P.has_point(ring, (F.col("a") + F.col("c")) / 2, (F.col("b") + F.col("d")) / 2)
    clear = ~F.exists(P.edges(ring), lambda e: E.collides(P.as_edge(e), E.Edge(F.col("a"), F.col("b"), F.col("c"), F.col("d"))))
    return got.groupBy("id").agg(F.sum(F.col("kind").cast("long")).alias("piers"), F.min(F.when(F.col("kind") == 0, circle).otherwise(middle & clear)).alias("inside"))


def decimate(s, d):
    """Fewer corners of the ring's own, none that is gone farther than the tolerance from what is left."""
    got = K.rings_from(view(s, d, "g_poly"), lambda v: Q.decimate(v, 4.0))
    near = F.forall(F.array_except("ring", "after"), lambda p: P.distance(F.col("after"), p["x"], p["y"]) <= 4.0 + 1e-6)
    return got.select("id", F.size("ring").alias("before"), (F.size("after") >= 3).alias("ring_left"), (F.size(F.array_except("after", "ring")) == 0).alias("kept"), near.alias("near"))


def close_bays(s, d):
    """Corners go, area comes, no corner that is gone lies outside, nothing crosses."""
    got = K.rings_from(view(s, d, "g_poly"), lambda v: Q.close_bays(v, 0.5, 0.1))
    after = F.col("after")
    within = F.forall(F.array_except("ring", "after"), lambda p: P.has_point(after, p["x"], p["y"]) | (P.distance(after, p["x"], p["y"]) < 1e-6))
    return got.select("id", F.size("ring").alias("before"), (P.signed_area(after) >= P.signed_area(F.col("ring")) - 1e-9).alias("grows"), within.alias("within"), (F.size(P.crossings(after)) == 0).alias("simple"))


def sanitize(s, d):
    """Rings with a crossing come out without one, with corners of their own alone."""
    got = K.rings_from(bent(s, d), Q.sanitize)
    return got.select("id", (F.size("after") >= 3).alias("ring_left"), (F.size(F.array_except("after", "ring")) == 0).alias("kept"), ((F.size(P.crossings(F.col("after"))) == 0) | (F.size("after") == F.size("ring"))).alias("simple"))


def adaptive_waves(s, d):
    """Orders as requests on sheets of 60 by 40, each with the best run of its waves: the reference's 60 runs of 5,000 samples, however long they take."""
    parts = _requests(s, d).groupBy("request", "id", "w", "h").agg(F.sum("demand").alias("demand"))
    return W.adaptive(parts, (60.0, 40.0), 1.0, seconds=math.inf).groupBy("request").agg(F.count("*").alias("parts"))


def unplaced_grid(s, d):
    """What is left of each item's demand beyond multiples of ten, on a sheet of its own."""
    parts = view(s, d, "g_item").select("id", "w", "h", (F.col("demand") % 10).alias("n"))
    out = packing.unplaced(parts, (100.0, 60.0), 1.0)
    return out.select("id", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


UNPLACED = ctes("g_item") + """, n as (select id, w, h, demand % 10 as n, least(greatest(floor(99 / (w + 1))::BIGINT, 1), demand % 10) as c from g_item where demand % 10 > 0),
 r as (select *, ceil(n::DOUBLE / c)::BIGINT as r, unnest(range(n)) as k from n)
 select id, k, round((101 - c * (w + 1)) / 2 + k % c * (w + 1), 6) as x, round((61 - r * (h + 1)) / 2 + floor(k::DOUBLE / c) * (h + 1), 6) as y from r"""


def kerf_bands(s, d):
    """The rim of each rectangle as an offcut."""
    r = view(s, d, "g_rect")
    return r.select("id", G.kerf_band(F.col("x_min"), F.col("y_min"), F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"), 1.0).alias("band"))


_BOX = "'M' || printf('%.2f', {x}) || ',' || printf('%.2f', {y}) || ' h' || printf('%.2f', {w}) || ' v' || printf('%.2f', {h}) || ' h' || printf('%.2f', -({w})) || ' z'"
KERF = ctes("g_rect") + f", r as (select *, x_max - x_min as w, y_max - y_min as h from g_rect) select id, {_BOX.format(x='x_min', y='y_min', w='w', h='h')} || case when w > 2 and h > 2 then ' ' || {_BOX.format(x='x_min + 1', y='y_min + 1', w='w - 2', h='h - 2')} else '' end as band from r"


def solution_roundtrip(s, d):
    """Placements written as the JSON of solutions of a thousand sheets each, and read again."""
    p = view(s, d, "g_placement")
    placed = p.select(F.col("sheet").alias("layout"), (F.col("sheet") % 7).alias("container_id"), F.col("item").alias("item_id"), F.radians("rot").alias("rot"), F.col("x_min").alias("tx"), F.col("y_min").alias("ty"))
    density = p.groupBy(F.col("sheet").alias("layout")).agg((F.count("*") / 10).alias("density"))
    per = density.select(F.floor(F.col("layout") / 1000).alias("solution"), "layout", F.lit(0.5).alias("density"), F.lit(1).alias("run_time_sec"), F.lit(10).cast("long").alias("cost"))
    got = I.read_solutions(I.solutions_json(placed, density, per, "bins"))
    return got.select("solution", "container_id", "item_id", F.round(F.degrees("rot")).cast("int").alias("rot"), "tx", "ty")


ROUNDTRIP = ctes("g_placement") + " select floor(sheet / 1000)::BIGINT as solution, sheet % 7 as container_id, item as item_id, rot, x_min as tx, y_min as ty from g_placement"

QUERIES = {
    "q69_polygon_collisions": (polygon_collisions, POLYGON_COLLISIONS),
    "q70_cell_presence": (cell_presence, CELL_PRESENCE),
    "q71_strongest_hazard": (strongest_hazard, STRONGEST),
    "q72_fit_check": (fit_check, FIT_CHECK),
    "q73_surrogates": (surrogates, ctes("g_poly") + " select id, 2::BIGINT as piers, true as inside from g_poly"),
    "q74_decimate": (decimate, ctes("g_poly") + " select id, len(ring)::INTEGER as before, true as ring_left, true as kept, true as near from g_poly"),
    "q75_close_bays": (close_bays, ctes("g_poly") + " select id, len(ring)::INTEGER as before, true as grows, true as within, true as simple from g_poly"),
    "q76_sanitize": (sanitize, ctes("g_poly") + " select id, true as ring_left, true as kept, true as simple from g_poly"),
    "q77_adaptive_waves": (adaptive_waves, NESTED),
    "q78_unplaced_grid": (unplaced_grid, UNPLACED),
    "q79_kerf_bands": (kerf_bands, KERF),
    "q80_solution_roundtrip": (solution_roundtrip, ROUNDTRIP),
}
