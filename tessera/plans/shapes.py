"""Queries of scalar geometry: rectangles, circles, segments, rings, maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import affine as A
from tessera.functions import circle as C
from tessera.functions import edge as E
from tessera.functions import rect as R
from tessera.functions import ring as P
from tessera.operators.spatial import prefixed, spatial_join
from tessera.plans.views import ctes, view


def r6(c: Column, name: str) -> Column:
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def _pairs(s, d, a: str, b: str, exact=None) -> DataFrame:
    return spatial_join(prefixed(boxed(s, d, a), "a_"), prefixed(boxed(s, d, b), "b_"), exact)


def boxed(s, d, name: str) -> DataFrame:
    """A view with bounding boxes."""
    df = view(s, d, name)
    box = {"g_circle": lambda: C.bbox(C.circle()), "g_edge": lambda: E.bbox(E.edge()), "g_poly": lambda: P.bbox(F.col("ring")), "g_point": lambda: R.Rect(*[F.col(c) for c in "xyxy"])}.get(name)
    return df.withColumns(dict(zip(("x_min", "y_min", "x_max", "y_max"), box(), strict=True))) if box else df


def rect_metrics(s, d):
    r = R.rect()
    cx, cy = R.centroid(r)
    sq = R.squared(r)
    return view(s, d, "g_rect").select("id", R.width(r).alias("w"), R.height(r).alias("h"), R.area(r).alias("area"), r6(R.diameter(r), "diameter"), cx.alias("cx"), cy.alias("cy"), R.width(sq).alias("side"), R.area(R.scaled(r, 2.0)).alias("scaled"), F.when(R.valid(R.resized(r, -3.0)), R.area(R.resized(r, -3.0))).alias("shrunk"))


RECT_METRICS = ctes("g_rect") + """ select id, x_max - x_min as w, y_max - y_min as h, (x_max - x_min) * (y_max - y_min) as area, round(sqrt((x_max - x_min) ** 2 + (y_max - y_min) ** 2), 6) as diameter,
 (x_min + x_max) / 2 as cx, (y_min + y_max) / 2 as cy, greatest(x_max - x_min, y_max - y_min) as side, 4 * (x_max - x_min) * (y_max - y_min) as scaled,
 case when x_max - x_min > 6 and y_max - y_min > 6 then (x_max - x_min - 6) * (y_max - y_min - 6) end as shrunk from g_rect"""

_NEAR = "a.sheet = b.sheet and a.x_min <= b.x_max and b.x_min <= a.x_max and a.y_min <= b.y_max and b.y_min <= a.y_max"


def rect_relation(s, d):
    a, b = R.rect("a_"), R.rect("b_")
    return _pairs(s, d, "g_rect", "g_rect").where("a_id <> b_id").select("a_id", "b_id", R.relation(a, b).alias("relation"))


RECT_RELATION = ctes("g_rect") + f""" select a.id as a_id, b.id as b_id, case when a.x_min <= b.x_min and a.y_min <= b.y_min and a.x_max >= b.x_max and a.y_max >= b.y_max then 'Surrounding'
 when b.x_min <= a.x_min and b.y_min <= a.y_min and b.x_max >= a.x_max and b.y_max >= a.y_max then 'Enclosed' else 'Intersecting' end as relation from g_rect a join g_rect b on {_NEAR} where a.id <> b.id"""


def rect_overlap(s, d):
    return _pairs(s, d, "g_rect", "g_rect").where("a_id < b_id").select("a_id", "b_id")


RECT_OVERLAP = ctes("g_rect") + f" select a.id as a_id, b.id as b_id from g_rect a join g_rect b on {_NEAR} where a.id < b.id"


def rect_intersection(s, d):
    a, b = R.rect("a_"), R.rect("b_")
    both = R.bounding(a, b)
    return _pairs(s, d, "g_rect", "g_rect").where("a_id < b_id").select("a_id", "b_id", R.overlap_area(a, b).alias("shared"), R.area(both).alias("bounding"))


RECT_INTERSECTION = ctes("g_rect") + f""" select a.id as a_id, b.id as b_id, nullif((least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min)) * (least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min)), 0.0) as shared,
 (greatest(a.x_max, b.x_max) - least(a.x_min, b.x_min)) * (greatest(a.y_max, b.y_max) - least(a.y_min, b.y_min)) as bounding from g_rect a join g_rect b on {_NEAR} where a.id < b.id"""


def rect_quadrants(s, d):
    return view(s, d, "g_rect").select("id", F.posexplode(R.quadrants(R.rect())).alias("quadrant", "q")).select("id", "quadrant", "q.*")


RECT_QUADRANTS = ctes("g_rect") + """, m as (select *, (x_min + x_max) / 2 as cx, (y_min + y_max) / 2 as cy from g_rect)
 select id, 0::INTEGER as quadrant, cx as x_min, cy as y_min, x_max, y_max from m union all select id, 1, x_min, cy, cx, y_max from m
 union all select id, 2, x_min, y_min, cx, cy from m union all select id, 3, cx, y_min, x_max, cy from m"""


def point_rect(s, d):
    rects, points = prefixed(view(s, d, "g_rect"), "r_"), view(s, d, "g_point")
    n = rects.select(F.count("*").alias("n"))
    both = points.crossJoin(F.broadcast(n)).withColumn("r_id", F.pmod("id", "n") + 1).join(rects, "r_id")
    pos, dist = R.separation(R.rect("r_"), F.col("x"), F.col("y"))
    return both.select("id", "r_id", pos.alias("position"), r6(dist, "distance"))


POINT_RECT = ctes("g_rect", "g_point") + """ select p.id, r.id as r_id, case when inside then 'Interior' else 'Exterior' end as position,
 round(case when inside then least(x - x_min, x_max - x, y - y_min, y_max - y) else sqrt(greatest(x_min - x, 0, x - x_max) ** 2 + greatest(y_min - y, 0, y - y_max) ** 2) end, 6) as distance
 from (select p.*, r.id as rid, x between x_min and x_max and y between y_min and y_max as inside from g_point p join g_rect r on r.id = p.id % (select count(*) from part) + 1) p join g_rect r on r.id = rid"""


def circle_circle(s, d):
    a, b = C.circle("a_"), C.circle("b_")
    pos, dist = C.separation_circle(a, b)
    return _pairs(s, d, "g_circle", "g_circle", lambda: C.hits_circle(a, b)).where("a_id < b_id").select("a_id", "b_id", pos.alias("position"), r6(dist, "depth"))


CIRCLE_CIRCLE = ctes("g_circle") + """ select a.id as a_id, b.id as b_id, 'Interior' as position, round(abs(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) - a.r - b.r), 6) as depth
 from g_circle a join g_circle b on a.sheet = b.sheet and a.id < b.id where (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 <= (a.r + b.r) ** 2"""


def circle_rect(s, d):
    return _pairs(s, d, "g_circle", "g_rect", lambda: C.hits_rect(C.circle("a_"), R.rect("b_"))).select("a_id", "b_id")


_TO_RECT = "greatest(x_min - cx, 0, cx - x_max) ** 2 + greatest(y_min - cy, 0, cy - y_max) ** 2"
CIRCLE_RECT = ctes("g_circle", "g_rect") + f" select c.id as a_id, r.id as b_id from g_circle c join g_rect r on c.sheet = r.sheet where {_TO_RECT} <= c.r ** 2"

_CLOSEST = "greatest(0.0, least(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))"


def circle_edge(s, d):
    return _pairs(s, d, "g_circle", "g_edge", lambda: C.hits_edge(C.circle("a_"), E.edge("b_"))).select("a_id", "b_id")


CIRCLE_EDGE = ctes("g_circle", "g_edge") + f""", m as (select c.id as a_id, e.id as b_id, r, cx as px, cy as py, x1, y1, x2, y2 from g_circle c join g_edge e on c.sheet = e.sheet and cx + r >= x1 and cx - r <= x2),
 t as (select *, {_CLOSEST} as t from m) select a_id, b_id from t where sqrt((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2) <= r"""


def bounding_circle(s, d):
    each = F.array_sort(F.collect_list(F.struct("id", "cx", "cy", "r")))
    groups = view(s, d, "g_circle").withColumn("team", F.floor(F.col("id") / 8)).groupBy("team").agg(each.alias("c"))
    b = C.bounding(F.transform("c", lambda x: F.struct(x["cx"].alias("cx"), x["cy"].alias("cy"), x["r"].alias("r"))))
    return groups.select("team", F.round(b["cx"], 4).alias("cx"), F.round(b["cy"], 4).alias("cy"), F.round(b["r"], 4).alias("r"), F.round(C.area(C.Circle(b["cx"], b["cy"], b["r"])), 2).alias("area"))


#: A fold over the circles of a team: each that is not inside yet widens the last one just enough.
_FAR = "sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2)"
_WIDER = f"(({_FAR} + p.r + q.r) / 2)"
_PART = f"case when {_FAR} > 0 then ({_WIDER} - p.r) / {_FAR} else 0 end"
BOUNDING = ctes("g_circle") + f""", t as (select floor(id / 8)::BIGINT as team, list({{'x': cx, 'y': cy, 'r': r}} order by id) as circles from g_circle group by 1),
 w as (select team, list_reduce(circles, lambda p, q: case when {_FAR} + q.r <= p.r then p when {_FAR} + p.r <= q.r then q else {{'x': p.x + (q.x - p.x) * {_PART}, 'y': p.y + (q.y - p.y) * {_PART}, 'r': {_WIDER}}} end) as b from t)
 select team, round(b.x, 4) as cx, round(b.y, 4) as cy, round(b.r, 4) as r, round(pi() * b.r * b.r, 2) as area from w"""


def edge_edge(s, d):
    a, b = E.edge("a_"), E.edge("b_")
    x, y = E.meeting(a, b)
    return _pairs(s, d, "g_edge", "g_edge", lambda: E.collides(a, b)).where("a_id < b_id").select("a_id", "b_id", r6(x, "x"), r6(y, "y"))


EDGE_EDGE = ctes("g_edge") + """, m as (select a.id as a_id, b.id as b_id, a.x1, a.y1, a.x2 - a.x1 as ax, a.y2 - a.y1 as ay, b.x2 - b.x1 as ex, b.y2 - b.y1 as ey, b.x1 - a.x1 as sx, b.y1 - a.y1 as sy
 from g_edge a join g_edge b on a.sheet = b.sheet and a.id < b.id and a.x1 <= b.x2 and b.x1 <= a.x2), k as (select *, ax * ey - ay * ex as det from m where ax * ey - ay * ex <> 0),
 t as (select *, (sx * ey - sy * ex) / det as t, (sx * ay - sy * ax) / det as u from k)
 select a_id, b_id, round(x1 + t * ax, 6) as x, round(y1 + t * ay, 6) as y from t where t between 0 and 1 and u between 0 and 1"""


def edge_rect(s, d):
    return _pairs(s, d, "g_edge", "g_rect", lambda: E.hits_rect(E.edge("a_"), R.rect("b_"))).select("a_id", "b_id")


EDGE_RECT = ctes("g_edge", "g_rect") + """, m as (select e.id as a_id, r.id as b_id, x1, y1, x2 - x1 as dx, y2 - y1 as dy, x2, y2, x_min, y_min, x_max, y_max from g_edge e join g_rect r on e.sheet = r.sheet
 and least(x1, x2) <= x_max and x_min <= greatest(x1, x2) and least(y1, y2) <= y_max and y_min <= greatest(y1, y2)),
 c as (select *, dx * (y_max - y1) - dy * (x_max - x1) as s1, dx * (y_max - y1) - dy * (x_min - x1) as s2, dx * (y_min - y1) - dy * (x_min - x1) as s3, dx * (y_min - y1) - dy * (x_max - x1) as s4 from m)
 select a_id, b_id from c where not (least(s1, s2, s3, s4) > 0 or greatest(s1, s2, s3, s4) < 0)"""


def edge_point(s, d):
    px, py = F.col("cust") % 1000 * 1.0, (F.col("cust") * 3) % 1000 * 1.0
    x, y = E.closest(E.edge(), px, py)
    return view(s, d, "g_edge").select("id", r6(x, "x"), r6(y, "y"), r6(E.distance(E.edge(), px, py), "distance"))


EDGE_POINT = ctes("g_edge") + f""", m as (select *, (cust % 1000)::DOUBLE as px, ((cust * 3) % 1000)::DOUBLE as py from g_edge), t as (select *, {_CLOSEST} as t from m)
 select id, round(x1 + t * (x2 - x1), 6) as x, round(y1 + t * (y2 - y1), 6) as y, round(sqrt((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2), 6) as distance from t"""


def edge_ops(s, d):
    e = E.edge()
    cx, cy = E.centroid(e)
    longer, twice, back = E.extend(e, 2.0, 3.0), E.scale(e, 2.0), E.reverse(e)
    return view(s, d, "g_edge").select("id", r6(E.length(e), "length"), cx.alias("cx"), cy.alias("cy"), r6(E.length(longer), "longer"), r6(longer.x1, "front"), r6(E.length(twice), "twice"), back.x1.alias("back"), E.bbox(e).y1.alias("top"))


EDGE_OPS = ctes("g_edge") + """, m as (select *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) as n from g_edge)
 select id, round(n, 6) as length, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, round(n + 5, 6) as longer, round(x1 - 2 * (x2 - x1) / n, 6) as front, round(2 * n, 6) as twice, x2 as back, greatest(y1, y2) as top from m"""

#: Rows of a ring's vertices with their neighbours.
_V = """, v as (select id, i, ring[i].x as x, ring[i].y as y, ring[i % len(ring) + 1].x as nx, ring[i % len(ring) + 1].y as ny, ring[(i + len(ring) - 2) % len(ring) + 1].x as px, ring[(i + len(ring) - 2) % len(ring) + 1].y as py
 from (select id, ring, unnest(range(1, len(ring) + 1)) as i from g_poly))"""


def ring_area(s, d):
    p = F.col("ring")
    (cx, cy), box = P.centroid(p), P.bbox(p)
    return view(s, d, "g_poly").select("id", F.round(P.signed_area(p), 4).alias("area"), F.round(cx, 4).alias("cx"), F.round(cy, 4).alias("cy"), *[F.round(c, 4).alias(n) for c, n in zip(box, ("x_min", "y_min", "x_max", "y_max"), strict=True)], F.size("ring").cast("long").alias("n"))


RING_AREA = ctes("g_poly") + _V + """, a as (select id, sum(x * ny - nx * y) / 2 as area, sum((x + nx) * (x * ny - nx * y)) as mx, sum((y + ny) * (x * ny - nx * y)) as my, min(x) as x_min, min(y) as y_min, max(x) as x_max, max(y) as y_max, count(*) as n from v group by id)
 select id, round(area, 4) as area, round(mx / 6 / area, 4) as cx, round(my / 6 / area, 4) as cy, x_min, y_min, x_max, y_max, n from a"""


def ring_diameter(s, d):
    return view(s, d, "g_poly").select("id", F.round(P.diameter(F.col("ring")), 4).alias("diameter"))


RING_DIAMETER = ctes("g_poly") + _V + " select a.id, round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 4) as diameter from v a join v b on a.id = b.id group by a.id"


def point_in_polygon(s, d):
    rows = _pairs(s, d, "g_point", "g_poly", lambda: P.has_point(F.col("b_ring"), F.col("a_x"), F.col("a_y")))
    return rows.select("a_id", "b_id", F.round(P.distance(F.col("b_ring"), F.col("a_x"), F.col("a_y")), 4).alias("depth"))


POINT_IN_POLYGON = ctes("g_point", "g_poly") + _V + """, e as (select p.id as a_id, q.id as b_id, p.x as px0, p.y as py0, v.x as x1, v.y as y1, v.nx as x2, v.ny as y2 from g_point p join (select id, any_value(sheet) as sheet, min(v.x) as x_min, max(v.x) as x_max, min(v.y) as y_min, max(v.y) as y_max from v join g_poly using (id) group by id) q
  on p.sheet = q.sheet and p.x between x_min and x_max and p.y between y_min and y_max join v on v.id = q.id),
 t as (select *, greatest(0.0, least(1.0, ((px0 - x1) * (x2 - x1) + (py0 - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) as t from e)
 select a_id, b_id, round(min(sqrt((px0 - x1 - t * (x2 - x1)) ** 2 + (py0 - y1 - t * (y2 - y1)) ** 2)), 4) as depth from t group by a_id, b_id
 having count(*) filter (where ((y1 < py0 and y2 >= py0) or (y2 < py0 and y1 >= py0)) and px0 < x1 + (py0 - y1) / (y2 - y1) * (x2 - x1)) % 2 = 1"""

#: Rings of which every third has two vertices exchanged, and every fifth a repeated vertex.
_BENT = ", g_bent as (select id, case when id % 3 = 0 then [ring[5], ring[2], ring[3], ring[4], ring[1]] || ring[6:12] when id % 5 = 0 then ring[1:4] || [ring[4]] || ring[5:12] else ring end as ring from g_poly)"


def bent(s, d) -> DataFrame:
    p = F.col("ring")
    swapped = F.concat(F.array(p[4], p[1], p[2], p[3], p[0]), F.slice(p, 6, 7))
    twice = F.concat(F.slice(p, 1, 4), F.array(p[3]), F.slice(p, 5, 8))
    return view(s, d, "g_poly").select("id", F.when(F.col("id") % 3 == 0, swapped).when(F.col("id") % 5 == 0, twice).otherwise(p).alias("ring"))


def self_intersection(s, d):
    return bent(s, d).select("id", F.size(P.crossings(F.col("ring"))).cast("long").alias("n"))


SELF_INTERSECTION = ctes("g_poly") + _BENT + _V.replace("from g_poly", "from g_bent") + """, m as (select a.id, a.x as x1, a.y as y1, a.nx - a.x as ax, a.ny - a.y as ay, b.nx - b.x as ex, b.ny - b.y as ey, b.x - a.x as sx, b.y - a.y as sy, n
  from v a join v b on a.id = b.id join (select id, len(ring) as n from g_bent) z on z.id = a.id where b.i > a.i + 1 and not (a.i = 1 and b.i = n)),
 h as (select id, ax * ey - ay * ex as det, sx * ey - sy * ex as t, sx * ay - sy * ax as u from m)
 select g.id, count(h.id) filter (where det <> 0 and t / det between 0 and 1 and u / det between 0 and 1) as n from g_bent g left join h on g.id = h.id group by g.id"""


def corner_types(s, d):
    return view(s, d, "g_poly").select("id", F.posexplode(P.corner_types(F.col("ring"))).alias("i", "corner"))


CORNER_TYPES = ctes("g_poly") + _V + """ select id, (i - 1)::INTEGER as i, case when (x - px) * (ny - py) - (y - py) * (nx - px) > 0 then 'Convex' when (x - px) * (ny - py) - (y - py) * (nx - px) < 0 then 'Concave' else 'Collinear' end as corner from v"""


def convex_hull(s, d):
    return view(s, d, "g_poly").select("id", P.hull_size(F.col("ring")).cast("long").alias("n"))


CONVEX_HULL = ctes("g_poly") + _V + """, h as (select a.id, a.i from v a join v b on a.id = b.id and a.i <> b.i join v c on c.id = a.id group by a.id, a.i, b.i having bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) >= 0))
 select id, count(distinct i) as n from h group by id"""


def degenerate_vertices(s, d):
    clean = P.without_repeats(F.col("ring"))
    return bent(s, d).select("id", F.size("ring").cast("long").alias("before"), F.size(clean).cast("long").alias("after"), F.round(P.signed_area(clean), 4).alias("area"))


DEGENERATE_VERTICES = ctes("g_poly") + _BENT + _V.replace("from g_poly", "from g_bent") + " select id, count(*) as before, count(*) filter (where x <> nx or y <> ny) as after, round(sum(x * ny - nx * y) / 2, 4) as area from v group by id"


def _map(s, d) -> tuple[DataFrame, A.Affine]:
    rows = view(s, d, "g_rect").withColumn("angle", F.radians((F.col("id") * 37) % 360 * 1.0))
    return rows, A.rigid(F.col("angle"), F.col("x_min"), F.col("y_min"))


def affine_compose(s, d):
    rows, m = _map(s, d)
    k = A.then(m, A.rigid(F.radians(F.lit(30.0)), F.lit(5.0), F.lit(-2.0)))
    x, y = A.apply(k, F.col("size") * 1.0, F.lit(1.0))
    return rows.select("id", *[r6(v, n) for v, n in zip(k, A.Affine._fields, strict=True)], r6(x, "x"), r6(y, "y"))


_MAP = ", m as (select *, cos(radians((id * 37) % 360)) as c0, sin(radians((id * 37) % 360)) as s0, cos(radians(30)) as c1, sin(radians(30)) as s1 from g_rect)"
AFFINE_COMPOSE = ctes("g_rect") + _MAP + """, k as (select *, c1 * c0 - s1 * s0 as a, -c1 * s0 - s1 * c0 as b, c1 * x_min - s1 * y_min + 5 as tx, s1 * c0 + c1 * s0 as c, -s1 * s0 + c1 * c0 as d, s1 * x_min + c1 * y_min - 2 as ty from m)
 select id, round(a, 6) + 0.0 as a, round(b, 6) + 0.0 as b, round(tx, 6) + 0.0 as tx, round(c, 6) + 0.0 as c, round(d, 6) + 0.0 as d, round(ty, 6) + 0.0 as ty, round(a * size + b + tx, 6) + 0.0 as x, round(c * size + d + ty, 6) + 0.0 as y from k"""


def affine_inverse(s, d):
    rows, m = _map(s, d)
    back = A.inverse(m)
    x, y = A.apply(back, F.col("x_max"), F.col("y_max"))
    angle, _, _ = A.decompose(m)
    return rows.select("id", r6(back.tx, "tx"), r6(back.ty, "ty"), r6(x, "x"), r6(y, "y"), r6(F.cos(angle), "cosine"), A.is_identity(A.identity()).alias("same"))


AFFINE_INVERSE = ctes("g_rect") + _MAP + """ select id, round(-(c0 * x_min + s0 * y_min), 6) + 0.0 as tx, round(s0 * x_min - c0 * y_min, 6) + 0.0 as ty, round(c0 * (x_max - x_min) + s0 * (y_max - y_min), 6) + 0.0 as x,
 round(-s0 * (x_max - x_min) + c0 * (y_max - y_min), 6) + 0.0 as y, round(c0, 6) + 0.0 as cosine, true as same from m"""


def normalize_rotation(s, d):
    turn = (F.col("id") * 41 % 2000 - 1000) / 100.0
    return view(s, d, "g_rect").select("id", r6(A.normal_angle(turn), "angle"))


NORMALIZE_ROTATION = ctes("g_rect") + " select id, round(a - 2 * pi() * floor(a / (2 * pi())), 6) as angle from (select id, (id * 41 % 2000 - 1000) / 100.0::DOUBLE as a from g_rect)"


def transform_ring(s, d):
    m = A.rigid(F.radians((F.col("id") * 37) % 360 * 1.0), F.col("id") % 10 * 1.0, F.lit(3.0))
    ring = P.moved(F.col("ring"), m)
    box = P.bbox(ring)
    return view(s, d, "g_poly").select("id", F.round(P.signed_area(ring), 3).alias("area"), F.round(box.x0, 4).alias("x_min"), F.round(box.y1, 4).alias("y_max"))


TRANSFORM_RING = ctes("g_poly") + _V + """, m as (select id, cos(radians((id * 37) % 360)) * x - sin(radians((id * 37) % 360)) * y + id % 10 as x, sin(radians((id * 37) % 360)) * x + cos(radians((id * 37) % 360)) * y + 3 as y, (x * ny - nx * y) / 2 as part from v)
 select id, round(sum(part), 3) as area, round(min(x), 4) as x_min, round(max(y), 4) as y_max from m group by id"""

QUERIES = {
    "q01_rect_metrics": (rect_metrics, RECT_METRICS),
    "q02_rect_relation": (rect_relation, RECT_RELATION),
    "q03_rect_overlap_join": (rect_overlap, RECT_OVERLAP),
    "q04_rect_intersection": (rect_intersection, RECT_INTERSECTION),
    "q05_rect_quadrants": (rect_quadrants, RECT_QUADRANTS),
    "q06_point_rect_separation": (point_rect, POINT_RECT),
    "q07_circle_circle": (circle_circle, CIRCLE_CIRCLE),
    "q08_circle_rect": (circle_rect, CIRCLE_RECT),
    "q09_circle_edge": (circle_edge, CIRCLE_EDGE),
    "q10_bounding_circle": (bounding_circle, BOUNDING),
    "q11_edge_edge_intersection": (edge_edge, EDGE_EDGE),
    "q12_edge_rect": (edge_rect, EDGE_RECT),
    "q13_edge_point_distance": (edge_point, EDGE_POINT),
    "q14_edge_ops": (edge_ops, EDGE_OPS),
    "q15_ring_area_bbox_centroid": (ring_area, RING_AREA),
    "q16_ring_diameter": (ring_diameter, RING_DIAMETER),
    "q17_point_in_polygon": (point_in_polygon, POINT_IN_POLYGON),
    "q18_self_intersection": (self_intersection, SELF_INTERSECTION),
    "q19_corner_types": (corner_types, CORNER_TYPES),
    "q20_convex_hull": (convex_hull, CONVEX_HULL),
    "q21_degenerate_vertices": (degenerate_vertices, DEGENERATE_VERTICES),
    "q22_affine_compose": (affine_compose, AFFINE_COMPOSE),
    "q23_affine_inverse_decompose": (affine_inverse, AFFINE_INVERSE),
    "q24_normalize_rotation": (normalize_rotation, NORMALIZE_ROTATION),
    "q25_transform_ring": (transform_ring, TRANSFORM_RING),
}
