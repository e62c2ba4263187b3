"""Simple polygons as open counter-clockwise rings: array<struct<x: double, y: double>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import edge as E
from tessera.functions.rect import Rect


def after(ring: Column) -> Column:
    """The ring begun one vertex later."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def before(ring: Column) -> Column:
    return F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))


def edges(ring: Column) -> Column:
    return F.zip_with(ring, after(ring), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def as_edge(e: Column) -> E.Edge:
    return E.Edge(e["x1"], e["y1"], e["x2"], e["y2"])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def signed_area(ring: Column) -> Column:
    """Shoelace; positive counter-clockwise."""
    return total(F.transform(edges(ring), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2


def bbox(ring: Column) -> Rect:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return Rect(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def centroid(ring: Column) -> tuple[Column, Column]:
    def moment(axis: str) -> Column:
        return total(F.transform(edges(ring), lambda e: (e[f"{axis}1"] + e[f"{axis}2"]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"])))

    six = signed_area(ring) * 6
    return moment("x") / six, moment("y") / six


def diameter(ring: Column) -> Column:
    """Largest distance of two vertices."""
    far = F.transform(ring, lambda a: F.array_max(F.transform(ring, lambda b: (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))))
    return F.sqrt(F.array_max(far))


def has_point(ring: Column, x: Column, y: Column) -> Column:
    """Parity of edges to the right; an end level with the ray counts with the edge whose other end is below."""
    crossing = F.filter(edges(ring), lambda e: ((e["y1"] < y) & (e["y2"] >= y) | (e["y2"] < y) & (e["y1"] >= y)) & (x < e["x1"] + (y - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])))
    return F.size(crossing) % 2 == 1


def crossings(ring: Column) -> Column:
    """array<struct<i, j>>: pairs of edges, not neighbours, that collide."""
    es, n = edges(ring), F.size(ring)
    pairs = F.flatten(F.transform(es, lambda a, i: F.transform(F.filter(F.transform(es, lambda b, j: F.struct(i.alias("i"), j.alias("j"), E.collides(as_edge(a), as_edge(b)).alias("hit"))), lambda p: (p["j"] > p["i"] + 1) & ~((p["i"] == 0) & (p["j"] == n - 1)) & p["hit"]), lambda p: F.struct(p["i"], p["j"]))))
    return pairs


def corner_types(ring: Column) -> Column:
    """Of each vertex with its neighbours: Convex, Concave or Collinear."""
    three = F.arrays_zip(before(ring).alias("p"), ring.alias("q"), after(ring).alias("r"))
    turn = F.transform(three, lambda t: (t["q"]["x"] - t["p"]["x"]) * (t["r"]["y"] - t["p"]["y"]) - (t["q"]["y"] - t["p"]["y"]) * (t["r"]["x"] - t["p"]["x"]))
    return F.transform(turn, lambda c: F.when(c > 0, "Convex").when(c < 0, "Concave").otherwise("Collinear"))


def without_repeats(ring: Column, tolerance: float = 0.0) -> Column:
    """Without vertices that equal the next one."""
    both = F.zip_with(ring, after(ring), lambda a, b: F.struct(a.alias("a"), ((F.abs(a["x"] - b["x"]) > tolerance) | (F.abs(a["y"] - b["y"]) > tolerance)).alias("keep")))
    return F.transform(F.filter(both, lambda p: p["keep"]), lambda p: p["a"])


def hull_size(ring: Column) -> Column:
    """Vertices of the convex hull: heads of directed pairs with every vertex on their left, or on them."""
    def left(a: Column, b: Column) -> Column:
        return F.forall(ring, lambda c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]) >= 0)

    return F.size(F.filter(ring, lambda a: F.exists(ring, lambda b: ((a["x"] != b["x"]) | (a["y"] != b["y"])) & left(a, b))))


def distance(ring: Column, x: Column, y: Column) -> Column:
    """To the boundary."""
    return F.array_min(F.transform(edges(ring), lambda e: E.distance(as_edge(e), x, y)))


def counter_clockwise(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def of_rect(r: Rect) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((r.x0, r.y0), (r.x1, r.y0), (r.x1, r.y1), (r.x0, r.y1))])


def moved(ring: Column, m) -> Column:
    from tessera.functions.affine import apply

    def one(p: Column) -> Column:
        x, y = apply(m, p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, one)


def collides(a: Column, b: Column, boxes: tuple[Rect, Rect] | None = None) -> Column:
    """Edges that meet, or one ring inside the other. boxes of both, if they are at hand, leave out edges that reach neither."""
    def near(ring: Column, box: Rect | None) -> Column:
        if box is None:
            return edges(ring)
        reach = lambda e, v, low, high: (F.greatest(e[f"{v}1"], e[f"{v}2"]) >= low) & (F.least(e[f"{v}1"], e[f"{v}2"]) <= high)
        return F.filter(edges(ring), lambda e: reach(e, "x", box.x0, box.x1) & reach(e, "y", box.y0, box.y1))

    of_a, of_b = boxes or (None, None)
    # an array of one array: its edges are made once, not for every edge of the other ring
    crossing = F.exists(F.array(near(b, of_a)), lambda fs: F.exists(near(a, of_b), lambda e: F.exists(fs, lambda f: E.collides(as_edge(e), as_edge(f)))))
    return crossing | has_point(b, a[0]["x"], a[0]["y"]) | has_point(a, b[0]["x"], b[0]["y"])


def presence(ring: Column, cell: Rect) -> tuple[Column, Column]:
    """(None, Partial or Entire, number of edges that reach the cell): Partial if any edge does, else by the cell's centre."""
    n = F.size(F.filter(edges(ring), lambda e: E.hits_rect(as_edge(e), cell)))
    within = has_point(ring, (cell.x0 + cell.x1) / 2, (cell.y0 + cell.y1) / 2)
    return F.when(n > 0, "Partial").when(within, "Entire").otherwise("None"), n
