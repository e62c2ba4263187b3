"""Polygon nesting, its operators and the problems' operations against brute force and invariants."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import Search
from tessera.kernels import geometry as G
from tessera.kernels import nesting as N
from tessera.kernels import search as S
from tessera.operators import kernels as K
from tessera.operators import layouts as L
from tessera.operators import nesting as O
from tessera.streaming import requests as R


def star(seed, n=12, size=20.0):
    r = np.random.default_rng(seed).random(n) * size + 8
    t = np.arange(n) * 2 * np.pi / n
    return np.column_stack([r * np.cos(t), r * np.sin(t)])


def brute_meets(a, b):
    """Edges that cross, tested one by one, or a corner inside."""
    for i in range(len(a)):
        p, d = a[i], a[(i + 1) % len(a)] - a[i]
        for j in range(len(b)):
            q, e = b[j], b[(j + 1) % len(b)] - b[j]
            det = d[0] * e[1] - d[1] * e[0]
            if det:
                t, u = ((q - p)[0] * e[1] - (q - p)[1] * e[0]) / det, ((q - p)[0] * d[1] - (q - p)[1] * d[0]) / det
                if 0 <= t <= 1 and 0 <= u <= 1:
                    return True
    return bool(G.inside(a[:1], b)[0] or G.inside(b[:1], a)[0])


def test_bodies_meet_as_by_brute_force():
    r = np.random.default_rng(1)
    hits = 0
    for k in range(200):
        a, b = star(k), star(k + 1000) + r.uniform(-60, 60, 2)
        hits += brute_meets(a, b)
        assert N.Body(a).meets(b) == brute_meets(a, b)
    assert 40 < hits < 160


def rings_of(layout, parts):
    by = {p.id: p.ring for p in parts}
    return [N.turned(by[i], a) + np.array([x, y]) for i, a, x, y, _ in layout.placed]


@pytest.mark.parametrize("gap", [0.0, 1.5])
def test_bins_strips_and_zones(gap):
    zone = N.box(20, 20) + 40
    parts = [N.Part(k, star(k), 1 + k % 2, None if k % 3 == 0 else (0.0, math.pi / 2), 2 if k % 2 else None) for k in range(6)]
    bins = N.fill_bins(parts, [N.Sheet(7, N.box(160, 120), 1), N.Sheet(8, N.box(140, 130), 99, 1, [(2, zone)])], gap, 3, 1500)
    assert sum(len(b.placed) for b in bins) == 9 and sum(b.sheet.id == 7 for b in bins) <= 1
    again = N.fill_bins(parts, [N.Sheet(7, N.box(160, 120), 1), N.Sheet(8, N.box(140, 130), 99, 1, [(2, zone)])], gap, 3, 1500)
    assert [[p[:4] for p in b.placed] for b in bins] == [[p[:4] for p in b.placed] for b in again]
    one = N.fill_strips(parts, 90.0, gap, 3, samples=1500)
    many = N.fill_strips(parts, 90.0, gap, 3, 120.0, samples=1500)
    assert len(one) == 1 and len(many) > 1 and all(s.sheet.ring[:, 0].max() <= 120 + 1e-6 for s in many)
    wide = {p.id: N.Model.of(p, gap).ring for p in parts}
    reach = {p.id: min(G.edge_distances(p.ring, wide[p.id]).min(), G.edge_distances(wide[p.id], p.ring).min()) for p in parts}
    assert not gap or min(reach.values()) > 0.4 * gap / 2
    for layouts in (bins, one, many):
        assert sum(len(x.placed) for x in layouts) == 9
        for layout in layouts:
            rings, whole = rings_of(layout, parts), layout.sheet.ring
            assert all((r.min(0) >= whole.min(0) + gap / 2 - 1e-5).all() and (r.max(0) <= whole.max(0) - gap / 2 + 1e-4).all() for r in rings)
            for i, a in enumerate(rings):
                assert not any(brute_meets(a, b) for b in rings[:i])
                if gap:  # round joins have corners, and offsets that would cross themselves are smaller
                    own = [reach[p[0]] for p in layout.placed]
                    assert all(G.edge_distances(a, b).min() >= own[i] + own[j] - 1e-4 for j, b in enumerate(rings[:i]))
    for b in bins:
        for (i, *_), r in zip(b.placed, rings_of(b, parts), strict=True):
            assert not b.sheet.zones or i % 2 or not brute_meets(r, zone)


def test_parts_that_fit_nowhere_are_left_out():
    big, small = N.Part(1, N.box(300, 300) - 150), N.Part(2, N.box(10, 10) - 5)
    assert [p[0] for b in N.fill_bins([big, small], [N.Sheet(0, N.box(50, 50), 9)], 1.0, 0, 600) for p in b.placed] == [2]
    assert [p[0] for s in N.fill_strips([big, small], 50.0, 1.0, 0, 80.0, 600) for p in s.placed] == [2]


def test_triangles_pair_up_densely():
    tri = np.array([(0.0, 0.0), (300.0, 0.0), (0.0, 100.0)])
    at = N.lattice_sheet(tri, 2.0, (980.0, 2000.0))
    rings = [N.turned(tri, a) + np.array([x, y]) for a, x, y in at]
    assert len(at) * 15_000 / (980 * 2000) > 0.8
    assert not any(N.Body(a).meets(b) for i, a in enumerate(rings) for b in rings[:i])
    assert all(r.min() >= 1 - 1e-6 and r[:, 0].max() <= 979 + 1e-6 and r[:, 1].max() <= 1999 + 1e-6 for r in rings)
    assert len(N.lattice_sheet(tri, 2.0, (980.0, 2000.0), half_turns=False)) < len(at)


def test_internal_shapes():
    ring = star(5)
    whole = O.internal(ring, Search(separation=2.0, simplify=0.01))
    assert not G.crossings(whole) and G.area(whole) > G.area(ring) and G.inside(ring, whole).all()
    assert G.area(O.internal(ring, Search(separation=2.0, simplify=None, concavity=None), grow=False)) < G.area(ring)
    assert np.allclose(O.internal(ring, Search(simplify=None, concavity=None)), ring)


def test_union_of_rectangles():
    r = np.random.default_rng(2)
    for _ in range(50):
        boxes = [(int(x), int(y), int(x + w), int(y + h)) for x, y, w, h in np.column_stack([r.integers(0, 12, (5, 2)), r.integers(1, 6, (5, 2))])]
        grid = np.zeros((20, 20), bool)
        for a, b, c, d in boxes:
            grid[a:c, b:d] = True
        got = G.joined(boxes)
        assert abs(sum(p["area"] for p in got) - grid.sum()) < 1e-9
        assert all(G.area(p["outer"]) > 0 and all(G.area(h) < 0 for h in p["holes"]) for p in got)
    assert G.joined([]) == []


def test_offcut_policies(spark):
    placed = spark.createDataFrame([(1, 0.0, 0.0, 40.0, 30.0), (1, 60.0, 0.0, 100.0, 30.0), (2, 0.0, 0.0, 100.0, 60.0)], "sheet long, x_min double, y_min double, x_max double, y_max double")
    got = {k: K.offcuts_by_policy(placed, (100.0, 60.0), 5.0, 5.0, k).collect() for k in ("RECTANGLE", "RECTANGLE_MERGED", "QUADRILATERAL")}
    assert all(sum(r.area for r in rows) == 3600 and {r.sheet for r in rows} == {1} for rows in got.values())
    assert [len(rows) for rows in got.values()] == [2, 1, 1] and len(got["RECTANGLE_MERGED"][0].outer) == 8
    with pytest.raises(ValueError, match="unknown shape"):
        K.offcuts_by_policy(placed, (100.0, 60.0), 5.0, 5.0, "ROUND")


def test_paths_to_pages(spark):
    frame = "M 0 0 H 100 V 100 H 0 Z M 20 20 H 80 V 80 H 20 Z"
    svgs = [(1, 10, 7, None, "M 0 0 L 300 0 L 0 100 Z"), (2, 20, 3, [0.0], frame), (2, 21, 2, None, "M 0 0 H 60 V 40 H 30 V 20 H 0 Z"), (3, 30, 1, None, "M 0 0")]
    parts = O.parts_of_svgs(spark.createDataFrame(svgs, "request long, id long, demand long, turns array<double>, path string")).persist()
    size = {r.id: r for r in O.measured(parts).where("ring is not null").collect()}
    assert (size[20].n_holes, size[20].vertices, size[20].area, size[20].rectangular) == (1, 4, 10_000.0, 1.0) and size[21].area == 1800 and size[10].rectangular == 0.5
    usable = parts.where("ring is not null")
    pages = O.nest(usable, (400.0, 300.0), 2.0, Search(samples=800)).persist()
    assert {(r.request, r.id): r.n for r in pages.groupBy("request", "id").agg(F.sum("copies").alias("n")).collect()} == {(1, 10): 7, (2, 20): 3, (2, 21): 2}
    out = O.results(pages, usable, (400.0, 300.0)).collect()
    assert all(0 < r.utilisation <= 1 and r.svg.count("<path") == r.parts_placed == len(r.placements) for r in out)
    assert O.overlaps(O.placed_rings(pages, usable), F.xxhash64("request", "page")).count() == 0
    placed = O.polygon_bins(usable.where("request = 2"), [N.Sheet(0, N.box(400, 300), 9)], 2.0, Search(samples=800))
    value = json.loads(O.solution_output(placed, "two", Search(samples=800)).first().value)
    assert value["instance"] == "two" and value["config"]["samples"] == 800 and sum(len(x["placed_items"]) for x in value["solution"]["layouts"]) == 5


def test_strip_and_bin_operations(spark):
    strips = spark.createDataFrame([(0, 100.0, 50.0, 400.0), (1, 80.0, 50.0, 400.0)], "sheet long, width double, height double, max_width double")
    more = L.add_strips(strips, spark.createDataFrame([(60.0, 50.0, 400.0), (70.0, 50.0, 400.0)], "width double, height double, max_width double"))
    assert sorted((r.sheet, r.width) for r in more.collect()) == [(0, 100.0), (1, 80.0), (2, 60.0), (3, 70.0)]
    assert L.strip_containers(strips).where("sheet = 1").first().ring[2] == (80.0, 50.0)
    placed = spark.createDataFrame([(0, 1, 5, 0.0, 40.0), (0, 2, 5, 40.0, 90.0)], "sheet long, id long, item long, x_min double, x_max double")
    fitted = {r.sheet: r.width for r in L.fit_strips(strips, placed, 0.5).collect()}
    assert fitted[1] == 80 and abs(fitted[0] - (90 * 1.00001 + 0.5)) < 1e-9
    new, out = L.resize(strips, placed, spark.createDataFrame([(0, 60.0)], "sheet long, new_width double"))
    assert {r.sheet: r.width for r in new.collect()} == {0: 60.0, 1: 80.0} and [r.id for r in out.collect()] == [2]
    assert [r.sheet for r in L.close_empty(strips, placed).collect()] == [0]
    bins, used = spark.createDataFrame([(9, 3)], "id long, stock long"), spark.createDataFrame([(0, 9), (1, 9), (1, 9)], "sheet long, bin long")
    assert [r.opened for r in L.open_bins(bins, used, spark.createDataFrame([(9, 5)], "bin long, n long")).collect()] == [1]
    assert [tuple(r) for r in L.included(placed, spark.createDataFrame([(5, 1), (6, 4)], "item long, demand long")).orderBy("item").collect()] == [(5, 1, 2, -1), (6, 4, 0, 4)]
    assert [r.id for r in L.dangling(spark.createDataFrame([(0, 1), (0, 8)], "sheet long, id long"), placed).collect()] == [8]
    pages = spark.createDataFrame([(1, "b"), (1, "a")], "request long, page string")
    assert sorted((r.page, r.sheet) for r in L.by_order(pages, spark.createDataFrame([(1, 30), (1, 20)], "request long, sheet long")).collect()) == [("a", 20), ("b", 30)]


def test_headers_and_improvements(spark):
    rows = spark.createDataFrame([(1, 3, "a"), (2, None, None)], "id long, attempt int, origin string")
    made = rows.select("id", F.when(F.col("attempt").isNotNull(), R.retry_headers(F.col("attempt"), F.col("origin"))).alias("h"))
    got = made.select("id", R.attempt_of(F.col("h")).alias("n"), R.origin_of(F.col("h"), F.lit("own")).alias("t")).orderBy("id").collect()
    assert [(r.n, r.t) for r in got] == [(3, "a"), (1, "own")]
    runs = spark.createDataFrame([("x", 0, 5, 0.5), ("x", 1, 5, 0.4), ("x", 2, 6, 0.3), ("x", 3, 6, 0.3), ("y", 0, 1, 0.1)], "correlation_id string, wave int, parts_placed int, utilisation double")
    assert sorted((r.correlation_id, r.wave, r.final) for r in R.improvements(runs).collect()) == [("x", 0, False), ("x", 2, True), ("y", 0, True)]


def test_half_planes_hold_every_step():
    for m in N.motifs(star(245), 1.0):
        body = G.hull(G.offset(G.hull(np.vstack([N.turned(star(245), a) + o for a, o in m])), 0.5))
        n, c = S.difference(body)[:2]
        assert (n @ (body[:, None] - body[None]).reshape(-1, 2).T <= c[:, None] + 1e-6).all()


def test_copies_of_a_pair_stay_apart():
    ring = np.array([[16.957899999999995, 0.0], [8.686900000000037, 5.0154], [7.180299999999988, 12.436599999999999], [0.0, 15.019600000000025], [-6.371999999999957, 11.036600000000021], [-9.561000000000035, 5.5201000000000136], [-13.82669999999996, 0.0], [-11.817800000000034, -6.822999999999979], [-7.330500000000029, -12.696900000000028], [0.0, -13.756199999999978], [5.675399999999968, -9.83019999999999], [10.495400000000018, -6.059500000000014]])
    rings = [N.turned(ring, a) + np.array([x, y]) for a, x, y in N.lattice_sheet(ring, 1.0, (220.0, 160.0))]
    assert not any(N.Body(a).meets(b) for i, a in enumerate(rings) for b in rings[:i])


def test_stretches_at_once_are_those_of_each_ray():
    r = np.random.default_rng(4)
    n, c, _ = S.difference(G.hull(r.normal(0, 20, (9, 2))))
    at, rays = r.normal(0, 30, (7, 2)), np.array([(math.cos(t), math.sin(t)) for t in np.linspace(0, 3, 6)])
    rays = np.vstack([rays, [-n[0, 1], n[0, 0]]])  # along an edge
    got = S._clips(n, c, at, rays)
    for v, row in zip(rays, got, strict=True):
        assert np.allclose(row, [S._clip(n, c, p, v) for p in at])


def test_collisions_by_boxes_are_those_of_all_edges(spark):
    from tessera.functions import ring as P
    from tessera.functions.rect import Rect

    ring = "array<struct<x:double,y:double>>"
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    pairs = [(square(0.0, 0.0, 4.0), square(4.0, 1.0, 2.0)), (square(0.0, 0.0, 4.0), square(4.0, 4.0, 2.0)), (square(0.0, 0.0, 9.0), square(3.0, 3.0, 2.0)), (square(0.0, 0.0, 4.0), square(4.5, 0.0, 2.0)), ([(0.0, 0.0), (9.0, 0.0), (0.0, 9.0)], square(6.0, 6.0, 2.0))]
    rows = spark.createDataFrame(pairs, f"a {ring}, b {ring}")
    a, b = F.col("a"), F.col("b")
    boxed = P.collides(a, b, (P.bbox(a), P.bbox(b)))
    assert rows.select(boxed, P.collides(a, b)).collect() == [(True, True), (True, True), (True, True), (False, False), (False, False)]


def test_many_copies_are_laid_and_checked_quickly(spark):
    import time

    ring = np.array([(20 * math.cos(t), 12 * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 13)[:-1]])
    began = time.process_time()
    for _ in range(3):
        assert N.lattice_sheet(ring, 1.0, (220.0, 160.0))
    assert (time.process_time() - began) / 3 < 0.08  # 0.11 with a call for every stretch


def test_hulls_and_differences_at_once_are_those_of_all_points():
    r = np.random.default_rng(0)
    for k in range(40):
        body = G.hull(r.normal(0, 20, (12, 2)) if k else N.box(30.0, 20.0))
        other, steps = -body if k % 2 else G.hull(r.normal(0, 9, (7, 2))), r.normal(0, 30, (20, 2))
        assert np.allclose(S.hull_areas(body, other, steps), [G.area(G.hull(np.vstack([body, other + v]))) for v in steps])
        every = (body[:, None] - other[None]).reshape(-1, 2)
        n, c, corners = S.difference(body, other)
        assert np.allclose(c, (n @ every.T).max(1)) and np.isclose(G.area(corners), G.area(G.hull(every)))


def test_phases_of_a_lattice_are_those_of_all_steps():
    ring, steps, sheet = star(3), (np.array([31.0, 4.0]), np.array([-9.0, 40.0])), (300.0, 200.0)
    room, m = np.array(sheet) - np.ptp(ring, axis=0), np.column_stack(steps)
    grid = np.array([(i, j) for i in range(-40, 41) for j in range(-40, 41)]) @ m.T
    most = 0
    for a in range(3):
        for b in range(3):
            at = grid + m @ np.array([a / 3, b / 3])
            most = max(most, int(((at >= -1e-9) & (at <= room + 1e-9)).all(1).sum()))
    at = S.fill_lattice(ring, steps, sheet) + ring.min(0)
    assert len(at) == most and ((at >= -1e-9) & (at <= room + 1e-9)).all() and len(np.unique(at.round(6), axis=0)) == most
    assert len(S.fill_lattice(ring, steps, (5.0, 5.0))) == 0


def test_lattices_of_a_request_are_found_once(spark):
    """Full sheets and the rest of the demand come from one pass over the parts."""
    ring = [(float(x), float(y)) for x, y in star(4).tolist()]
    schema = "request long, id long, ring array<struct<x:double,y:double>>, demand long, turns array<double>, quality int"
    pages = O.nest(spark.createDataFrame([(q, q, ring, d, None, None) for q, d in ((0, 101), (1, 3))], schema), (400.0, 300.0), 1.0)
    assert pages._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # lattices, left-bottom-fill
    got = pages.groupBy("request", "page", "copies").count().toPandas()
    assert {q: int((f["copies"] * f["count"]).sum()) for q, f in got.groupby("request")} == {0: 101, 1: 3}
    assert sorted(got[got.request == 0].page) == ["full", "rest"] and got[got.request == 1].page.tolist() == ["rest"]


def test_search_finds_the_best_of_all_tries_without_a_test_of_each_hazard(monkeypatch):
    """Of the same tries, each tested against every hazard, those of least loss; edges are crossed for many hazards at once."""
    crossed, calls = N.Body.crossed, []
    monkeypatch.setattr(N.Body, "crossed", lambda b, ring: calls.append(1) or crossed(b, ring))

    def brute(model, layout, draw, samples, local):
        low, high, best, cost = layout.outer.low, layout.outer.high.copy(), None, math.inf

        def attempt(tries):
            nonlocal best, cost
            for t, loss in zip(tries, N._loss(model, tries), strict=True):
                ring = N._moved(model.ring, t[None])[0]
                if loss < cost and layout.outer.holds(ring, ring.min(0), ring.max(0)) and not any(h.meets(ring) for h in layout.hazards(model.part.quality)):
                    best, cost = tuple(t.tolist()), float(loss)

        n_local = int(samples * local)
        for part in np.array_split(np.arange(samples - n_local), max(1, (samples - n_local) // 500)):
            n = len(part)
            angle = draw.uniform(0, 2 * math.pi, n)
            attempt(np.column_stack([angle, draw.uniform(low[0], high[0], n), draw.uniform(low[1], high[1], n)]))
            if best is not None:
                high[0] = min(high[0], max(low[0], cost / 10))
        side = float((layout.outer.high - layout.outer.low).max())
        for k in range(10):
            n, t = n_local // 10, k / 10
            move, turn = (a * (b / a) ** t for a, b in (N.MOVE, N.TURN))
            if best is not None:
                attempt(np.column_stack([best[0] + draw.normal(0, turn, n), best[1] + draw.normal(0, move * side, n), best[2] + draw.normal(0, move * side, n)]))
        return best

    layout, places, tests = N.Layout(N.Sheet(0, N.box(150.0, 110.0), zones=[(2, N.box(20.0, 20.0) + 30)]), 1.0), [], 0
    for k in range(7):
        model = N.Model.of(N.Part(k, star(k), turns=None, quality=None if k % 2 else 2), 1.0)
        draw, again = (np.random.Generator(np.random.Philox(k)) for _ in range(2))
        want, tests = brute(model, layout, draw, 700, 0.2), len(calls)
        places.append(N.search(model, layout, again, 700, 0.2))
        assert places[-1] == want and len(calls) == tests
        if want:
            N._put(layout, model, want)
    assert sum(p is not None for p in places) >= 4


def test_many_bodies_are_as_each_of_them():
    r = np.random.default_rng(2)
    bodies = [N.Body(star(k, 5 + k) + r.uniform(0, 120, 2), np.zeros((0, 3))) for k in range(6)]
    every, points = N.Bodies(bodies), r.uniform(-30, 150, (500, 2))
    assert (every.inside(points) == np.any([b.edges.inside(points) for b in bodies], axis=0)).all()
    met = 0
    for k in range(200):
        ring = star(k) * r.uniform(0.1, 3) + r.uniform(0, 120, 2)
        if not every.inside(ring).any():
            assert every.meet(ring, ring.min(0), ring.max(0)) == any(b.meets(ring) for b in bodies)
            met += every.meet(ring, ring.min(0), ring.max(0))
    assert met > 2
    nothing = N.Bodies([])
    assert not nothing.inside(points).any() and not nothing.meet(star(1), star(1).min(0), star(1).max(0))
