"""Kernels and operators of geometry and packing against brute force and invariants."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.config import Search
from tessera.functions import rect as R
from tessera.kernels import geometry as G
from tessera.kernels import search as K
from tessera.kernels.svgpath import rings
from tessera.operators import kernels as OK
from tessera.operators import layouts, packing
from tessera.operators import spatial as S
from tessera.operators.router import max_fit, nest
from tessera.sources import instances as I


def star(seed, n=12):
    r = np.random.default_rng(seed).random(n) * 30 + 8
    t = np.arange(n) * 2 * np.pi / n
    return np.column_stack([r * np.cos(t), r * np.sin(t)])


@given(st.integers(0, 10_000))
@settings(max_examples=25, deadline=None)
def test_pole_is_inside_and_near_the_best(seed):
    ring = star(seed)
    x, y, r = G.pole(ring)
    assert G.inside(np.array([[x, y]]), ring)[0] and abs(G.edge_distances(np.array([[x, y]]), ring)[0] - r) < 1e-9
    p = np.random.default_rng(seed).uniform(ring.min(0), ring.max(0), (400, 2))
    p = p[G.inside(p, ring)]
    assert len(p) == 0 or G.edge_distances(p, ring).max() <= r + 0.06


@given(st.integers(0, 10_000))
@settings(max_examples=25, deadline=None)
def test_hull_simplify_offset(seed):
    ring = star(seed)
    hull = G.hull(ring)
    assert G.area(hull) >= G.area(ring) > 0
    for q in ring:
        e = np.roll(hull, -1, axis=0) - hull
        assert (e[:, 0] * (q[1] - hull[:, 1]) - e[:, 1] * (q[0] - hull[:, 0]) >= -1e-9).all()
    simple = G.simplify(ring, 0.1)
    assert 3 <= len(simple) <= len(ring) and G.area(ring) - 1e-9 <= G.area(simple) <= 1.1 * G.area(ring) + 1e-9 and not G.crossings(simple)
    wide = G.offset(hull, 2.0)
    assert G.area(wide) > G.area(hull) and (G.edge_distances(hull, wide) <= 2.0 + 1e-6).all() and G.inside(hull, wide).all()
    assert G.area(G.offset(hull, -0.5)) < G.area(hull)


def test_circles_of_a_surrogate_lie_inside():
    ring = star(3)
    for x, y, r in G.surrogate(ring, 4):
        assert G.edge_distances(np.array([[x, y]]), ring)[0] >= r - 1e-9


@given(st.lists(st.tuples(st.integers(0, 18), st.integers(0, 10), st.integers(1, 8), st.integers(1, 6)), max_size=6))
@settings(max_examples=60, deadline=None)
def test_free_space(boxes):
    taken = np.array([(x, y, x + w, y + h) for x, y, w, h in boxes], float).reshape(-1, 4)
    grid = np.zeros((20, 12), bool)
    for a, b, c, d in taken.astype(int):
        grid[a : min(c, 20), b : min(d, 12)] = True
    best = max(((c - a) * (d - b) for a in range(20) for c in range(a + 1, 21) for b in range(12) for d in range(b + 1, 13) if not grid[a:c, b:d].any()), default=0)
    got = G.largest_empty((0, 0, 20, 12), taken)
    assert (0 if got is None else (got[2] - got[0]) * (got[3] - got[1])) == best
    free = G.free_rectangles((0, 0, 20, 12), taken, 2, 2)
    for x0, y0, x1, y1 in free:
        assert x1 - x0 >= 2 and y1 - y0 >= 2 and not grid[int(x0) : int(x1), int(y0) : int(y1)].any()
        grid[int(x0) : int(x1), int(y0) : int(y1)] = True
    polygons = G.free_polygons((0, 0, 20, 12), taken)
    left = 240 - sum(1 for i in range(20) for j in range(12) if any(a <= i < c and b <= j < d for a, b, c, d in taken))
    assert abs(sum(p["area"] for p in polygons) - left) < 1e-9
    assert all(G.area(p["outer"]) > 0 and all(G.area(h) < 0 for h in p["holes"]) for p in polygons)


def test_lattice_copies_are_apart():
    for seed in range(6):
        ring = star(seed)
        a, b, density = K.lattice(ring, 1.0, 12)
        at = K.fill_lattice(ring, (a, b), (300, 200))
        hull = G.hull(ring)
        assert 0.3 < density <= 1 and len(at) > 5
        assert ((ring[None] + at[:, None]).min((0, 1)) >= -1e-6).all() and ((ring[None] + at[:, None]).max((0, 1)) <= np.array([300, 200]) + 1e-6).all()
        assert not any(K.overlap_convex(hull + at[i], hull + at[j]) for i in range(len(at)) for j in range(i))
    assert abs(K.lattice(np.array([(0, 0), (10, 0), (10, 5), (0, 5)], float), 0.0, 12)[2] - 1) < 1e-9


def apart(rows, gap):
    return all(a[0] >= b[2] + gap - 1e-6 or b[0] >= a[2] + gap - 1e-6 or a[1] >= b[3] + gap - 1e-6 or b[1] >= a[3] + gap - 1e-6 for i, a in enumerate(rows) for b in rows[:i])


def test_left_bottom_fill():
    items = [(k, 5.0 + k * 3, 4.0 + k, 3) for k in range(5)]
    out = K.fill_bins(items, [(7, 40.0, 30.0, 1), (8, 60.0, 40.0, 9)], 1.0, 3, 200)
    assert len(out) == 15 and out == K.fill_bins(items, [(7, 40.0, 30.0, 1), (8, 60.0, 40.0, 9)], 1.0, 3, 200)
    for layout in {r[0] for r in out}:
        own = [r[3:] for r in out if r[0] == layout]
        w, h = (40, 30) if [r[1] for r in out if r[0] == layout][0] == 7 else (60, 40)
        assert apart(own, 1.0) and all(r[0] >= 0.5 - 1e-6 and r[1] >= 0.5 - 1e-6 and r[2] <= w - 0.5 + 1e-6 and r[3] <= h - 0.5 + 1e-6 for r in own)
    width, placed = K.fill_strip(items, 25.0, 1.0, 3, 200)
    assert len(placed) == 15 and apart([r[1:] for r in placed], 1.0) and max(r[3] for r in placed) <= width


def test_shelves():
    r = np.random.default_rng(0)
    sizes = [tuple(x) for x in r.integers(1, 20, (40, 2)).astype(float).tolist()]
    out = K.shelves(sizes, (50, 30), 1.0)
    assert sorted(k for k, *_ in out) == list(range(40))
    for page in {p for _, p, _, _ in out}:
        rows = [(x, y, x + sizes[k][0], y + sizes[k][1]) for k, p, x, y in out if p == page]
        assert apart(rows, 0.0) and all(a[2] <= 50 and a[3] <= 30 for a in rows)


def test_svg_paths():
    assert [len(r) for r in rings("M0 0H10V10H0Z m2 2h2v2h-2z")] == [4, 4]
    assert abs(G.area(rings("M 5 0 A 5 5 0 1 0 -5 0 A 5 5 0 1 0 5 0 Z")[0]) - 25 * math.pi) < 2
    assert abs(G.area(rings("M0,0 a5,5 0 1110,0a5 5 0 11-10 0z")[0]) - 25 * math.pi) < 2
    assert rings("M0 0 1 0 1 1Z")[0].tolist() == rings("m0 0 1 0 0 1z")[0].tolist() == [[0, 0], [1, 0], [1, 1]]
    assert len(rings("M0 0C0 10 10 10 10 0S20-10 20 0L20 20 0 20Z")[0]) == 2 * 16 + 3
    assert rings("") == rings("M0 0L1 1Z") == rings("hello") == []
    assert G.area(rings("M.5-.5L1e1,0 10 10.5.5 10z")[0]) > 0


@pytest.mark.parametrize("cell", [3.0, 25.0, 0.4])
def test_spatial_join_is_brute_force(spark, cell):
    r = np.random.default_rng(1)
    box = [(i, int(i % 2), float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(*r.integers(-20, 60, (2, 80)), *r.integers(1, 9, (2, 80)), strict=True))]
    box.append((80, 0, -30.0, -30.0, 90.0, 90.0))
    df = spark.createDataFrame(box, "id long, sheet long, x_min double, y_min double, x_max double, y_max double")
    got = [(x.a_id, x.b_id) for x in S.spatial_join(S.prefixed(df, "a_"), S.prefixed(df, "b_"), cell=cell).select("a_id", "b_id").collect()]
    want = [(a[0], b[0]) for a in box for b in box if a[1] == b[1] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]]
    assert sorted(got) == sorted(want)
    plan = S.spatial_join(S.prefixed(df, "a_"), S.prefixed(df, "b_"), cell=cell)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_relations(spark):
    rows = [(0, 0, 4, 4, 0, 0, 4, 4, "Surrounding"), (0, 0, 4, 4, 1, 1, 2, 2, "Surrounding"), (1, 1, 2, 2, 0, 0, 4, 4, "Enclosed"), (0, 0, 4, 4, 4, 4, 5, 5, "Intersecting"), (0, 0, 4, 4, 5, 0, 6, 4, "Disjoint")]
    df = spark.createDataFrame([tuple(map(float, r[:8])) + r[8:] for r in rows], "a_x_min double, a_y_min double, a_x_max double, a_y_max double, b_x_min double, b_y_min double, b_x_max double, b_y_max double, want string")
    assert df.where(R.relation(R.rect("a_"), R.rect("b_")) != F.col("want")).count() == 0


def test_grid_of_frames(spark):
    df = spark.createDataFrame([(200.0, 295.0, 980.0, 2000.0, 2.0, True)], "w double, h double, sheet_w double, sheet_h double, spacing double, turn boolean")
    assert packing.grid(df).select(packing.capacity(F.col("regions")).alias("n")).first().n == 27
    cells = packing.stencil(df, ["w", "h"]).collect()
    rows = [(c.x - a / 2, c.y - b / 2, c.x + a / 2, c.y + b / 2) for c in cells for a, b in [(c.h, c.w) if c.turned else (c.w, c.h)]]
    assert len(rows) == 27 and apart(rows, 2.0) and all(r[0] >= 0 and r[1] >= 0 and r[2] <= 980 and r[3] <= 2000 for r in rows)


def test_router(spark):
    parts = [(1, 1, 20.0, 10.0, 50, 1.0), (2, 1, 10.0, 5.0, 7, 1.0), (2, 2, 8.0, 4.0, 90, 1.0), (3, 1, 12.0, 9.0, 5, 0.5), (4, 1, 58.0, 39.5, 2, 1.0)]
    df = spark.createDataFrame([(q, i, w, h, n, w * h * a, 3 if a < 1 else 4, 0, None) for q, i, w, h, n, a in parts], "request long, id long, w double, h double, demand long, area double, vertices int, holes int, angles array<double>")
    got = nest(df, (60.0, 40.0), 1.0).groupBy("request", "id").agg(F.sum("copies").alias("n")).collect()
    assert {(r.request, r.id): r.n for r in got} == {(q, i): n for q, i, _, _, n, _ in parts}
    fit = {(r.request, r.id): r.copies for r in max_fit(df, (60.0, 40.0), 1.0).collect()}
    full = nest(df.where("request = 1"), (60.0, 40.0), 1.0).where("page like 'full%'").count()
    assert fit[1, 1] == full


def test_same_seed_same_answer(spark):
    df = spark.range(200).select(F.floor(F.col("id") / 5).alias("request"), F.col("id"), (F.col("id") % 9 + 3.0).alias("w"), (F.col("id") % 7 + 2.0).alias("h"), F.lit(2).alias("demand"))
    one, many = (sorted(map(str, OK.fill_bins(df.repartition(n), [(1, 30.0, 20.0, 99)], 1.0, samples=60).collect())) for n in (1, 16))
    assert one == many and len(one) == 400


def test_instances(spark, tmp_path):
    square = {"type": "simple_polygon", "data": [[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]]}
    bow = {"type": "simple_polygon", "data": [[0, 0], [4, 4], [4, 0], [0, 3]]}
    raw = {"name": "n", "strip_height": 8, "items": [{"id": 0, "demand": 3, "allowed_orientations": [0, 180], "shape": square, "dxf": "x"}, {"id": 1, "demand": 1, "shape": {"type": "rectangle", "data": {"x_min": 1, "y_min": 1, "width": 2, "height": 5}}}, {"id": 2, "demand": 0, "shape": square}, {"id": 3, "demand": 1, "allowed_orientations": [], "shape": bow}]}
    (tmp_path / "strip.json").write_text(json.dumps(raw))
    got = {r.id: r for r in I.items(I.read_strips(spark, str(tmp_path / "strip.json"))).collect()}
    assert set(got) == {0, 1, 3} and got[0].area == 16 and got[1].area == 10 and len(got[0].ring) == 4
    assert got[0].problem is None and got[3].problem == "crosses itself" and got[1].rotations is None and got[3].rotations == [0.0]
    assert I.strips(I.read_strips(spark, str(tmp_path / "strip.json"))).first().height == 8
    hole = {"type": "polygon", "data": {"outer": [[0, 0], [10, 0], [10, 10], [0, 10]], "inner": [[[1, 1], [2, 1], [2, 2], [1, 2]]]}}
    bins = raw | {"bins": [{"id": 0, "shape": hole, "zones": [{"quality": 2, "shape": square}], "stock": 2, "cost": 5}, {"id": 1, "shape": hole, "stock": 0, "cost": 1}]}
    (tmp_path / "bins.json").write_text(json.dumps(bins))
    b = I.read_bins(spark, str(tmp_path / "bins.json"))
    assert [r.area for r in I.containers(b).collect()] == [99.0] and sorted(r.quality for r in I.zones(b).collect()) == [0, 2]
    placed = spark.createDataFrame([(1, 0, 3, math.pi / 2, 1.0, 2.0), (1, 0, 4, 0.0, 5.0, 6.0)], "layout long, container_id long, item_id long, rot double, tx double, ty double")
    text = I.layouts_json(placed, spark.createDataFrame([(1, 0.5)], "layout long, density double"))
    assert json.loads(text.first().value)["placed_items"][0]["transformation"]["rotation"] == pytest.approx(90)
    assert layouts.same(I.read_layouts(text).select(*placed.columns).withColumn("rot", F.round("rot", 9)), placed.withColumn("rot", F.round("rot", 9)))
    urls = spark.createDataFrame([("s3://b/k/x.svg",), ("https://b.s3.eu-west-1.amazonaws.com/k/x.svg",), ("http://localhost:9000/b/k/x.svg",)], "u string")
    assert {tuple(r) for r in urls.select(*I.object_place(F.col("u"))).collect()} == {("b", "k/x.svg")}


def test_settings():
    s = Search.parse('{"n_samples": 7, "cde_config": {"quadtree_depth": 3}, "other": 1}')
    assert (s.samples, s.depth, s.local, s.surrogate.ff_poles) == (7, 3, 0.2, 2)


def test_layout_changes(spark):
    a = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)], "sheet long, id long, item long")
    b = layouts.place(layouts.remove(a, spark.createDataFrame([(1, 2)], "sheet long, id long")), spark.createDataFrame([(3, 1, 9)], "sheet long, id long, item long"))
    gone, added = layouts.changes(a, b)
    assert layouts.same(layouts.place(layouts.remove(b, added.select("sheet", "id")), gone), a)


def test_poles_go_on_to_their_limits(spark):
    rings = {1: [(0, 0), (30, 0), (30, 4), (4, 4), (4, 30), (0, 30)], 2: [(0, 0), (10, 0), (10, 10), (0, 10)]}
    rows = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r]) for i, r in rings.items()], "id long, ring array<struct<x:double,y:double>>")
    got = OK.poles(rows).toPandas()
    for i, r in rings.items():
        radii = got[got["id"] == i].sort_values("k")["r"].to_numpy()
        share = np.pi * np.cumsum(radii**2) / G.area(np.array(r, float))
        due = [min(n for n, least in ((100, 0.0), (20, 0.75), (10, 0.9)) if s > least) for s in share]
        assert len(radii) >= due[-1] and all(k + 1 < d for k, d in enumerate(due[:-1]))
    kinds = OK.surrogates(rows).toPandas()
    assert (kinds[kinds["kind"] == 0].groupby("id").size() == got.groupby("id").size()).all()


def test_fill_queries_take_the_full_samples(monkeypatch):
    from tessera.plans import searches

    taken = []
    monkeypatch.setattr(searches, "_requests", lambda s, d: None)
    for name in ("fill_bins", "fill_strips"):
        monkeypatch.setattr(searches.K, name, lambda *a, samples=200, **k: taken.append(samples))
    searches.lbf_bin(None, None)
    searches.lbf_strip(None, None)
    assert taken == [5000, 5000]


def test_touching_circles_and_edges_collide(spark):
    from tessera.functions import circle as C
    from tessera.functions import edge as E

    rows = spark.createDataFrame([(501.0, 293.0, 12.0, 497.0, 311.0, 521.0, 293.0), (376.0, 168.0, 8.0, 368.0, 184.0, 388.0, 169.0), (376.0, 168.0, 7.9, 368.0, 184.0, 388.0, 169.0)], "cx double, cy double, r double, x1 double, y1 double, x2 double, y2 double")
    assert [r[0] for r in rows.select(C.hits_edge(C.circle(), E.edge())).collect()] == [True, True, False]


def test_exact_places_are_no_worse_than_samples():
    for seed in range(40):
        r = np.random.default_rng(seed)
        items = [(i, *r.integers(1, 40, 2).astype(float).tolist(), 1) for i in range(6)]
        got = K.fill_bins(items, [(0, 60.0, 45.0, 99)], 1.0, seed, exact=True)
        assert len(got) == 6
        for k, a in enumerate(got):
            assert min(a[3:5]) >= 0.5 and a[5] <= 59.5 and a[6] <= 44.5
            assert not any(a[0] == b[0] and a[3] < b[5] + 1 - 1e-6 and b[3] < a[5] + 1 - 1e-6 and a[4] < b[6] + 1 - 1e-6 and b[4] < a[6] + 1 - 1e-6 for b in got[:k])
        placed = sorted((b[3:] for b in got if b[0] == 0), key=lambda b: b[1])
        best, drawn = K.corner(9.0, 5.0, placed, (60.0, 45.0), 1.0), K.left_bottom(9.0, 5.0, np.array(placed), (60.0, 45.0), 1.0, seed, 5000)
        assert (best is None) <= (drawn is None)
        assert drawn is None or 10 * best[0] + best[1] <= 10 * drawn[0] + drawn[1] + 1e-6


def test_places_cost_little():
    import time

    items = [(i, 10.0 + 7 * i, 3.0 + 2 * i, 1) for i in range(5)]
    began = time.process_time()
    for seed in range(2000):
        K.fill_bins(items, [(0, 60.0, 40.0, 99)], 1.0, seed, exact=True)
        K.fill_strip(items, 60.0, 1.0, seed, exact=True)
    assert time.process_time() - began < 3


def test_long_strips_lean_on_many_parts():
    width, got = K.fill_strip([(1, 4.0, 3.0, 200)], 20.0, 1.0, 0, exact=True)
    assert len(got) == 200 and width < 200.1
    assert not any(a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4] for k, a in enumerate(got) for b in got[:k])


def test_groups_span_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = spark.createDataFrame([(g, k) for g in range(9) for k in range(g * 2 + 1)], "g long, k long").repartition(5)
        got = OK.per_group(rows, "g", "g long, n long, ks array<bigint>", lambda g, f: [(g, len(f["k"]), f["k"])] if g != 4 else [], ["k"]).collect()
        assert sorted((r.g, r.n, r.ks) for r in got) == [(g, g * 2 + 1, list(range(g * 2 + 1))) for g in range(9) if g != 4]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_offcuts_cost_little():
    import time

    taken = [(40.0 * k, float(7 * k % 30), 40.0 * k + 11 + 5 * k, float(7 * k % 30 + 4 + k)) for k in range(7)]
    began = time.process_time()
    for _ in range(1000):
        G.free_rectangles((0.0, 0.0, 320.0, 50.0), taken, 12, 12)
        G.free_polygons((0.0, 0.0, 320.0, 50.0), taken)
    assert time.process_time() - began < 1.5


def test_the_largest_free_rectangle_may_be_thin(spark):
    placed = spark.createDataFrame([(1, 0.0, 10.0, 290.0, 50.0)], "sheet long, x_min double, y_min double, x_max double, y_max double")
    r = OK.offcut_facts(placed, (320.0, 50.0), 12.0, 12.0).first()
    assert (r.largest, r.n, r.area, r.n_merged, r.area_merged, r.corners) == (3200.0, 1, 1200.0, 1, 1200.0, 4)


def test_poles_cost_little():
    import time

    began = time.process_time()
    for seed in range(15):
        G.poles(star(seed), ((100, 0.0), (20, 0.75), (10, 0.9)))
    assert time.process_time() - began < 0.7


def test_filters_do_not_copy_the_regions(spark):
    from tessera.operators import packing

    rows = spark.range(4).selectExpr("id", "id + 5.0d as w", "3.0d as h", "60.0d as sheet_w", "40.0d as sheet_h", "1.0d as spacing", "true as turn")
    got = packing.grid(rows).withColumn("capacity", packing.capacity(F.col("regions"))).withColumn("rest", F.lit(900) % F.col("capacity"))
    plan = got.where("rest > 0 and capacity > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("turned, NOT") == 1
    assert got.columns == [*rows.columns, "regions", "capacity", "rest"]


def test_parts_that_touch_at_corners_cost_little():
    import time

    got = G.free_polygons((0.0, 0.0, 9.0, 9.0), [(0.0, 0.0, 3.0, 3.0), (3.0, 3.0, 6.0, 6.0), (6.0, 6.0, 9.0, 9.0)])
    assert [p["area"] for p in got] == [27.0, 27.0] and [len(p["outer"]) for p in got] == [6, 6]
    ring = [(1.0, 1.0, 3.0, 3.0), (3.0, 3.0, 5.0, 5.0), (5.0, 1.0, 7.0, 3.0), (3.0, 0.0, 5.0, 1.0)]
    got = G.free_polygons((0.0, 0.0, 8.0, 6.0), ring)
    assert sum(p["area"] for p in got) == 48.0 - 14.0 and all(p["area"] > 0 for p in got)
    boxes = [(40.0 * k, 3.0 * k, 40.0 * k + 11 + k, 3.0 * k + 9) for k in range(7)]
    began = time.process_time()
    for _ in range(400):
        G.free_polygons((0.0, 0.0, 320.0, 50.0), boxes)
    assert (time.process_time() - began) / 400 < 3.5e-4


def test_free_rectangles_of_many_sheets_at_once():
    """As sheet by sheet, with overlaps, holes, thirds and sheets that are full."""
    from tessera.kernels import free as V

    holes = 0
    for seed in range(60):
        r = np.random.default_rng(seed)
        sheets = []
        for _ in range(12):
            low = r.integers(-2, 10, (r.integers(0, 9), 2))
            sheets.append((np.hstack([low, low + r.integers(0, 5, low.shape)]) / (1 if seed % 2 else 3)).tolist())
        sheets.append([[0.0, 0.0, 9.0, 7.0]])
        own = np.repeat(np.arange(13), [len(b) for b in sheets])
        taken = np.array([b for s in sheets for b in s]).T
        for least in (0.0, 2.0):
            want = [list(G.emptiest((0.0, 0.0, 9.0, 7.0), b, least)) for b in sheets]
            got, free = V.emptiest((0.0, 0.0, 9.0, 7.0), 13, own, taken, least)
            assert list(zip(got.tolist(), map(tuple, free.T.tolist()), strict=True)) == [(k, b) for k, bs in enumerate(want) for b in bs]
            parts = [G.joined(bs) for bs in want]
            number, area, corners = V.joined(13, got, free)
            assert number.tolist() == [len(p) for p in parts] and np.allclose(area, [sum(q["area"] for q in p) for p in parts])
            assert corners.tolist() == [min((len(q["outer"]) for q in p), default=0) for p in parts]
            holes += sum(bool(q["holes"]) for p in parts for q in p)
    assert holes > 5


def test_groups_of_a_stream_stay_whole(spark):
    rows = spark.range(5000).selectExpr("id % 700 as sheet", "CAST(id % 13 AS DOUBLE) as v")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = OK.per_groups(rows, "sheet", "sheet long, n long, v double", lambda keys, number, c: [keys, np.bincount(number), np.bincount(number, c[0])]).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = rows.groupBy("sheet").agg(F.count("*").alias("n"), F.sum("v").alias("v")).toPandas()
    assert got.sort_values("sheet").to_numpy().tolist() == want.sort_values("sheet").to_numpy().tolist()


def test_strips_of_many_requests_at_once():
    """As request by request: with ties, copies, parts that are too tall, requests of more parts than are filled at once and of none."""
    from tessera.kernels import strips

    for seed in range(60):
        r = np.random.default_rng(seed)
        n, gap, height, by = 20, (1.0, 0.0, 0.37)[seed % 3], (60.0, 17.0)[seed // 3 % 2], (1, 3, 7.3)[seed % 3]
        request = np.sort(r.integers(0, n, r.integers(1, 120)))
        item, demand = r.integers(0, 10**18 if seed % 2 else 4, len(request)), r.integers(0, 9 if seed % 5 == 0 else 3, len(request))
        w, h = r.integers(1, 50, len(request)) / by, r.integers(1, 70 if seed % 2 else 18, len(request)) / by
        width, own, ids, boxes = strips.fill_strips(n, request, item, w, h, demand, height, gap)
        for q in range(n):
            items = sorted(zip(*(v[request == q].tolist() for v in (item, w, h, demand)), strict=True))
            want = K.fill_strip(items, height, gap, 0, exact=True)
            got = [(i, *b) for i, b in zip(ids[own == q].tolist(), boxes[:, own == q].T.tolist(), strict=True)]
            assert (width[q], got) == want


def test_strips_cost_little():
    import time

    from tessera.kernels import strips

    r = np.random.default_rng(0)
    request = np.repeat(np.arange(2500), r.integers(1, 8, 2500))
    w, h = r.integers(1, 51, len(request)).astype(float), r.integers(1, 18, len(request)).astype(float)
    began = time.process_time()
    for _ in range(20):
        strips.fill_strips(2500, request, r.integers(0, 10**6, len(request)), w, h, np.ones(len(request), int), 60.0, 1.0)
    assert time.process_time() - began < 1


def test_strips_know_what_was_asked_for(spark):
    """One pass over the parts, whose facts are those that Spark finds."""
    parts = spark.range(600).selectExpr("id * 7 % 150 as request", "id", "CAST(1 + id * 31 % 50 AS DOUBLE) as w", "CAST(1 + id % 17 AS DOUBLE) as h", "CAST(id % 4 AS INT) as demand")
    got = OK.fill_strips(parts, 60.0, 1.0)
    want = parts.groupBy("request").agg(F.sum("demand").alias("placed"), F.sum("demand").alias("asked"), F.max("w").alias("widest"), F.sum(F.col("w") * F.col("demand")).alias("row"))
    assert sorted(map(tuple, got.select("request", "placed", "asked", "widest", "row").collect())) == sorted(map(tuple, want.collect()))
    ones = OK.fill_strips(parts.drop("demand"), 60.0, 1.0, demand=1).where("placed = 4 and asked = 4")
    assert ones.count() == 150 and str(ones._jdf.queryExecution().executedPlan()).count("Exchange") == 1


def test_offcuts_of_full_sheets_have_a_row_as_in_sql(spark, tmp_path):
    """Sheet 1 leaves nothing of 12 by 12, sheet 2 does."""
    import duckdb
    import pandas as pd

    from tessera.plans import searches

    pd.DataFrame({"p_partkey": range(60), "p_size": 50, "p_brand": ""}).to_parquet(tmp_path / "part.parquet")
    lines = [(1, k, n) for k in range(60) for n in range(1, 9)] + [(2, 3, 1), (2, 4, 7)]
    pd.DataFrame(lines, columns=["l_orderkey", "l_partkey", "l_linenumber"]).assign(l_suppkey=0).to_parquet(tmp_path / "lineitem.parquet")
    c = duckdb.connect()
    for t in ("part", "lineitem"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = sorted(c.sql(searches.OFFCUTS).fetchall())
    assert sorted(map(tuple, searches.rect_offcuts(spark, str(tmp_path)).collect())) == want == [(1, 0, 0, True), (2, 0, 0, True)]
