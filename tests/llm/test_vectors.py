"""Operators on vectors against brute force."""

import math

import numpy as np
import pytest

from tessera.llm import op6_embeddings, op9_topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, id string"


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    out = []
    for i in range(150):
        v = r.normal(size=8)
        out.append((i, v.astype(np.float32).tolist(), int(i % 3)))
    for i in range(150, 260):
        near = np.array(out[i % 12][1]) + r.normal(size=8) * 0.06
        out.append((i, near.astype(np.float32).tolist(), out[i % 12][2]))
    out += [(300 + k, out[5][1], out[5][2]) for k in range(30)]
    out += [(400, None, 1), (401, [], 1), (402, [0.0] * 8, 1), (403, [math.nan] + [1.0] * 7, 1), (404, [math.inf] + [1.0] * 7, 1), (405, [None] + [1.0] * 7, 1), (406, out[5][1], None), (None, out[5][1], out[5][2]), (407, [1.0, 2.0], 2), (408, [2.0, 4.0], 2)]
    out += [out[5], out[5]]
    return [x + ("c", "c") for x in out]


def ok(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("tile", [2048, 16])
def test_near_vectors(spark, rows, tile):
    got = op6_embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), tile=tile).collect()
    assert len(got) == len(rows)
    links_and_components(rows, got)
    assert op6_embeddings.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def links_and_components(rows, got):
    live = [(i, np.array(v, float), k) for i, v, k, *_ in rows if k is not None and ok(v) and any(v)]
    links, root = {}, list(range(len(live)))
    unit = [v / 2.0 ** np.frexp(np.abs(v).max())[1] for _, v, _ in live]
    unit = [v / np.sqrt(v @ v) for v in unit]
    for a in range(len(live)):
        for b in range(len(live)):
            if a != b and live[a][2] == live[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                links[a] = links.get(a, 0) + 1
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root] if x != y else root
    low = {r: min((live[k][0] for k in range(len(live)) if root[k] == r and live[k][0] is not None), default=None) for r in root}
    want = [(live[k][0], links.get(k, 0), low[root[k]]) for k in range(len(live))]
    want += [(i, 0, i) for i, v, k, *_ in rows if not (k is not None and ok(v) and any(v))]
    assert sorted(map(str, want)) == sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got)
    assert all(r.kept == (r.component_id is None if r.vec_id is None else r.vec_id == r.component_id) for r in got)
    return links


def test_near_vectors_of_equal_ids_and_any_size(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [1.0, 0.002], 0), (4, [1e200, 1e200], 0), (5, [1e200, 1.0001e200], 0), (6, [1e-200, 1e-200], 0), (7, [5e-324, 0.0], 1), (8, [1.0, 0.0], 1), (None, [3.0, 0.0], 1), (None, [0.0, 3.0], 1), (None, [0.0, 3.0], 1)]
    got = op6_embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    links_and_components(rows, got)
    assert sorted((r.vec_id or 0, r.n_links) for r in got if r.vec_id in (1, 4, 7)) == [(1, 0), (1, 2), (4, 2), (7, 2)]


def test_tiles_apart_are_skipped(spark):
    r = np.random.default_rng(8)
    centre = r.normal(size=(20, 32))
    x = np.repeat(centre, 30, axis=0) + r.normal(size=(600, 32)) * 0.05
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    classes = rows.selectExpr("label", "vec_id as low", "1L as n", "xxhash64(vec_id) as h1", "0L as h2", "embedding as v")
    tiles = op6_embeddings.tiles_of(classes, tile=16).cache()
    n = tiles.select("tile").distinct().count()
    pairs = op6_embeddings.tile_pairs(tiles).collect()
    assert n >= 38 and len(pairs) < 0.5 * n * (n + 1) / 2
    at = {r.low: r.tile for r in tiles.collect()}
    u = x / np.sqrt((x * x).sum(1))[:, None]
    kept = {(p.a, p.b) for p in pairs}
    links = np.argwhere(u @ u.T >= 0.98)
    assert len(links) > 5000 and all((min(at[a], at[b]), max(at[a], at[b])) in kept for a, b in links)


@pytest.mark.parametrize("dim", [768, 1536, 4096])
def test_products_are_exact(dim):
    r = np.random.default_rng(dim)
    q = r.integers(100, 128, (40, dim)).astype(np.float32)
    assert (op6_embeddings.products(q, q) == q.astype(np.int64) @ q.astype(np.int64).T).all()


def test_error_bounds_are_rigorous():
    r = np.random.default_rng(0)
    u = r.normal(size=(200, 64))
    u /= np.sqrt((u * u).sum(1))[:, None]
    q, s, d = op6_embeddings.quantise(u)
    gap = np.abs(u @ u.T - (q @ q.T) * np.outer(s, s))
    assert (gap <= d[:, None] * (1 + d) + d * (1 + d[:, None]) + np.outer(d, d)).all() and np.abs(q).max() <= 127


@pytest.mark.parametrize(("shard", "block"), [(16_384, 2_048), (40, 5)])
def test_top_k(spark, rows, shard, block):
    got = op9_topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), shard=shard, block=block).collect()
    live = [(i, np.floor(64 * np.array(v + [0.0] * (8 - len(v)), float))) for i, v, *_ in rows if i is not None and ok(v)]
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asks = {i: q for i, q in live if i % 20 == 0}
    assert set(by) == set(asks)
    for i, q in asks.items():
        want = sorted((-int(x @ q), j) for j, x in live if j != i)[:20]
        assert by[i] == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]
    assert op9_topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def ranking(rows, dim=8):
    live = [(i, [math.floor(64 * x) for x in v] + [0] * (dim - len(v))) for i, v, *_ in rows if i is not None and ok(v) and all(math.isfinite(64 * float(x)) for x in v)]
    asks = {}
    for i, q in live:
        if i % 20 == 0:
            asks[i] = min(q, asks.get(i, q))
    clamp = lambda s: max(op9_topk.LONG[0], min(op9_topk.LONG[1], s))
    return {i: [(k + 1, j, -s) for k, (s, j) in enumerate(sorted((-clamp(sum(map(int.__mul__, x, q))), j) for j, x in live if j != i)[:20])] for i, q in asks.items()}


def found(out):
    by = {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return by


def test_top_k_of_repeated_ids_and_large_components(spark):
    r = np.random.default_rng(11)
    rows = [(i % 70, (r.normal(size=6) * 10.0 ** (i % 9)).tolist()) for i in range(120)]
    rows += [(20, rows[20][1]), (200, [0.0] * 6), (201, [1e15, -1e15]), (220, [1e160, 0.0, 1.0]), (202, [1.7e308])]
    for own in (rows[:110], rows):
        got = op9_topk.top_k(spark.createDataFrame(own, "vec_id long, embedding array<double>"), shard=30, block=3)
        assert found(got) == ranking(own, 6)


def test_bounds_stop_searches_before_rows_are_sent(spark):
    """Clustered vectors: few shards are asked, and in them few products made."""
    r = np.random.default_rng(2)
    centre = r.normal(size=(40, 16)) * 8
    x = np.repeat(centre, 100, axis=0) + r.normal(size=(4000, 16)) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(op9_topk.top_k(df, shard=200, block=50)) == ranking(rows, 16)
    v = df.selectExpr("vec_id as id", "transform(embedding, e -> cast(floor(e * 64) as double)) as v")
    space = op9_topk.fit(v, 16)
    index = op9_topk.build(op9_topk.entries(v, 20), space, 16, 200)
    shards = index.select("shard").distinct().count()
    q = np.floor(x[::20] * 64)
    floors = {20 * k: sorted((int(s) for j, s in enumerate(np.floor(x * 64) @ q[k]) if j != 20 * k), reverse=True)[19] for k in range(200)}
    t = index.orderBy("pivot", "dist", "ids").toPandas()
    home = {i: int(s) for s, ids in zip(t["shard"], t["ids"], strict=True) for i in ids}
    asked = spark.createDataFrame([(i, q[i // 20].tolist(), home[i], f) for i, f in floors.items()], "id long, v array<double>, home int, floor long")
    assert op9_topk.reach(asked, index, space, 16).count() < 0.3 * 200 * (shards - 1)
    made = op9_topk.best(space, np.arange(4000), np.concatenate(t["ids"].to_list()), np.stack(t["v"]), t["pivot"].to_numpy(), t["dist"].to_numpy(), np.arange(0, 4000, 20), q, np.array(list(floors.values())), 20)[3]
    assert made < 0.3 * 200 * 4000


def test_one_common_vector_is_one_entry(spark):
    rows = [(i, [1.0, 2.0, 0.5] if i % 3 else [i / 64.0, 1.0, -1.0]) for i in range(600)] + [(20, [1.0, 2.0, 0.5])] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(op9_topk.top_k(df, shard=10, block=4)) == ranking(rows, 3)
    lists = {len(r.ids) for r in op9_topk.entries(df.selectExpr("vec_id as id", "embedding as v"), 20).collect()}
    assert max(lists) == 40 and min(lists) == 1
