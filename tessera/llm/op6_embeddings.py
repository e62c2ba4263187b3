"""Embedding near-dedup by int8 quantised tile products with rigorous error bounds.

Vectors of one label are compared as directions. Equal vectors fall together first, each
class one row. A class has a cell: its angles to AXES fixed directions, each counted in steps
of the linking angle. Classes sorted by label, length and cell are cut into tiles of at most
TILE rows, and each tile keeps the least and greatest angle to every axis. As an angle to an
axis differs by no more than the vectors' own, two tiles whose ranges lie further apart than
the linking angle on some axis hold no link: that is decided on the tiles' ranges alone, and
only the remaining pairs of tiles are sent, each to one group of one task. A hot label is cut
into tiles like any other, and nothing but two tiles is in memory.

In a pair of tiles each unit vector u is s*q + e with q of int8 and |e| = d measured, so

    |cos(u, v) - s_u s_v <q_u, q_v>| <= d_u (1 + d_v) + d_v (1 + d_u) + d_u d_v

holds rigorously (|s q| <= 1 + d). Products of int8 rows are exact in single-precision BLAS
over at most 1,024 components (127^2 * 1024 < 2^24); longer ones are summed by such blocks.
Only pairs that the bound leaves possibly at or above the threshold are computed again in
double precision. The task returns counts of links for each class and a spanning forest,
never the pairs, so a group of near copies costs rows in proportion to its members.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components,
and rows whose label is null, link with nothing; vectors of one label and other lengths link
only with those of their own length; components of any finite size are scaled before they are
squared; repeated rows, and rows of one vec_id with other vectors, are vectors of their own;
rows with null vec_id link like others, but give a component no id: one of such rows alone
has component_id null, and a null vec_id is kept only there; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, forest, hot_join, materialize

THRESHOLD, TILE, ROWS, AXES, EXACT, SALTS = 0.98, 2048, 512, 16, 1024, 16
_axes: dict[int, np.ndarray] = {}


def axes(dim: int) -> np.ndarray:
    """AXES unit vectors of dim components, the same everywhere."""
    if dim not in _axes:
        a = np.random.default_rng(dim).normal(size=(AXES, dim))
        _axes[dim] = a / np.sqrt((a * a).sum(axis=1))[:, None]
    return _axes[dim]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows (none zero) as unit vectors; exact scaling by powers of two first, so that no square overflows or vanishes."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def angles(v: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(v) @ axes(v.shape[1]).T, -1, 1))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows -> int8 values as float32, scales, and norms of the rounding errors (rounded up)."""
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None])
    d = np.sqrt(((u - q * s[:, None]) ** 2).sum(axis=1)) + 1e-12
    return q.astype(np.float32), s, d


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows, exact at any length."""
    out = (a[:, :EXACT] @ b[:, :EXACT].T).astype(np.float64)
    for k in range(EXACT, a.shape[1], EXACT):
        out += a[:, k : k + EXACT] @ b[:, k : k + EXACT].T
    return out


def compare(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows (of double vectors, none zero) with cosine >= threshold; of one tile with itself, i < j."""
    ua, ub = unit(a), unit(b)
    qa, sa, da = quantise(ua)
    qb, sb, db = quantise(ub)
    for k in range(0, len(a), ROWS):
        cut = slice(k, k + ROWS)
        near = products(qa[cut], qb) * (sa[cut, None] * sb)
        slack = da[cut, None] * (1 + db) + db * (1 + da[cut, None]) + da[cut, None] * db
        i, j = np.nonzero(near + slack >= threshold - 1e-9)
        if same:
            i, j = i[i + k < j], j[i + k < j]
        for m in range(0, len(i), 1 << 16):
            x, y = i[m : m + (1 << 16)] + k, j[m : m + (1 << 16)]
            ok = np.einsum("ij,ij->i", ua[x], ub[y]) >= threshold
            yield x[ok], y[ok]


def _cells(batches: Iterator[pa.RecordBatch], width: float) -> Iterator[pa.RecordBatch]:
    """Adds each vector's cell; the vectors are the last column."""
    for b in batches:
        v, cells = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False), [b""] * b.num_rows
        size = np.array([len(x) for x in v])
        for dim in set(size.tolist()):
            at = np.flatnonzero(size == dim)
            cell = (angles(np.stack(v[at])) / width).astype(np.int64).clip(0, 65_535).astype(">u2")
            for i, c in zip(at.tolist(), cell, strict=True):
                cells[i] = c.tobytes()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.binary())], names=[*b.schema.names, "cell"])


def _tiles(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """Rows (label, dim, low, n, h1, h2, v) in order -> with class and tile numbers; the first row of a tile has the ranges of its angles."""
    from pyspark import TaskContext

    base, count, classes, held, size, last = TaskContext.get().partitionId() << 32, 0, 0, [], 0, None

    def flush():
        nonlocal held, size, count, classes
        t = pa.concat_tables([pa.Table.from_batches([b]) for b in held]).combine_chunks()
        held, size, n = [], 0, t.num_rows
        a = angles(np.stack(t["v"].to_numpy()))
        one = pa.list_(pa.float64())
        lo, hi = (pa.array([x.tolist(), *[None] * (n - 1)], one) for x in (a.min(axis=0), a.max(axis=0)))
        new = {"class": pa.array(base + classes + np.arange(n)), "tile": pa.array(np.full(n, base + count)), **{c: t[c] for c in t.column_names}, "lo": lo, "hi": hi}
        count, classes = count + 1, classes + n
        yield from pa.table(new).to_batches()

    for b in batches:
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        start = 0
        for i in range(len(keys)):
            if size + i - start and (keys[i] != last or size + i - start == tile):
                if i > start:
                    held.append(b.slice(start, i - start))
                yield from flush()
                start = i
            last = keys[i]
        if len(keys) > start:
            held.append(b.slice(start))
            size += len(keys) - start
    if held:
        yield from flush()


def _pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, own, class, n, v) sorted by (a, b) -> (class, links, to): weighted links, and a link that spans the group's."""
    held: list[pa.RecordBatch] = []
    last = None

    def work():
        table = pa.Table.from_batches(held)
        own = table["own"].to_numpy()
        ids, n = table["class"].to_numpy(), table["n"].to_numpy()
        v = np.stack(table["v"].to_numpy())
        first, second = np.flatnonzero(own == 0), np.flatnonzero(own == 1)
        same = not len(second)
        count, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for x, y in compare(v[first], v[first if same else second], same, threshold):
            x, y = first[x], (first if same else second)[y]
            np.add.at(count, x, n[y])
            np.add.at(count, y, n[x])
            root = forest(len(ids), x, y, root)
        hit = np.flatnonzero(count)
        if len(hit):
            yield pa.record_batch([pa.array(ids[hit]), pa.array(count[hit]), pa.array(ids[root[hit]])], names=["class", "links", "to"])

    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s < e:
                if held and (a[s], b[s]) != last:
                    yield from work()
                    held = []
                held.append(batch.slice(s, e - s))
                last = (a[s], b[s])
    if held:
        yield from work()


def tiles_of(classes: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """classes (label, low, n, h1, h2, v) -> a written table with class, tile, dim, and lo and hi once a tile."""
    rows = classes.select("label", F.size("v").alias("dim"), "low", "n", "h1", "h2", "v")
    kind = rows.schema["label"].dataType.simpleString()
    plain = f"label {kind}, dim int, low long, n long, h1 long, h2 long, v array<double>"
    width = max(math.acos(min(1.0, threshold)), 1e-3)
    celled = rows.mapInArrow(lambda it: _cells(it, width), f"{plain}, cell binary")
    order = ["label", "dim", "cell", "h1", "h2"]
    parts = max(1, math.ceil(classes.count() / (8 * tile)))
    dealt = celled.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("cell")
    return materialize(dealt.mapInArrow(lambda it: _tiles(it, tile), f"class long, tile long, {plain}, lo array<double>, hi array<double>"), "vector-tiles")


def tile_pairs(tiles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b), a <= b: tiles of one label and length that may hold a link between them."""
    ranges = tiles.where("lo is not null")
    limit = math.acos(min(1.0, threshold)) + 1e-6
    left = ranges.select("label", "dim", F.col("tile").alias("a"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.pmod(F.xxhash64("tile"), F.lit(SALTS)).alias("salt"))
    right = ranges.select("label", "dim", F.col("tile").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    gaps = F.zip_with(F.zip_with("lo1", "hi2", lambda x, y: x - y), F.zip_with("lo2", "hi1", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    return left.join(right, ["label", "dim", "salt"]).where("a <= b").where(~F.exists(gaps, lambda g: g > limit)).select("a", "b")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    finite = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    usable = F.coalesce(finite & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    # -0.0 equals 0.0: adding 0.0 makes equal vectors equal keys
    rows = rows.select("vec_id", "label", F.when(usable, F.transform("v", lambda x: x + F.lit(0.0))).alias("v"))
    clean = rows.where("v is not null").select("vec_id", "label", F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(6), "v", "label").alias("h2"), "v")
    tiles = tiles_of(materialize(clean.groupBy("h1", "h2", "label", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")), "vectors"), threshold, tile)
    pairs = materialize(tile_pairs(tiles, threshold), "vector-pairs")
    roles = pairs.select(F.col("a").alias("tile"), "a", "b", F.lit(0).alias("own")).unionByName(pairs.where("a < b").select(F.col("b").alias("tile"), "a", "b", F.lit(1).alias("own")))
    sent = roles.join(tiles.select("tile", "class", "n", "v"), "tile").select("a", "b", "own", "class", "n", "v")
    found = sent.repartition("a", "b").sortWithinPartitions("a", "b", "own", "class").mapInArrow(lambda it: _pairs(it, threshold), "class long, links long, to long")
    found = materialize(found, "vector-links")
    nodes = connected_components(found.select(F.col("class").alias("a"), F.col("to").alias("b")), "vector-cc").withColumnRenamed("node", "class")
    count = found.groupBy("class").agg(F.sum("links").alias("links"))
    of = tiles.select("h1", "h2", "class", "low", "n").join(count, "class", "left").join(nodes, "class", "left")
    of = materialize(of.select("h1", "h2", "low", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "class").alias("root")), "vector-classes")
    roots = of.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    of = hot_join(of, roots, ["root"], "members").select("h1", "h2", "n", "n_links", "component_id")
    out = hot_join(clean.drop("v", "label"), of, ["h1", "h2"], "n").select("vec_id", "n_links", "component_id")
    rest = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
