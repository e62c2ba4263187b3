"""Exact top-k search by a pivot-distance index.

Score is the integer inner product of floor(64 x). Vectors are centred on c (a fixed integer
vector: for one query that takes the same <q, c> off every score) and turned into points by
one more component: with M at least every |x - c|, x' = (x - c, sqrt(M^2 - |x - c|^2)) and
q' = (l q, 0), l = M / |q|, give |q' - x'|^2 = 2 M^2 - 2 l <q, x - c>, so the largest products
are the nearest points. The index keys each vector by its nearest pivot and its distance to
it, and is range-partitioned in that order into shards of sorted annuli. c and the PIVOTS
pivots are fitted on a bounded sample of SAMPLE rows; every row is indexed. Equal vectors are
one entry with their k + 1 least ids: ties go to the smallest ids, so no query needs more.

A query first searches the shard of its highest bound; its k-th score there is a floor.
By the triangle inequality a point in an annulus [lo, hi] of pivot p is no nearer to q' than
max(d(q', p) - hi, lo - d(q', p)), which bounds its score. A query goes on only to shards one
of whose annuli may reach its floor: that is decided on the annuli's ranges (one row for each
shard and pivot; SHARD grows so that MOST shards suffice, which bounds what each task gets of
them), before any vector is sent. Inside a shard it expands annuli by falling bound and stops
when the bound is below its k-th score so far. Shards without a query left are not sent, the
others once for each BLOCK queries. Every bound is rigorous: recall is 1. Where vectors have
no clusters, as random ones in 64 dimensions, no bound can stop anything: then all shards are
searched, in blocks.

Products are exact: in double precision as long as they are below 2^51, else pairs that the
rounded product leaves possibly among the best are computed again in Python's integers.

Defined cases: vectors that are null, empty, or hold components that are null or not finite
(64 times the component included) take no part, nor do rows with null vec_id; lengths that
differ are filled with zeros; ties go to the smaller vec_id; repeated rows are candidates of
their own, but rows of one vec_id ask once (that of the least vector) and equal ids are the
query's own row and no candidates of it; scores beyond a long stay at its ends; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

K, PIVOTS, SAMPLE, SHARD, BLOCK, ANNULUS, ROWS, MOST = 20, 64, 2_048, 16_384, 2_048, 256, 256, 1 << 18
LONG = (-(1 << 63), (1 << 63) - 1)


def dense(column, dim: int) -> np.ndarray:
    rows = column.to_numpy(zero_copy_only=False)
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Space(NamedTuple):
    """What turns vectors into points. unit: a power of two that no component exceeds by much, so that nothing overflows."""

    centre: np.ndarray
    pivots: np.ndarray  # with the added component
    top: float  # M, in units
    unit: float
    exact: bool  # double precision holds all products

    def points(self, v: np.ndarray) -> np.ndarray:
        x = v / self.unit - self.centre / self.unit
        return np.column_stack([x, np.sqrt(np.maximum(self.top**2 - (x * x).sum(axis=1), 0))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        p = self.pivots
        return np.sqrt(np.maximum((points * points).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * points @ p.T, 0))

    def asked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of queries: distances to the pivots, l, |q'|^2 and <q, c>, in units."""
        q = q / self.unit
        norm = np.sqrt((q * q).sum(axis=1))
        l = np.where(norm > 0, self.top / np.where(norm > 0, norm, 1), 1.0)
        l = np.where(l > 0, l, 1.0)
        p = np.column_stack([q * l[:, None], np.zeros(len(q))])
        return self.distances(p), l, (l * norm) ** 2, q @ (self.centre / self.unit)

    def bounds(self, asked: tuple, pivot: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """[queries, annuli]: no score of an annulus is above, in units^2."""
        d, l, norm, shift = asked
        far = d[:, pivot]
        slack = 1e-6 * (far + self.top)
        near = np.maximum(np.maximum(far - hi, lo - far) - slack, 0)
        return ((norm[:, None] + self.top**2 - near * near) / (2 * l[:, None]) + shift[:, None]) + 1e-9 * (norm[:, None] + self.top**2) / l[:, None] + 1e-9 * np.abs(shift)[:, None]


def scores(space: Space, q: np.ndarray, x: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Exact scores [queries, rows] as longs; those sure to be below least may be LONG[0]."""
    if space.exact:
        return (q @ x.T).astype(np.int64)
    out = np.full((len(q), len(x)), LONG[0], np.int64)
    qs, xs = q / space.unit, x / space.unit
    p = qs @ xs.T
    err = (q.shape[1] + 4) * 2.0**-52 * np.sqrt((qs * qs).sum(axis=1))[:, None] * np.sqrt((xs * xs).sum(axis=1)) + 2.0**-900
    with np.errstate(over="ignore"):
        floor = least.astype(np.float64) / space.unit / space.unit
    rows, cols = np.nonzero(p + err >= floor[:, None] - np.abs(floor)[:, None] * 2.0**-50)
    whole = {}
    for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
        a, b = (whole.setdefault((s, k), [int(c) for c in m[k]]) for s, m, k in (("q", q, i), ("x", x, j)))
        out[i, j] = max(LONG[0], min(LONG[1], sum(map(int.__mul__, a, b))))
    return out


def best(space: Space, entry: np.ndarray, ids: np.ndarray, x: np.ndarray, pivot: np.ndarray, dist: np.ndarray, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query row, id and score of the k best of one shard's vectors x, sorted by (pivot, dist).

    ids, and entry, the rows of x that have them, ascend by row; floor: a score that k rows are known to reach. Last: products made.
    """
    new = np.flatnonzero(np.concatenate(([True], pivot[1:] != pivot[:-1])))
    cuts = np.array(sorted({*new.tolist(), *(c for s, e in zip(new, [*new[1:], len(x)], strict=True) for c in range(s, e, ANNULUS)), len(x)}))
    start, stop = cuts[:-1], cuts[1:]
    first, last = np.searchsorted(entry, start), np.searchsorted(entry, stop)
    bound = space.bounds(space.asked(q), pivot[start], dist[start], dist[stop - 1])
    order = np.argsort(-bound, axis=1, kind="stable")
    score, ident = np.full((len(q), k), LONG[0], np.int64), np.full((len(q), k), LONG[1], np.int64)
    known, kth, made = np.zeros((len(q), k), bool), floor.astype(np.int64), 0
    for c in range(len(start)):
        span, least = order[:, c], kth / space.unit / space.unit
        live = np.flatnonzero(bound[np.arange(len(q)), span] >= least - 1e-9 * np.abs(least))
        if not len(live):
            break
        for s in np.unique(span[live]):
            mine = live[span[live] == s]
            own, at = ids[first[s] : last[s]], entry[first[s] : last[s]] - start[s]
            made += len(mine) * (stop[s] - start[s])
            for m in range(0, len(mine), ROWS):
                rows = mine[m : m + ROWS]
                p = scores(space, q[rows], x[start[s] : stop[s]], kth[rows])[:, at]
                ok = (own[None] != qid[rows, None]) & (p >= kth[rows, None])
                some = np.flatnonzero(ok.any(axis=1))
                if not len(some):
                    continue
                rows = rows[some]
                all_k = np.concatenate([known[rows], ok[some]], axis=1)
                all_s = np.concatenate([score[rows], p[some]], axis=1)
                all_i = np.concatenate([ident[rows], np.broadcast_to(own[None], ok.shape)[some]], axis=1)
                take = np.lexsort((all_i, ~all_s, ~all_k), axis=1)[:, :k]
                known[rows], score[rows], ident[rows] = (np.take_along_axis(a, take, 1) for a in (all_k, all_s, all_i))
                full = rows[known[rows, -1]]
                kth[full] = np.maximum(kth[full], score[full, -1])
    r, c = np.nonzero(known)
    return r, ident[r, c], score[r, c], made


def _search(batches: Iterator[pa.RecordBatch], space: Space, dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, block, own, pivot, dist, ids, v, floor) sorted by shard, block, own, pivot, dist."""
    held, last = [], None

    def work():
        t = pa.Table.from_batches(held).combine_chunks()
        own = t["own"].to_numpy()
        n = int((own == 0).sum())
        if n and n < len(own):
            ids, v = t["ids"].to_numpy(), dense(t["v"].combine_chunks(), dim)
            entry, qid = np.repeat(np.arange(n), [len(i) for i in ids[:n]]), np.array([i[0] for i in ids[n:]])
            r, i, s, _ = best(space, entry, np.concatenate(ids[:n]), v[:n], t["pivot"].to_numpy()[:n], t["dist"].to_numpy()[:n], qid, v[n:], t["floor"].to_numpy()[n:], k)
            if len(r):
                yield pa.record_batch([pa.array(qid[r]), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])

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


def entries(rows: DataFrame, k: int) -> DataFrame:
    """rows (id, v) -> a row per distinct v with its k + 1 least distinct ids, each as often as it has rows (k times at most)."""
    each = rows.groupBy("v", "id").agg(F.count("*").alias("times"))
    least = each.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    lists = least.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "times"))).alias("ids"))
    return lists.select("v", F.flatten(F.transform("ids", lambda e: F.array_repeat(e["id"], F.least(e["times"], F.lit(k)).cast("int")))).alias("ids"))


def fit(rows: DataFrame, dim: int, sample: int = SAMPLE) -> Space:
    """rows: (id, v). Centre and pivots of a sample by rounds of k-means; the radius covers all rows."""
    drawn = rows.select("id", "v").orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample)
    x = np.array([list(r.v) + [0.0] * (dim - len(r.v)) for r in drawn.collect()])
    most = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c)))), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).first()
    unit = 2.0 ** max(0, math.frexp(most[0])[1] - 400)
    centre = np.rint((x / unit).mean(axis=0)) * unit
    gap = F.zip_with(F.col("v"), F.array(*[F.lit(float(c)) for c in centre]), lambda a, c: F.coalesce(a, F.lit(0.0)) / unit - c / unit)
    top = math.sqrt(rows.agg(F.max(F.aggregate(gap, F.lit(0.0), lambda a, c: a + c * c))).first()[0]) * (1 + 1e-9)
    space = Space(centre, np.zeros((0, dim + 1)), top, unit, most[1] < 2.0**51)
    p = space.points(x)
    pivots = p[:: max(1, len(p) // PIVOTS)][:PIVOTS]
    for _ in range(8):
        near = space._replace(pivots=pivots).distances(p).argmin(axis=1)
        pivots = np.array([p[near == i].mean(axis=0) if (near == i).any() else pivots[i] for i in range(len(pivots))])
    return space._replace(pivots=pivots)


def build(rows: DataFrame, space: Space, dim: int, shard: int = SHARD) -> DataFrame:
    """rows (v, ids), a written table -> a written table with pivot, dist and shard of each."""

    def keyed(batches):
        for b in batches:
            d = space.distances(space.points(dense(b.column(0), dim)))
            near = d.argmin(axis=1)
            yield pa.record_batch([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["v", "ids", "pivot", "dist"])

    n = rows.count()
    size, order = max(shard, math.ceil(n / MOST)), ["pivot", "dist", F.element_at("ids", 1)]
    index = rows.select("v", "ids").mapInArrow(keyed, "v array<double>, ids array<long>, pivot int, dist double")
    index = index.repartitionByRange(math.ceil(n / size), *order).sortWithinPartitions(*order)
    index = materialize(index.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "topk-index")
    # shards are cut by position in the whole order, however many partitions there are: a row a partition, MOST at most
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = index.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return index.join(F.broadcast(parts), "part").withColumn("shard", F.floor((F.col("before") + F.col("at")) / size).cast("int")).drop("part", "at", "before")


def reach(asked: DataFrame, index: DataFrame, space: Space, dim: int) -> DataFrame:
    """asked (id, v, home, floor) -> a row for every shard but home that may reach a query's floor; if home is null, for that of the highest bound."""
    ranges = index.groupBy("shard", "pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi")).orderBy("shard", "pivot").toPandas()
    shard, pivot, lo, hi = (ranges[c].to_numpy() for c in ("shard", "pivot", "lo", "hi"))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                home, floor = part.column(2).fill_null(-1).to_numpy(), part.column(3).to_numpy() / space.unit / space.unit
                bound = space.bounds(space.asked(dense(part.column(1), dim)), pivot, lo, hi)
                live = (bound >= (floor - 1e-9 * np.abs(floor))[:, None]) & (shard[None, :] != home[:, None])
                live &= (home >= 0)[:, None] | (np.arange(len(shard))[None, :] == bound.argmax(axis=1)[:, None])
                q, r = np.nonzero(live)
                if len(q):
                    pairs = np.unique(np.column_stack([q, shard[r]]), axis=0)
                    t = pa.Table.from_batches([part]).take(pa.array(pairs[:, 0]))
                    yield from pa.table({"shard": pa.array(pairs[:, 1].astype(np.int32)), "id": t["id"], "v": t["v"], "floor": t["floor"]}).to_batches()

    return asked.select("id", "v", F.col("home").cast("int").alias("home"), F.col("floor").cast("long").alias("floor")).mapInArrow(run, "shard int, id long, v array<double>, floor long")


def _meet(index: DataFrame, asked: DataFrame, space: Space, dim: int, k: int, block: int) -> DataFrame:
    """asked (shard, id, v, floor): finds of each query in its shard."""
    blocks = asked.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    held = index.join(blocks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("own"), "pivot", "dist", "ids", "v", F.lit(0).cast("long").alias("floor"))
    own = asked.join(blocks, "shard").select("shard", F.pmod(F.xxhash64("id", F.lit(5)), "blocks").cast("int").alias("block"), F.lit(1).alias("own"), F.lit(0).alias("pivot"), F.lit(0.0).alias("dist"), F.array("id").alias("ids"), "v", "floor")
    both = held.unionByName(own).repartition("shard", "block").sortWithinPartitions("shard", "block", "own", "pivot", "dist")
    return both.mapInArrow(lambda it: _search(it, space, dim, k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: Column | None = None, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. queries: a condition on vec_id of the rows that ask."""
    asks = F.col("vec_id") % 20 == 0 if queries is None else queries
    finite = F.forall("embedding", lambda x: F.coalesce((F.abs(x.cast("double") * 64) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = vectors.where("vec_id is not null and embedding is not null").where(finite & (F.size("embedding") > 0))
    # from 2^52 on a double has no fraction, and floor() to a long would stop at the ends of a long; -0.0 equals 0.0
    whole = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double") * 64) < 2.0**52, F.floor(x.cast("double") * 64).cast("double")).otherwise(x.cast("double") * 64))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), whole.alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    n, dim, n_asks = rows.agg(F.count("*"), F.max(F.size("v")), F.sum(F.col("asks").cast("long"))).first()
    if not n or not n_asks:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space = fit(rows, dim)
    index = build(materialize(entries(rows, k), "topk-entries"), space, dim, shard)
    once = materialize(rows.where("asks").groupBy("id").agg(F.min("v").alias("v")), "topk-queries")
    least = F.lit(LONG[0])
    first = materialize(reach(once.select("id", "v", F.lit(None).alias("home"), least.alias("floor")), index, space, dim), "topk-first")
    home = materialize(_meet(index, first, space, dim, k, block), "topk-home")
    floors = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor")).where("floor is not null")
    asked = first.join(floors, first["id"] == floors["query_id"], "left").select("id", "v", F.col("shard").alias("home"), F.coalesce(floors["floor"], least).alias("floor"))
    rest = materialize(reach(asked, index, space, dim), "topk-reach")
    found = home.unionByName(_meet(index, rest, space, dim, k, block))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
