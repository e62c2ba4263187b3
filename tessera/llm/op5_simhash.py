"""SimHash near-dedup by tiled exact comparison of 64-bit fingerprints.

A fingerprint sums the XXH64 bits (seed 42) of a document's 3-word shingles. Equal
fingerprints fall together first, so copies cost one row. Distinct ones are sorted by
population count and fingerprint and cut into tiles of TILE rows; tiles are compared exactly,
by numpy exclusive-or and bit counts, and pairs of tiles whose population counts differ by
more than the radius are skipped.

Population counts alone leave more than half of all pairs of tiles, a number that grows with
the square of the fingerprints. Two fingerprints within RADIUS = 3 bits agree in one of four
16-bit blocks, so the sort is made four times, by a block's value first: then pairs of tiles
that share no value of the block are skipped as well, exactly. A tile holds all values
between its first and its last; only these two may go on in other tiles. A value of many
fingerprints fills many equal tiles, and its pairs of tiles are dealt to tasks one by one.

A pair of tiles gives a spanning forest of its links, never all pairs. Components come from
alternating star contraction, distributed.

Defined cases: null or empty text, and text of white space only, have fingerprint zero,
linked like any other; repeated rows are rows of one component; null doc_ids take part, and
a component's id is the smallest one that is not null; an empty table gives no rows; extra
columns are ignored, whatever their names (first_of_each keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batches_of, connected_components, forest, hot_join, materialize

RADIUS, BLOCKS, TILE, SALTS = 3, 4, 512, 16
#: Pairs of tiles sent to Python at once: 8 KB each.
TOGETHER = 128
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, words: int = 3) -> int:
    """Unsigned SimHash of one text."""
    from xxhash import xxh64_intdigest

    w = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not w:
        return 0
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w))) + np.arange(len(w))
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = min(words, len(w))
    hashes = [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[: len(w) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]
    h = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t or "") for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.record_batch([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _tiles(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, value, pop, fp) in order -> a row per tile: its number, ranges and fingerprints."""
    from pyspark import TaskContext

    base, count, held = TaskContext.get().partitionId() << 32, 0, np.zeros((4, 0), np.int64)

    def cut(n: int):
        nonlocal held, count
        block, value, pop, fp = held[:, :n]
        held, count = held[:, n:], count + 1
        row = [base + count - 1, int(block[0]), int(value[0]), int(value[-1]), int(pop.min()), int(pop.max()), fp.tolist()]
        return pa.record_batch([pa.array([x], t) for x, t in zip(row, [*[pa.int64()] * 6, pa.list_(pa.int64())], strict=True)], names=["tile", "block", "first", "last", "least", "most", "fps"])

    for b in batches:
        held = np.concatenate([held, np.stack([c.to_numpy() for c in b.columns])], axis=1)
        while held.shape[1]:
            other = np.flatnonzero(held[0, : tile + 1] != held[0, 0])
            n = int(other[0]) if len(other) else tile
            if n >= held.shape[1]:
                break
            yield cut(n)
    if held.shape[1]:
        yield cut(held.shape[1])


def tiles_of(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints (fp) -> a written table of tiles, each fingerprint in one of every block's."""
    value = F.array(*[F.shiftright("fp", 64 // BLOCKS * k).bitwiseAND(0xFFFF) for k in range(BLOCKS)])
    rows = fps.select("fp", F.posexplode(value)).select(F.col("pos").cast("long").alias("block"), F.col("col").alias("value"), F.bit_count("fp").cast("long").alias("pop"), "fp")
    order = ["block", "value", "pop", "fp"]
    dealt = rows.repartitionByRange(max(1, math.ceil(fps.count() * BLOCKS / (16 * tile))), *order).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(lambda it: _tiles(it, tile), "tile long, block long, first long, last long, least long, most long, fps array<long>"), "simhash-tiles")


def tile_pairs(tiles: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a <= b: tiles that share a value of their block and whose population counts come within radius."""
    ends = tiles.select("tile", "block", "least", "most", F.explode(F.array_distinct(F.array("first", "last"))).alias("value"))
    left = ends.select("block", "value", F.col("tile").alias("a"), F.col("least").alias("l"), F.col("most").alias("m"), F.pmod(F.xxhash64("tile"), F.lit(SALTS)).alias("salt"))
    right = ends.withColumnRenamed("tile", "b").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    near = left.join(right, ["block", "value", "salt"]).where("a < b").where((F.col("least") - F.col("m") <= radius) & (F.col("l") - F.col("most") <= radius))
    return near.select("a", "b").distinct().unionByName(tiles.select(F.col("tile").alias("a"), F.col("tile").alias("b")))


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (fingerprints of a tile, of another or null) -> links (a, b) with the components of all their pairs within radius."""
    for b in batches:
        out: list[np.ndarray] = []
        for one, two in zip(b.column(0), b.column(1), strict=True):
            left = one.values.to_numpy().view(np.uint64)
            right = two.values.to_numpy().view(np.uint64) if two.is_valid else left
            x, y = np.nonzero(np.bitwise_count(left[:, None] ^ right[None]) <= radius)
            all_ = np.concatenate([left, right]) if two.is_valid else left
            y = y + len(left) if two.is_valid else y
            root = forest(len(all_), x, y)
            own = np.flatnonzero(root != np.arange(len(all_)))
            if len(own):
                out.append(np.stack([all_[own], all_[root[own]]]).view(np.int64))
        if out:
            a = np.concatenate(out, axis=1)
            yield pa.record_batch([pa.array(a[0]), pa.array(a[1])], names=["a", "b"])


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) with the components of all pairs within radius <= 3."""
    tiles = tiles_of(fps, tile)
    pairs = materialize(tile_pairs(tiles, radius), "simhash-pairs")
    of = tiles.select("tile", "fps")
    own = of.select("fps", F.lit(None).cast("array<long>").alias("others"))
    two = pairs.where("a < b").join(of.withColumnRenamed("tile", "a"), "a").join(of.select(F.col("tile").alias("b"), F.col("fps").alias("others")), "b").select("fps", "others")
    return own.unionByName(two).mapInArrow(lambda it: _links(it, radius), "a long, b long")


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (doc_id, fp), a written table -> fp, component_id, root (a fingerprint of the component) and rows of every distinct fp."""
    fps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")), "simhash-distinct")
    with batches_of(prints.sparkSession, TOGETHER):
        found = materialize(links(fps.select("fp"), radius), "simhash-links")
    nodes = connected_components(found, "simhash-cc")
    of = materialize(fps.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", "rows", F.coalesce("component", "fp").alias("root")), "simhash-roots")
    low = of.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    return hot_join(of, low, ["root"], "members").select("fp", "component_id", "root", "rows")


def simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    prints = materialize(fingerprints(docs), "simhash")
    out = hot_join(prints, components(prints), ["fp"], "rows")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id, then of the least hash of its text.

    Rows with null doc_id come after all others; repeated rows count once. All columns are kept, whatever their names.
    """
    id_, key = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))
    prints = docs.select(F.struct(id_.alias("doc_id"), key.alias("t")).alias("doc_id"), "text")
    prints = materialize(prints.mapInArrow(_fingerprints, "doc_id struct<doc_id: long, t: long>, fp long").select("doc_id.doc_id", "doc_id.t", "fp"), "simhash")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("t"))
    kept = hot_join(prints, components(prints), ["fp"], "rows").groupBy("root").agg(F.min_by(F.struct("doc_id", "t"), order).alias("k"))
    keys = ["_id", "_null", "_t"]
    kept = materialize(kept.select(F.coalesce("k.doc_id", F.lit(0)).alias("_id"), F.col("k.doc_id").isNull().alias("_null"), F.col("k.t").alias("_t")), "simhash-kept")
    rows = docs.select(F.coalesce(id_, F.lit(0)).alias("_id"), id_.isNull().alias("_null"), key.alias("_t"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select("_row.*")
