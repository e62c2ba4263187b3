"""What the corpus operators share: scratch tables, graph components, fixed patterns."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text, as the contracts of the operators have it.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one key that one task of a join may get.
HOT = 1_000

_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local one only in local mode, where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(scratch_root, "local", None)
        if not root:
            root = scratch_root.local = tempfile.mkdtemp(prefix="tessera-")
    return root


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for release() to delete."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def folders(spark: SparkSession, path: str, name: str = "*") -> list[str]:
    """Names in a folder of any of Spark's file systems that match; none if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    return [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Steps that run inside send rows to Python so many at a time at most: for wide rows, of which the default 10,000 fill the memory beside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def made() -> int:
    """A mark for drop(): how many scratch folders there are."""
    return len(_made)


def drop(spark: SparkSession, since: int, paths: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> None:
    """Delete the folders paths, and the scratch folders made since a mark, but for those to keep.

    Spark deletes the shuffle files of queries that nothing refers to when the driver's garbage
    is collected: that is asked for too, so that a long job holds the files of its last steps alone.
    """
    old, _made[since:] = _made[since:], [m for m in _made[since:] if m[1] in keep]
    for path in (*paths, *(p for _, p in old if p not in keep)):
        _delete(spark, path)
    gc.collect()
    spark._jvm.java.lang.System.gc()


def release(keep: int = 0) -> None:
    """Delete the scratch tables written so far; call it once their results are written."""
    while len(_made) > keep:
        spark, path = _made.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: the folder goes with it
            return


atexit.register(release)


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def hot_join(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str, how: str = "inner", hot: int | None = None) -> DataFrame:
    """rows join keyed (one row a key; n: how many rows have the key) with keys of over hot rows dealt to several tasks.

    The keys of more than hot rows, at most len(rows) / hot of them, are looked up first; Spark
    broadcasts that list if its size allows. Their rows are dealt by position, and keyed has a
    copy of such a key's row for each part.
    """
    hot = hot or HOT
    large = keyed.where(F.col(n) > hot).select(*keys, F.ceil(F.col(n) / hot).cast("int").alias("_parts"))
    dealt = rows.join(large, keys, "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = keyed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(n) / hot).cast("int"), F.lit(1)) - 1)))
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """edges (a, b) of one orderable type -> (node, component): the smallest node reachable, for every node of an edge.

    Alternating large-star and small-star steps; each round is a handful of combinable
    aggregations and equi-joins, the number of rounds is logarithmic in the longest chain,
    and nothing is gathered in the driver but one count and checksum a round.
    """
    pairs = edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = materialize(pairs, name)
    last = None
    while True:
        n, mark = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (n, mark) == last or n == 0:
            break
        last = (n, mark)
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        few = 2 * n <= HOT  # then no node can have more edges than that
        star = (both.join(low, "u") if few else hot_join(both, low, ["u"], "n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        star = star.distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (star.join(low, "u") if few else hot_join(star, low, ["u"], "n")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        cur = materialize(small, name)
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def forest(n: int, left: np.ndarray, right: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Root of each of n nodes under the links (left[i], right[i]): the smallest index of its tree."""
    root = np.arange(n) if root is None else root
    while len(left):
        a, b = root[left], root[right]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        open_ = lo < hi
        if not open_.any():
            break
        left, right, lo, hi = left[open_], right[open_], lo[open_], hi[open_]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
