"""Substring dedup by a log-structured index of window fingerprints.

A window is WINDOW consecutive words; a word goes if some window over it also starts in a
document with a smaller doc_id. Of the hashes of the GRAM-word grams in a window the index
keeps the least: equal windows have equal least grams, and a document has few distinct ones
(about a thirteenth of its windows).

The index is a folder. Documents come in batches, by ascending doc_id, and each batch becomes
one immutable run of three tables, bucketed and sorted by their keys:

    texts    (t1, t2)  its distinct texts, and the least doc_id of each
    grams    (gram)    how many of its texts hold a gram, and one of them
    windows  (w1, w2)  128-bit digests of windows under grams that two texts hold, least doc_id

Former runs are joined as they lie with the new one: they are neither exchanged nor read by
other keys. A gram that two texts hold, former ones included, makes its windows candidates; they are
verified by digests of their whole words, in the batch's texts and, where the gram had one
holder so far, in that former text. Before a batch that finds FANOUT runs these are compacted
to one. A manifest, written last, names the runs; a later session opens the folder and goes on.

Equal texts fall together first: only the first of a group of copies meets the index, the
others lose all their windows at once. Grams of many texts are found before anything is
exchanged, by their counts within tasks. The rows of all other grams, and of windows under
them, are exchanged once, into scratch tables bucketed as the runs are; those of the many are
dealt to several tasks, and their counts combined before they are exchanged.

Defined cases: null text has no words; texts of under WINDOW words keep all; repeated rows
with one doc_id don't remove each other's words; a null doc_id neither removes nor loses
words; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import HOT, drop, folders, hot_join, made, materialize, scratch_folder
from tessera.llm.windows import grams, lows, word_hashes, words

WINDOW, GRAM, FANOUT, BATCHES = 50, 25, 2, 3
#: Texts of one task that may hold a gram before its rows are dealt to several tasks, however many tasks there are.
OFTEN = 16
#: Of each table of a run: its schema and the leading columns that are its key.
TABLES = {
    "texts": ("t1 long, t2 long, first long, raw binary, grams array<long>", 2),
    "grams": ("gram long, n long, t1 long, t2 long", 1),
    "windows": ("w1 long, w2 long, first long", 2),
}


def anchors(raw: bytes, start: np.ndarray, end: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The least gram of every window, as signed longs."""
    return lows(grams(word_hashes(raw, start, end), gram), window - gram + 1).view(np.int64)


def _scan(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, sha = [], []
        for raw in b.column(3).to_pylist():
            parts = (raw or b"").split()
            n.append(len(parts))
            sha.append(hashlib.sha256(b" ".join(parts)).hexdigest())
        yield pa.record_batch([*b.columns[:3], pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "t1", "t2", "n_words", "sha"])


def _grams(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Adds the anchors of texts (t1, t2, first, raw); those of too few words go."""
    for b in batches:
        keys = []
        for raw in b.column(3).to_pylist():
            start, end = words(raw)
            keys.append(np.unique(anchors(raw, start, end, window, gram)) if len(start) >= window else np.zeros(0, np.int64))
        offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int64), *keys]))
        yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "grams"]).filter(pa.array(np.diff(offsets) > 0))


def _often(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The grams that more than so many rows of lists in one task hold."""
    keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(b.column(0).flatten().to_numpy() for b in batches)]), return_counts=True)
    yield pa.record_batch([pa.array(keys[n > most])], names=["gram"])


def _digest(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (t1, t2, first, raw, grams) -> every window whose least gram is among grams, once a text with all its starts (32-bit)."""
    from xxhash import xxh3_128_digest

    for b in batches:
        for t1, t2, first, raw, asked in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            start, end = words(raw)
            at = np.flatnonzero(np.isin(anchors(raw, start, end, window, gram), np.array(asked, np.int64)))
            parts = raw.split()
            line = b" ".join(parts)
            stop = np.cumsum(end - start) + np.arange(len(start))
            begin = stop - (end - start)
            for k in range(0, len(at), 1 << 15):
                own = at[k : k + (1 << 15)]
                keys = np.frombuffer(b"".join([xxh3_128_digest(line[s:e]) for s, e in zip(begin[own].tolist(), stop[own + window - 1].tolist(), strict=True)]), np.int64).reshape(-1, 2)
                order = np.lexsort(keys.T)
                keys, starts = keys[order], own[order].astype(np.int32)
                new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
                n, offsets = len(new), np.append(new, len(keys)).astype(np.int32) * 4
                lists = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(starts)])
                yield pa.record_batch([pa.array(keys[new, 0]), pa.array(keys[new, 1]), pa.array(np.full(n, t1)), pa.array(np.full(n, t2)), pa.array(np.full(n, first)), lists], names=["w1", "w2", "t1", "t2", "first", "starts"])


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (t1, t2, raw, starts of removed windows) -> results."""
    for b in batches:
        out = []
        for raw, starts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            parts = raw.split()
            edge = np.zeros(len(parts) + 1, np.int64)
            starts = np.frombuffer(b"".join(starts), np.int32)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join([w for w, g in zip(parts, gone.tolist(), strict=True) if not g])
            out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest()))
        if out:
            c = list(zip(*out, strict=True))
            yield pa.record_batch([*b.columns[:2], pa.array(c[0], pa.int64()), pa.array(c[1], pa.string())], names=["t1", "t2", "n_removed", "kept"])


class FingerprintIndex:
    """The index in the folder path, opened if there is one, else begun."""

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path, fanout
        versions = sorted(v for v in folders(spark, f"{path}/manifest") if folders(spark, f"{path}/manifest/{v}", "_SUCCESS"))
        self.state = {"version": 0, "buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "window": window, "gram": gram, "runs": []}
        if versions:
            self.state = json.loads(spark.read.text(f"{path}/manifest/{versions[-1]}").first()[0])
        self.window, self.gram = self.state["window"], self.state["gram"]

    def _commit(self, runs: list[str]) -> None:
        """The manifest is one line; a version without its mark of success doesn't count."""
        self.state = self.state | {"version": self.state["version"] + 1, "runs": runs}
        self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.text(f"{self.path}/manifest/{self.state['version']:09d}")

    def _write(self, df: DataFrame, run: str, table: str) -> DataFrame:
        return self._bucketed(df, TABLES[table][1], f"{self.path}/{run}/{table}")

    def _bucketed(self, df: DataFrame, n: int, path: str) -> DataFrame:
        keys, name = df.columns[:n], f"run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.state["buckets"], *keys).sortBy(*keys).option("path", path).saveAsTable(name)
        return self._taken(name)

    def _dealt(self, df: DataFrame, n: int, name: str) -> DataFrame:
        """df, exchanged once, in a scratch folder: what groups or joins it by its n leading columns does not exchange it again."""
        return self._bucketed(df.repartition(self.state["buckets"], *df.columns[:n]), n, scratch_folder(self.spark, name))

    def _taken(self, name: str) -> DataFrame:
        """The files of a table, with their buckets; the catalogue forgets its name."""
        df = self.spark.table(name)
        self.spark.sql(f"drop table {name}")
        return df

    def run(self, run: str, table: str) -> DataFrame:
        schema, n = TABLES[table]
        keys = ", ".join(c.split()[0] for c in schema.split(", ")[:n])
        name = f"run_{uuid.uuid4().hex}"
        self.spark.sql(f"create table {name} ({schema}) using parquet clustered by ({keys}) sorted by ({keys}) into {self.state['buckets']} buckets location '{self.path}/{run}/{table}'")
        return self._taken(name)

    def compact(self) -> None:
        """One run in place of all; once the manifest names it alone, the former ones are deleted."""
        runs, new = self.state["runs"], f"run-{uuid.uuid4().hex}"
        all_ = {t: reduce(DataFrame.union, [self.run(r, t) for r in runs]) for t in TABLES}
        self._write(all_["texts"], new, "texts")  # a text is in the first run that met it, and in no other
        self._write(all_["grams"].groupBy("gram").agg(F.sum("n").alias("n"), F.min(F.struct("t1", "t2")).alias("t")).select("gram", "n", "t.t1", "t.t2"), new, "grams")
        self._write(all_["windows"].groupBy("w1", "w2").agg(F.min("first").alias("first")), new, "windows")
        self._commit([new])
        drop(self.spark, made(), tuple(f"{self.path}/{r}" for r in runs))

    def _met(self, df: DataFrame, table: str, columns: list[str]) -> DataFrame:
        """df with the columns of the former runs' rows of its keys, each as a list (null without any)."""
        keys = [c.split()[0] for c in TABLES[table][0].split(", ")[: TABLES[table][1]]]
        for k, r in enumerate(self.state["runs"]):
            old = self.run(r, table).select(*keys, F.struct(*columns).alias(f"_old{k}"))
            df = df.join(old, keys, "left")
        olds = [f"_old{k}" for k in range(len(self.state["runs"]))]
        met = F.array_compact(F.array(*olds)) if olds else F.array().cast(f"array<struct<{','.join(f'{c}:long' for c in columns)}>>")
        return df.withColumn("_met", met).drop(*olds)

    def add(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, text) of a batch, all ids above the former batches' -> doc_id, n_words, n_removed, kept_sha256, a written table."""
        if len(self.state["runs"]) >= self.fanout:
            self.compact()
        window, gram, new, mark = self.window, self.gram, f"run-{uuid.uuid4().hex}", made()
        out = scratch_folder(self.spark, "substring-result")
        self._add(docs, window, gram, new).write.parquet(out)
        self._commit([*self.state["runs"], new])
        drop(self.spark, mark, keep=(out,))
        return self.spark.read.parquet(out)

    def _add(self, docs: DataFrame, window: int, gram: int, new: str) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.cast("binary").alias("raw"))
        plain = materialize(rows.mapInArrow(lambda it: _scan(it, window, gram), "doc_id long, t1 long, t2 long, n_words long, sha string"), "substring-docs")
        known = rows.where("doc_id is not null").groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.first("raw").alias("raw"))
        met = self._met(known, "texts", ["first"]).where("size(_met) = 0").drop("_met")
        texts = self._write(met.mapInArrow(lambda it: _grams(it, window, gram), TABLES["texts"][0]), new, "texts")
        # grams of more texts than one task should get: some task holds more than their mean
        most = max(HOT // self.state["buckets"], OFTEN)
        often = materialize(texts.select("grams").mapInArrow(lambda it: _often(it, most), "gram long").distinct(), "substring-often")
        dealt = [False] if often.isEmpty() else [False, True]
        all_ = texts.select(F.explode("grams").alias("gram"), "t1", "t2")
        held = [all_.join(F.broadcast(often), "gram", "left_semi" if many else "left_anti") if dealt[1:] else all_ for many in dealt]
        held[0] = self._dealt(held[0], 1, "substring-grams")
        # which grams two texts hold, and which of them had one holder so far
        counted = reduce(DataFrame.union, [h.groupBy("gram").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2")).alias("t")).select("gram", "n", "t.t1", "t.t2") for h in held])
        own = self._write(counted, new, "grams")
        before = F.aggregate("_met", F.lit(0).cast("long"), lambda a, m: a + m["n"])
        shared = self._met(own, "grams", ["n", "t1", "t2"]).withColumn("before", before).where(F.col("n") + F.col("before") > 1)
        shared = materialize(shared.select("gram", "n", F.when(F.col("before") == 1, F.col("_met")[0]).alias("old")), "shared-grams")
        digested = []
        for many, h in zip(dealt, held, strict=True):
            own = shared if not dealt[1:] else shared.join(F.broadcast(often), "gram", "left_semi" if many else "left_anti")
            asked = (hot_join(h, own.select("gram", "n"), ["gram"], "n") if many else h.join(own.select("gram"), "gram")).groupBy("t1", "t2").agg(F.collect_set("gram").alias("asked"))
            seen = [texts.join(asked, ["t1", "t2"]).select("t1", "t2", "first", "raw", "asked")]
            late = own.where("old is not null").groupBy("old.t1", "old.t2").agg(F.collect_set("gram").alias("asked"))
            seen += [self.run(r, "texts").join(late, ["t1", "t2"]).select("t1", "t2", "first", "raw", "asked") for r in self.state["runs"]]
            digests = reduce(DataFrame.union, [s.mapInArrow(lambda it: _digest(it, window, gram), "w1 long, w2 long, t1 long, t2 long, first long, starts binary") for s in seen])
            digests = materialize(digests, "substring-windows") if many else self._dealt(digests, 2, "substring-windows")
            # whose windows start in a document of a smaller id
            least = digests.groupBy("w1", "w2").agg(F.min("first").alias("first"), F.max("first").alias("last"), F.count("*").alias("n"))
            least = self._bucketed(self._met(least, "windows", ["first"]), 2, scratch_folder(self.spark, "substring-least"))
            digested.append((many, digests, least))
        self._write(reduce(DataFrame.union, [least.select("w1", "w2", "first") for _, _, least in digested]), new, "windows")
        gone = []
        for many, digests, least in digested:
            low = least.select("w1", "w2", "n", "last", F.aggregate("_met", F.col("first"), lambda a, m: F.least(a, m["first"])).alias("low")).where("low < last").drop("last")
            gone.append((hot_join(digests, low, ["w1", "w2"], "n") if many else digests.join(low, ["w1", "w2"])).where("low < first").select("t1", "t2", "starts"))
        gone = reduce(DataFrame.union, gone).groupBy("t1", "t2").agg(F.collect_list("starts").alias("starts"))
        cut = texts.select("t1", "t2", "raw").join(gone, ["t1", "t2"]).select("t1", "t2", "raw", "starts")
        cut = materialize(cut.mapInArrow(lambda it: _cut(it, window), "t1 long, t2 long, n_removed long, kept string"), "substring-cut")
        # what holds for a text holds for its first document; later ones lose all
        each = plain.where("doc_id is not null").groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
        each = self._met(each, "texts", ["first"]).withColumn("first", F.aggregate("_met", F.col("first"), lambda a, m: F.least(a, m["first"]))).drop("_met")
        each = materialize(each.join(cut, ["t1", "t2"], "left"), "substring-firsts")
        of = hot_join(plain, each, ["t1", "t2"], "rows", "left")
        whole = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window), F.lit(False))
        part = F.coalesce(F.col("n_removed").isNotNull() & (F.col("doc_id") == F.col("first")), F.lit(False))
        return of.select("doc_id", "n_words", F.when(whole, F.col("n_words")).when(part, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"), F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).when(part, F.col("kept")).otherwise(F.col("sha")).alias("kept_sha256"))


def dedup(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: all docs as batches of a new index, by ascending doc_id (null ids with the first)."""
    index = FingerprintIndex(docs.sparkSession, scratch_folder(docs.sparkSession, "substring-index"), window, gram, fanout)
    id_ = F.col("doc_id").cast("long")
    cuts = docs.agg(F.percentile_approx(id_, [k / batches for k in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    bounds, out = [None, *sorted(set(cuts)), None], []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        part = docs.where((F.lit(True) if high is None else id_ <= high) | id_.isNull()) if low is None else docs.where((id_ > low) & (F.lit(True) if high is None else id_ <= high))
        out.append(index.add(part.select("doc_id", "text")))
    return reduce(DataFrame.union, out)
