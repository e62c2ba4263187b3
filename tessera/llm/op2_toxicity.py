"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs to Latin letters and digit substitutions to the letters
they stand for, so "1d1оt" and "idiot" are one term. The lexicon is learned from a bounded
sample of labelled rows (SAMPLE, a documented parameter): terms are folded words and word
stems of STEMS letters. Every term of SUPPORT toxic rows is counted in both classes by one
aggregation; those of large log-odds that chance doesn't explain are candidates, however many
and however rare. A greedy cover picks among them, and each weighs its log-odds. A phrase of a term and the
word beside it that the clean rows use and the toxic ones don't is an exception, however many
such phrases the sample has: a match inside it doesn't count.
Scoring reads each whole text once: summed weights, and the same normalised by length, go
through a logistic function fitted on the sample.

Only the model (some hundred terms) is sent to the executors. The sample is written to the
shared folder; counting runs there. Nothing else is shuffled.

Defined cases: null or empty text matches nothing and gets the score of a text without
matches; rows without a usable label teach nothing; repeated rows are scored alike; without
any toxic training row the lexicon is empty and every score is 0; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tessera.llm.common import bucket_of, materialize

SAMPLE, STEMS, SUPPORT, ODDS, DOUBT, THRESHOLD = 20_000, (3, 4, 5, 6, 7), 5, 3, 1.0, 0.7
#: Look-alikes of Latin letters, and digits and signs written for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Phrases that hold a term without being meant as one; more are learned.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish")
FOLD = str.maketrans(HOMOGLYPHS | DIGITS | {"​": None, "‌": None, "‍": None, "­": None, "﻿": None})
TOKEN, AFTER = re.compile(r"[^\W\d_]+"), re.compile(r" ([^\W\d_]+)")


def fold(text: str) -> str:
    return text.lower().translate(FOLD)


def terms(text: str) -> set[str]:
    """Folded words, and stems as "abcde*", of one text."""
    words = set(TOKEN.findall(fold(text)))
    return {w for w in words if len(w) > 2} | {f"{w[:n]}*" for n in STEMS for w in words if len(w) > n}


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text with any term: its key and eight minhashes of its terms."""
    mul = np.random.default_rng(7).integers(1, 1 << 61, 8, dtype=np.uint64) | np.uint64(1)
    for b in batches:
        keys, prints = [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            h = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in terms(text)], np.uint64)
            if len(h):
                h = (h[:, None] + np.uint64(1)) * mul
                h ^= h >> np.uint64(29)
                keys.append(key)
                prints.append((h * mul).min(axis=0).view(np.int64).tolist())
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(prints, pa.list_(pa.int64()))], names=["key", "prints"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many clean and toxic rows of a batch hold each term."""
    for b in batches:
        out: tuple[Counter, Counter] = Counter(), Counter()
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            out[bool(toxic)].update(terms(text))
        names = list(out[0] | out[1])
        yield pa.record_batch([pa.array(names, pa.string()), *(pa.array([o[t] for t in names], pa.int64()) for o in out)], names=["term", "clean", "toxic"])


def _incidence(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The terms of the list that each row holds."""
    at = {t: i for i, t in enumerate(names)}
    for b in batches:
        hits = [sorted(at[t] for t in terms(text) if t in at) for text in b.column(0).to_pylist()]
        yield pa.record_batch([pa.array(hits, pa.list_(pa.int64()))], names=["hits"])


def _distinct(prints: list[tuple[int, list[int]]]) -> list[int]:
    """Keys of rows without those whose terms are nearly a former row's (half of eight minhashes agree): copies are no further evidence."""
    kept: list[int] = []
    seen: dict[tuple, list[int]] = {}
    for key, row in sorted(prints):
        votes: dict[int, int] = {}
        places = list(enumerate(row))
        for k in places:
            for d in seen.get(k, ()):
                votes[d] = votes.get(d, 0) + 1
        if max(votes.values(), default=0) < 4:
            for k in places:
                seen.setdefault(k, []).append(key)
            kept.append(key)
    return kept


def _passing(counted: DataFrame, n: int, n_clean: int) -> list:
    """Terms of n toxic and n_clean clean rows whose odds are large and significant: (term, odds).

    The chance that rows picked blindly put so many of a term's rows among the toxic ones is
    at most exp(-evidence) (Hoeffding's bound); times the number of terms tested, as many terms
    may be expected to pass by chance: DOUBT of them at most.
    """
    tested = counted.count()
    t, c, share = F.col("toxic"), F.col("clean"), n / (n + n_clean)
    evidence = t * F.log(t / (t + c) / share) + F.when(c > 0, c * F.log(c / (t + c) / (1 - share))).otherwise(0.0)
    odds = F.log((t + 0.5) / (n + 1)) - F.log((c + 0.5) / (n_clean + 1))
    return counted.select("term", odds.alias("odds")).where((odds >= ODDS) & (evidence >= math.log(max(1, tested) / DOUBT))).orderBy("term").collect()


def _cover(rows: list[list[int]], odds: list[float], names: list[str]) -> dict[str, float]:
    """Greedy cover, names in order: terms until each toxic row holds three of them, if it can."""
    need, chosen, by = np.full(len(rows), 3), {}, {}
    for d, r in enumerate(rows):
        for i in r:
            by.setdefault(i, []).append(d)
    by = {i: np.array(d) for i, d in by.items()}
    heads: set[str] = set()
    heap = [(-len(d), -len(d), -i) for i, d in by.items()]
    heapq.heapify(heap)
    while heap:
        was, size, i = heapq.heappop(heap)
        docs, word = by[-i], names[-i]
        gain = int((need[docs] > 0).sum())
        if gain < -was:  # gains only fall: what is still largest is the best
            if gain:
                heapq.heappush(heap, (-gain, size, i))
            continue
        chosen[word] = odds[-i]
        if word[: STEMS[0]] not in heads:
            heads.add(word[: STEMS[0]])
            need[docs] -= 1
    return chosen


class Matcher:
    """Aho-Corasick over folded text. A term must start where a word does, and end where it does unless it is a stem."""

    def __init__(self, model: dict):
        import ahocorasick

        self.model, self.auto = model, ahocorasick.Automaton()
        own: dict[str, list] = {}
        for t, w in model["terms"].items():
            own.setdefault(t.rstrip("*"), [0.0, 0.0, False])[t[-1] == "*"] = w
        for p in model["exceptions"]:
            own.setdefault(p, [0.0, 0.0, False])[2] = True
        for t, v in own.items():
            self.auto.add_word(t, (len(t), *v))
        self.some = bool(model["terms"])
        if self.some:
            self.auto.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        if not self.some:
            return []
        found, spared, text = [], [], fold(text)
        for end, (n, word, stem, exception) in self.auto.iter(text):
            start, stop = end - n + 1, end + 1
            if start and text[start - 1].isalpha():
                continue
            whole = stop == len(text) or not text[stop].isalpha()
            if exception and whole:
                spared.append((start, stop))
            if weight := max(word if whole else 0.0, stem):
                if found and found[-1][0] == start:
                    weight = max(weight, found.pop()[2])
                found.append((start, stop, weight))
        spared.sort()
        starts, reach = [a for a, _ in spared], [0, *accumulate((b for _, b in spared), max)]
        return [m for m in found if reach[bisect.bisect_right(starts, m[0])] < m[1]]

    def features(self, text: str) -> tuple[float, float]:
        total = sum(m[2] for m in self.matches(text))
        return math.log1p(total), math.log1p(100 * total / (len(text.split()) + 20))

    def score(self, text: str) -> float:
        if not self.some:
            return 0.0
        a, b, c = self.model["logit"]
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * x + c * y))))


def _features(batches, model: str):
    m = Matcher(json.loads(model))
    for b in batches:
        rows = [m.features(t) for t in b.column(0).to_pylist()]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64()), b.column(1).cast(pa.int32())], names=["x", "y", "toxic"])


def _around(batches, model: str):
    """The phrases of two words that hold a match."""
    m = Matcher(json.loads(model))
    for b in batches:
        out = {}
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            folded = fold(text)
            for start, _, _ in m.matches(text):
                here = TOKEN.match(folded, start)
                if not here:
                    continue
                after = AFTER.match(folded, here.end())
                at = start - 1
                while at > 0 and TOKEN.match(folded, at - 1, at):
                    at -= 1
                before = folded[at : start - 1] if start and folded[start - 1] == " " else ""
                for p in ([f"{here[0]} {after[1]}"] if after else []) + ([f"{before} {here[0]}"] if before else []):
                    out.setdefault(p, [0, 0])[bool(toxic)] += 1
        yield pa.record_batch([pa.array(list(out), pa.string()), pa.array([v[0] for v in out.values()], pa.int64()), pa.array([v[1] for v in out.values()], pa.int64())], names=["phrase", "clean", "toxic"])


def _logit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton's method; classes weigh alike."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b))
        b += np.linalg.solve(h, x.T @ (w * (y - p)) - 0.1 * b)
    return b.tolist()


def learn(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE, exceptions: tuple = EXCEPTIONS) -> dict:
    """train: a condition on doc_id that a row to learn from meets. sample: expected number of rows at most."""
    known = labels.where("toxic is not null and doc_id is not null").where(train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    part = min(1.0, sample / max(1, n))
    ids = known.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1_000_000)) < int(part * 1_000_000))
    rows = docs.where(train).where("text is not null").select("doc_id", "text").join(ids, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    rows = materialize(rows, "toxic-sample")
    model: dict = {"terms": {}, "exceptions": [], "logit": [0, 0, 0]}
    once = rows.distinct().withColumn("key", F.xxhash64("text"))
    toxic = once.where("toxic > 0")
    kept = _distinct([(r.key, r.prints) for r in toxic.select("key", "text").mapInArrow(_prints, "key long, prints array<long>").collect()])
    n_clean = once.where("toxic = 0").count()
    if not kept or not n_clean:
        return model
    own = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in kept], "key long"))
    seen = once.where("toxic = 0").unionByName(toxic.join(own, "key", "left_semi")).select("text", "toxic")
    counted = seen.mapInArrow(_counts, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    passing = _passing(materialize(counted.where(F.col("toxic") >= SUPPORT), "toxic-terms"), len(kept), n_clean)
    if not passing:
        return model
    names, odds = [r.term for r in passing], [r.odds for r in passing]
    got = seen.where("toxic > 0").select("text").mapInArrow(lambda it: _incidence(it, names), "hits array<long>").collect()
    model["terms"] = _cover([r.hits for r in got], odds, names)
    text = json.dumps(model)
    around = rows.mapInArrow(lambda it: _around(it, text), "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    spared = around.where("clean >= 5 and clean > 20 * toxic").orderBy("phrase").collect()
    model["exceptions"] = sorted({*map(fold, exceptions), *(r.phrase for r in spared)})
    text = json.dumps(model)
    got = rows.mapInArrow(lambda it: _features(it, text), "x double, y double, toxic int").toPandas()
    model["logit"] = _logit(got[["x", "y"]].to_numpy(), (got["toxic"] > 0).to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """_row (the columns keep), score and predicted, for every row."""
    text = json.dumps(model)

    def run(batches):
        m = Matcher(json.loads(text))
        for b in batches:
            s = [m.score(t or "") for t in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], names=["_row", "score", "predicted"])

    rows = docs.select(F.col("text").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"))
    return rows.mapInArrow(run, StructType([rows.schema["_row"], StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from rows outside the third that is held out, scores all."""
    model = learn(docs, labels, bucket_of(F.col("doc_id"), 3) != 1)
    out = score(docs, model, ["doc_id"]).select("_row.doc_id", "score", "predicted")
    return out.select("doc_id", (bucket_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
