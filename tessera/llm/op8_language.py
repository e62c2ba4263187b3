"""Language identification by a linear-chain conditional random field over words.

Each word (a run of letters) has affix, character-bigram, whole-word and lexicon features,
hashed to BUCKETS; transitions between the languages of neighbouring words are learned.
Training is full-batch AdaGrad on the exact gradient (forward-backward) over a bounded
sample: SAMPLE labelled rows are cut into pieces of SEGMENT words, of which PIECES distinct
ones are kept (both documented parameters; expected numbers, drawn by hashes of texts). The
lexicon has all words of the sample that TYPICAL times out of TYPICAL + 1 stand in one
language, seen SEEN times at least. A text's prediction sums the marginals of all its words, computed
by forward-backward over the whole text, so code-switched passages count for their own
language; word_languages() returns the label of each word. Only the model goes to the
executors; texts are read in place, nothing is shuffled.

Defined cases: null text or a text without letters is `und` with score 0, likewise all
texts if no row teaches; ties go to the first language in alphabetical order; rows with
null lang or null text teach nothing; repeated rows are predicted alike; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bucket_of, materialize

SAMPLE, PIECES, BUCKETS, EPOCHS, SEGMENT, SEEN, TYPICAL, GROUP, CACHE = 1_500, 8_000, 1 << 16, 14, 128, 3, 4, 256, 400_000
#: Numbers that a regular expression takes for parts of words: superscripts, fractions, Roman numerals and so on.
NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
TOKEN, PRECISE = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_{re.escape(''.join(sorted(NUMBERS)))}]+")


def words_in(text: str) -> re.Pattern:
    """The expression of a text's words: that without such numbers is slow, and few texts hold any."""
    return TOKEN if text.isascii() or NUMBERS.isdisjoint(text) else PRECISE


def tokens(text: str) -> list[str]:
    return words_in(text).findall(text)


def features(word: str, lexicon: dict[str, list[int]]) -> list[int]:
    w = f"^{word}$"
    keys = [w, *(f"p{word[:n]}" for n in (1, 2, 3) if len(word) >= n), *(f"s{word[-n:]}" for n in (1, 2, 3) if len(word) >= n)]
    keys += [w[i : i + 2] for i in range(len(w) - 1)]
    return [BUCKETS] + [zlib.crc32(k.encode("utf-8", "replace")) % BUCKETS for k in keys] + [BUCKETS + 1 + i for i in lexicon.get(word, ())]


class Emissions:
    """Emission scores of words, remembered up to CACHE words."""

    def __init__(self, model: dict):
        self.w, self.lexicon = model["weights"], model["lexicon"]
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, self.w.shape[1]))

    def look(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of all words of all texts, and the table they number."""
        if len(self.at) > CACHE:
            self.at, self.rows = {}, self.rows[:0]
        at = self.at
        new = [w for w in {w for t in texts for w in t} if w not in at]
        if new:
            ids = [features(w, self.lexicon) for w in new]
            flat = np.concatenate([np.array(i) for i in ids])
            cuts = np.concatenate(([0], np.cumsum([len(i) for i in ids])[:-1]))
            for w in new:
                at[w] = len(at)
            score = np.add.reduceat(self.w[flat], cuts, axis=0)
            self.rows = np.concatenate([self.rows, np.exp(score - score.max(axis=1)[:, None])])
        return np.fromiter((at[w] for t in texts for w in t), np.int64, sum(map(len, texts))), self.rows


def forward_backward(emit: np.ndarray, length: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """emit [T, B, L], factors not logs; lengths fall along B -> marginals [T, B, L] (zero beyond a length) and scaled forward messages."""
    t_max, _, n = emit.shape
    live = [int((length > t).sum()) for t in range(t_max)]
    alpha = np.zeros_like(emit)
    a = emit[0] / emit[0].sum(axis=1)[:, None]
    alpha[0] = a
    for t in range(1, t_max):
        a = (a[: live[t]] @ trans) * emit[t, : live[t]]
        a /= a.sum(axis=1)[:, None]
        alpha[t, : live[t]] = a
    marg = np.zeros_like(emit)
    beta = np.ones((emit.shape[1], n))
    for t in range(t_max - 1, -1, -1):
        k = live[t]
        if t + 1 < t_max and live[t + 1]:
            m = live[t + 1]
            b = (emit[t + 1, :m] * beta[:m]) @ trans.T
            beta[:m] = b / b.sum(axis=1)[:, None]
        g = alpha[t, :k] * beta[:k]
        marg[t, :k] = g / g.sum(axis=1)[:, None]
    return marg, alpha


def _padded(rows: np.ndarray, starts: np.ndarray, length: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.ones((int(length[0]), len(length), table.shape[1]))
    for b, (s, n) in enumerate(zip(starts.tolist(), length.tolist(), strict=True)):
        out[:n, b] = table[rows[s : s + n]]
    return out


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS) -> dict:
    names = sorted(set(langs))
    n = len(names)
    words = [tokens(t.lower()) for t in texts]
    counts = {k: Counter() for k in names}
    for w, k in zip(words, langs, strict=True):
        counts[k].update(w)
    total = {k: max(1, c.total()) for k, c in counts.items()}
    share = {w: [counts[k][w] / total[k] for k in names] for k in names for w, m in counts[k].items() if m >= SEEN}
    lexicon = {w: [i for i, x in enumerate(r) if x > TYPICAL * (sum(r) - x) and counts[names[i]][w] >= SEEN] for w, r in share.items()}
    lexicon = {w: own for w, own in lexicon.items() if own}
    vocab = {w: i for i, w in enumerate(sorted({w for t in words for w in t}))}
    if not vocab or n == 0:
        return {"names": names if n else [], "weights": np.zeros((BUCKETS + 1 + n, max(n, 1))), "lexicon": {}, "trans": np.ones((max(n, 1), max(n, 1)))}
    ids = [features(w, lexicon) for w in vocab]
    size = np.array([len(i) for i in ids])
    flat = np.concatenate([np.array(i) for i in ids])
    cuts = np.concatenate(([0], np.cumsum(size)[:-1]))
    pieces, label = [], []
    for t, k in zip(words, langs, strict=True):
        for s in range(0, len(t), SEGMENT):
            pieces.append(np.array([vocab[w] for w in t[s : s + SEGMENT]]))
            label.append(names.index(k))
    order = np.argsort([-len(p) for p in pieces], kind="stable")
    pieces, label = [pieces[i] for i in order], np.array(label)[order]
    weights, trans = np.zeros((BUCKETS + 1 + n, n)), np.zeros((n, n))
    sum_w, sum_t, total = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6), sum(map(len, pieces))
    for _ in range(epochs):
        score = np.add.reduceat(weights[flat], cuts, axis=0)
        table = np.exp(score - score.max(axis=1)[:, None])
        factor = np.exp(trans - trans.max())
        grad_v, grad_t = np.zeros((len(vocab), n)), np.zeros((n, n))
        for g in range(0, len(pieces), 1024):
            part, own = pieces[g : g + 1024], label[g : g + 1024]
            length = np.array([len(p) for p in part])
            rows = np.concatenate(part)
            starts = np.concatenate(([0], np.cumsum(length)[:-1]))
            emit = _padded(rows, starts, length, table)
            marg, alpha = forward_backward(emit, length, factor)
            at = np.concatenate([marg[:m, b] for b, m in enumerate(length.tolist())])
            seen = np.repeat(own, length)
            for k in range(n):
                grad_v[:, k] += np.bincount(rows, (seen == k) - at[:, k], minlength=len(vocab))
            for t in range(1, emit.shape[0]):
                m = int((length > t).sum())
                # pairwise marginals: alpha[t-1] * trans * (what follows), the latter from the marginal at t
                ahead = alpha[t - 1, :m] @ factor
                pair = alpha[t - 1, :m].T @ (marg[t, :m] / np.maximum(ahead, 1e-300))
                grad_t -= pair * factor
                grad_t[np.arange(n), np.arange(n)] += np.bincount(own[:m], minlength=n)
        grad = np.zeros_like(weights)
        spread = np.repeat(np.arange(len(vocab)), size)
        for k in range(n):
            grad[:, k] = np.bincount(flat, grad_v[spread, k], minlength=len(grad))
        grad, grad_t = grad / total - 1e-6 * weights, grad_t / total - 1e-3 * trans
        sum_w += grad**2
        sum_t += grad_t**2
        weights += 0.3 * grad / np.sqrt(sum_w)
        trans += 0.5 * grad_t / np.sqrt(sum_t)
    return {"names": names, "weights": weights, "lexicon": lexicon, "trans": np.exp(trans - trans.max())}


def predict(texts: list[str | None], model: dict, emissions: Emissions) -> tuple[list[str], list[float]]:
    names = model["names"]
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    if not names:
        return lang, score
    words = [tokens(t.lower()) if t else [] for t in texts]
    order = sorted((i for i, w in enumerate(words) if w), key=lambda i: -len(words[i]))
    at = 0
    while at < len(order):
        size = max(1, min(GROUP, 2_000_000 // len(words[order[at]])))
        own = order[at : at + size]
        at += size
        length = np.array([len(words[i]) for i in own])
        rows, table = emissions.look([words[i] for i in own])
        marg, _ = forward_backward(_padded(rows, np.concatenate(([0], np.cumsum(length)[:-1])), length, table), length, model["trans"])
        share = marg.sum(axis=0) / length[:, None]
        top = share.argmax(axis=1)
        for i, k, s in zip(own, top.tolist(), share.max(axis=1).tolist(), strict=True):
            lang[i], score[i] = names[k], min(1.0, max(0.0, s))
    return lang, score


def label_words(text: str | None, model: dict, emissions: Emissions | None = None) -> list[tuple[int, int, str, float]]:
    """(start, end, language, probability) of every word of a text, positions in the text as it is."""
    found = list(words_in(text or "").finditer(text or ""))
    if not found or not model["names"]:
        return []
    emissions = emissions or Emissions(model)
    rows, table = emissions.look([[m[0].lower() for m in found]])
    marg = forward_backward(table[rows][:, None], np.array([len(found)]), model["trans"])[0][:, 0]
    return [(m.start(), m.end(), model["names"][k], float(p[k])) for m, k, p in zip(found, marg.argmax(axis=1).tolist(), marg, strict=True)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (text, lang) in pieces of SEGMENT words."""
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = tokens(text.lower())
            parts = [" ".join(w[k : k + SEGMENT]) for k in range(0, len(w), SEGMENT)]
            yield pa.record_batch([pa.array(parts, pa.string()), pa.array([lang] * len(parts), pa.string())], names=["text", "lang"])


def learn(docs: DataFrame, known: Column, sample: int = SAMPLE, pieces: int = PIECES) -> dict:
    """known: a condition of the rows to learn from. sample, pieces: expected numbers of rows, and of their pieces, at most."""
    rows = docs.where(known).where("lang is not null and text is not null and doc_id is not null").select(F.xxhash64(F.lit(8), "text", "doc_id").alias("h"), "text", F.col("lang").cast("string").alias("lang"))

    def share(most: int, n: int) -> int:
        return int(min(1.0, most / max(1, n)) * 1_000_000)

    part = share(sample, docs.where(known).where("lang is not null and text is not null and doc_id is not null").count())
    cut = rows.where(F.pmod("h", F.lit(1_000_000)) < part).select("text", "lang").mapInArrow(_pieces, "text string, lang string").distinct()
    cut = materialize(cut, "language-sample")
    got = cut.where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1_000_000)) < share(pieces, cut.count())).orderBy("lang", "text").collect()
    return train([r.text for r in got], [r.lang for r in got])


def word_languages(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and words (start, end, lang, score), the label of each word of a text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("score", pa.float64())]))
        for b in batches:
            for k in range(b.num_rows):
                words = [dict(zip(("start", "end", "lang", "score"), w, strict=True)) for w in label_words(b.column(1)[k].as_py(), shared.value, emissions)]
                yield pa.record_batch([b.column(0).slice(k, 1), pa.array([words], kind)], names=["doc_id", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, words array<struct<start: int, end: int, lang: string, score: double>>")


def language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows outside the quarter that is held out."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, bucket_of(F.col("doc_id"), 4) != 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(model.value)
        for b in batches:
            for k in range(0, b.num_rows, 2_000):
                part = b.slice(k, 2_000)
                lang, score = predict(part.column(2).to_pylist(), model.value, emissions)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
