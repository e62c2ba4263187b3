"""Packing: order-preserving dynamic programming over window cuts.

Documents are read in the order of their input partitions and tokenised whole; each
partition is a stream of tokens with candidate cuts: ends of documents (free), ends of
sentences (a small truncation penalty) and, inside long sentences, every HARD tokens (a
larger one). A sequence is a window between two cuts of at most `limit` tokens. With S the
tokens before a cut,

    cost[j] = penalty[j] + sequence_cost + min over i, S[j]-S[i] <= limit, of cost[i] + limit - (S[j]-S[i])

and as limit - S[j] is constant in i, the minimum of cost[i] + S[i] over a sliding window
is kept in a monotone queue: each cut enters and leaves it once. Windows of exactly a power
of two need no padding; those are looked up beside the queue.

A partition holds at most `block` tokens of the stream at a time: a block's last windows
are carried to the next block, so memory does not grow with the partition. Nothing is
shuffled. Rows stay in their partition, so a lost executor repeats its own partitions only.

Defined cases: null text is an empty text, which is the single id 0; repeated rows and
repeated or null doc_ids are documents of their own, each packed once; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, SENTENCE, CUT, EACH, HARD, BLOCK = 1024, 4, 16, 12, 24, 1 << 19
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Characters whose classes all Unicode versions in use agree on; other texts go to the slower tokenizer.
PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏΑ-ΡΣ-ωА-я‘-”…]")

_loaded: dict[str, tuple] = {}
_added: dict[str, tuple[str, ...]] = {}


def tokenizer(vocabulary: str):
    """texts -> lists of ids of the byte-level vocabulary <vocabulary>.json; the rank file beside it, same ids, is faster on plain texts that hold no added token."""
    if vocabulary not in _loaded:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        added = {i: t.content for i, t in exact.get_added_tokens_decoder().items()}
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        ends = np.zeros(max([*ranks.values(), *added]) + 1, bool)
        ends[[i for b, i in ranks.items() if b[-1:] in b".!?\n"]] = True
        _loaded[vocabulary] = exact, fast, ends
        _added[vocabulary] = tuple(added.values())
    return _loaded[vocabulary]


def encode(text: str, vocabulary: str) -> np.ndarray:
    exact, fast, _ = tokenizer(vocabulary)
    if PLAIN.search(text) or any(t in text for t in _added[vocabulary]) or len(text) > 2000 and max(map(len, text.split(" "))) > 2000:
        return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
    return np.array(fast.encode_ordinary(text), dtype="<u4")


def candidates(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts after so many ids of one document, its end included, and their penalties."""
    n = len(ids)
    stops = np.flatnonzero(ends[ids[:-1]]) + 1
    stops = stops[stops < n]
    near = np.concatenate(([0], stops, [n]))
    gaps = np.diff(near)
    inner = []
    for at, gap in zip(near[:-1][gaps > HARD], gaps[gaps > HARD], strict=True):
        inner.append(np.arange(at + HARD, at + gap, HARD))
    cuts = np.concatenate([stops, *inner]).astype(np.int64)
    cost = np.full(len(cuts), CUT)
    cost[: len(stops)] = SENTENCE
    order = np.argsort(cuts, kind="stable")
    return np.append(cuts[order], n), np.append(cost[order], 0)


def windows(at: list[int], penalty: list[int], limit: int = LIMIT, each: int = EACH) -> list[int]:
    """Indexes of the chosen cuts. at: tokens before each cut, ascending, from 0, steps of at most limit."""
    n, powers = len(at), [1 << k for k in range(5, 20) if 1 << k < limit]
    cost, back, queue = [0] * n, [0] * n, deque([(0, 0)])
    where = {0: 0}
    for j in range(1, n):
        s = at[j]
        low = s - limit
        while at[queue[0][1]] < low:
            queue.popleft()
        best, i = queue[0]
        best += limit - s
        for p in powers:
            k = where.get(s - p)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        best += penalty[j] + each
        cost[j], back[j] = best, i
        where[s] = j
        key = best + s
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], n - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def _pack(batches: Iterator[pa.RecordBatch], vocabulary: str, limit: int, block: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    ends = tokenizer(vocabulary)[2]
    base = TaskContext.get().partitionId() << 36
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    held: list[tuple] = []  # (doc_id, ids not yet packed, ids packed before them, all ids)
    size = sequence = 0

    def flush(last: bool):
        nonlocal held, size, sequence
        at, penalty, total = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
        for _, ids, _, _ in held:
            cuts, cost = candidates(ids, ends)
            at.append(cuts + total)
            penalty.append(cost)
            total += len(ids)
        cuts, cost = np.concatenate(at), np.concatenate(penalty)
        chosen = windows(cuts.tolist(), cost.tolist(), limit)
        if not last and len(chosen) > 8:
            chosen = chosen[:-8]  # the tail of a block is packed anew with what follows
        rows, rest, begin, d, used = [], [], 0, 0, 0
        for j in chosen:
            end, offset = int(cuts[j]), 0
            while begin + offset < end:
                doc, ids, before, of = held[d]
                take = min(len(ids) - used, end - begin - offset)
                piece = ids[used : used + take]
                rows.append((doc, before + used, take, zlib.crc32(piece.tobytes()), of, base + sequence, offset))
                offset += take
                used += take
                if used == len(ids):
                    d, used = d + 1, 0
            begin, sequence = end, sequence + 1
        for k in range(d, len(held)):
            doc, ids, before, of = held[k]
            skip = used if k == d else 0
            rest.append((doc, ids[skip:], before + skip, of))
        held, size = rest, total - begin
        if rows:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=list(names))

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.append(encode(text or "", vocabulary), np.zeros(1, "<u4")).astype("<u4")
            held.append((doc, ids, 0, len(ids)))
            size += len(ids)
            if size >= block and (out := flush(False)):
                yield out
    if held and (out := flush(True)):
        yield out


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k", limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """A row per piece: SCHEMA. vocabulary: the public vocabulary's name. block: tokens planned at once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _pack(it, vocabulary, limit, block), SCHEMA)
