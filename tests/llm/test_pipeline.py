"""The pipeline, stage by stage against brute force on odd rows, and as a whole on the smallest tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from test_texts import SECRETS, WORD, fill, plain_matches, redacted, simhash

import corpus_pipeline as C
from tessera.llm import op1_packing, op2_toxicity
from tessera.llm.common import bucket_of, release

SF = "/root/testdata/sf0.001"
CLASH = "_was_null string, _simhash_text string, _row string, _text string, _kinds string, _key string, copies string, rank string"


def flat(rows):
    return Counter(tuple(map(str, r)) for r in rows)


def groups(prints):
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}
    for _ in distinct:
        for a in distinct:
            for b in distinct:
                if (a ^ b).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_stages_against_brute_force(spark, rows, tmp_path):
    """Each stage on what its predecessor kept: nulls, copies, near copies, repeated rows, a long text, clashing names."""
    odd = [(*r[:5], *["c"] * 8) for r in rows] + [(400 + i, t, "en", "bc"[i % 2], 7, *["c"] * 8) for i, t in enumerate(SECRETS)]
    odd += [(500 + i, f"{rows[i % 60][1]} mistkerl{'' if i % 2 else ' grobian'}", "de", "a", 3, *["c"] * 8) for i in range(40)]
    docs = spark.createDataFrame(odd, f"doc_id long, text string, lang string, source string, n_chars int, {CLASH}").repartition(3)
    labels = spark.createDataFrame([(r[0], int(500 <= (r[0] or 0) < 540), 1) for r in odd if r[0] is not None], "doc_id long, toxic int, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    model = op2_toxicity.learn(docs, labels, bucket_of(F.col("doc_id"), 3) != 1)
    matcher = op2_toxicity.Matcher(model)
    assert model["terms"]

    def toxic(text):
        total, (a, b, c) = sum(m[2] for m in plain_matches(text or "", model)), model["logit"]
        x, y = np.log1p(total), np.log1p(100 * total / (len((text or "").split()) + 20))
        assert abs(matcher.score(text or "") - 1 / (1 + np.exp(-np.clip(a + b * x + c * y, -40, 40)))) < 1e-9
        return matcher.score(text or "") >= 0.7

    stage = dict(C.STAGES)
    kept = stage["toxicity"](spark, docs, str(tmp_path)).cache()
    assert kept.columns == docs.columns
    want = [r for r in odd if not toxic(r[1])]
    assert flat(kept.collect()) == flat(want) and 0 < len(odd) - len(want) <= 45

    once = stage["simhash"](spark, kept, str(tmp_path)).cache()
    root = groups([simhash(r[1] or "") for r in want])
    per = defaultdict(list)
    for r in want:
        per[root[simhash(r[1] or "")]].append(r)
    got = once.collect()
    assert once.columns == docs.columns and len(got) == len(per) and not flat(got) - flat(want)
    for r in got:
        ids = [x[0] for x in per[root[simhash(r.text or "")]] if x[0] is not None]
        assert r.doc_id == (min(ids) if ids else None)

    clean = stage["secrets"](spark, once, str(tmp_path)).cache()
    assert clean.columns == docs.columns
    assert Counter((str(r.doc_id), r.text, tuple(r[5:])) for r in clean.collect()) == Counter((str(r.doc_id), None if r.text is None else redacted(r.text), tuple(r[5:])) for r in got)

    mix = stage["mixing"](spark, clean, str(tmp_path)).cache()
    before, after = clean.collect(), mix.collect()
    assert mix.columns == docs.columns and all(n <= 2 * flat(before)[r] for r, n in flat(after).items())
    size = lambda part: {s: sum(len(WORD.findall(r.text or "")) for r in part if r.source == s) for s in {r.source for r in before}}
    order = sorted(s for s in size(before) if s is not None) + ([None] if None in size(before) else [])
    target = fill(size(before), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for s, n in size(after).items():
        assert abs(n - target[s]) <= max(0.02 * target[s], max(len(WORD.findall(r.text or "")) for r in before if r.source == s))

    pieces = defaultdict(list)
    for p in stage["packing"](spark, mix, str(tmp_path)).collect():
        pieces[str(p.doc_id)].append(p)
    exact = op1_packing.tokenizer("byte_bpe_50k")[0]
    ids = defaultdict(list)
    for r in after:
        ids[str(r.doc_id)].append([*exact.encode(r.text or "", add_special_tokens=False).ids, 0])
    assert set(pieces) == set(ids)
    for doc, texts in ids.items():
        assert sum(p.length for p in pieces[doc]) == sum(map(len, texts))
        for p in pieces[doc]:
            assert any(len(t) == p.doc_tokens and zlib.crc32(np.array(t[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for t in texts)
    release()


def test_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash", "secrets", "mixing", "packing"]
    step = docs
    for _, stage in C.STAGES[:-1]:
        step = stage(spark, step, SF).cache()
        assert step.columns == docs.columns and step.count() > 0
    assert C.run(spark, SF).where("start = 0").count() == step.count()
    release()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
