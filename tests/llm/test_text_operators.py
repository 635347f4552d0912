"""Toxicity, byte-level BPE, LM scoring, SimHash and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from tabplan.llm import byte_bpe, lm_scoring, simhash, toxicity
from tabplan.llm.graph import connected_components

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [None, "", " \t\n", "one", "one two", "a  b\r\n\r\nc 's it's 12,5 é\u0085ü \x1c  \U0001f600", "x" * 5000, "word " * 9000, "ABC abc Äß <|endoftext|>"]


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def clashing(df):
    """The same rows with columns named as the operators' own."""
    return df.selectExpr("*", "'x' AS id", "1 AS fp", "2 AS ids", "3 AS SCORE", "4 AS component_id", "5 AS size", "6 AS grp")


def brute_components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- components


def test_components_of_random_graphs(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randrange(100, 300), rnd.randrange(100, 300)) for _ in range(120)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 4), (4, None)], "a long, b long"), "a", "b").collect()}
    proper = [e for e in edges if e[0] != e[1]]
    want = brute_components(proper, {x for e in proper for x in e})
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---- byte-level BPE


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe(byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference_coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_on_random_texts(coder, reference_coder):
    rnd = random.Random(1)
    alphabet = [chr(i) for i in range(0x180)] + list("   　﻿中あ²٠​  '''sstlr") + ["'re", "\r\n", "  ", "the", " and"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30))) for _ in range(2000)] + [t for t in HARD if t]
    for text, ids in zip(texts, coder.encode_all(texts), strict=True):
        assert ids.tolist() == reference_coder.encode_ordinary(text), repr(text)
        assert coder.decode(ids.tolist()) == text.encode()


def test_bpe_caches_stay_bounded(coder, reference_coder, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    for k in range(5):
        texts = [" ".join(f"w{k}{i}x{j}" for j in range(20)) for i in range(8)]
        assert [x.tolist() for x in coder.encode_all(texts)] == [reference_coder.encode_ordinary(t) for t in texts]
    assert len(coder._words) <= 50 + 160


def test_bpe_frames(spark, coder, reference_coder):
    texts = [*HARD, HARD[5], HARD[5]]
    encoded = byte_bpe.encode_documents(clashing(docs_of(spark, texts)).withColumnRenamed("id", "other"), coder)
    rows = byte_bpe.decode_documents(encoded, coder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == reference_coder.encode_ordinary(texts[r.id] or "") and bytes(r.decoded) == (texts[r.id] or "").encode()
    at_once = byte_bpe.encode_documents(docs_of(spark, texts), coder, decoded=True).collect()
    assert sorted((r.id, r.ids, bytes(r.decoded)) for r in at_once) == sorted((r.id, r.ids, bytes(r.decoded)) for r in rows)
    assert byte_bpe.encode_documents(docs_of(spark, []), coder, decoded=True).count() == 0
    null_id = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert byte_bpe.encode_documents(null_id, coder).collect()[0].id is None


# ---- SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_fingerprints(monkeypatch):
    rnd = random.Random(5)
    texts = [*HARD, *(" ".join(rnd.choice(["a", "B", "ç", "dd."]) for _ in range(n)) for n in range(40))]
    for chunk in (1 << 16, 3):
        monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", chunk)
        for t in texts:
            assert simhash.fingerprint(t) % (1 << 64) == plain_fingerprint(t)


def test_blocks_cover_all_close_pairs():
    rnd = random.Random(9)
    assert [simhash.block_count(n) for n in (1, 10_000, 200_000, 10**8, 10**11)] == sorted(simhash.block_count(n) for n in (1, 10_000, 200_000, 10**8, 10**11))
    for blocks in (4, 5, 6, 9):
        masks = simhash.block_masks(blocks)
        assert len(masks) == math.comb(blocks, 3)
        for _ in range(200):
            a = rnd.getrandbits(64)
            b = a
            for bit in rnd.sample(range(64), 3):
                b ^= 1 << bit
            assert any(a & (m % (1 << 64)) == b & (m % (1 << 64)) for m in masks)


def test_simhash_components(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choices(words, k=400)) for _ in range(6)]
    texts = [*HARD, *base, *base[:3]]
    for b in base:
        for _ in range(4):
            w = b.split()
            w[rnd.randrange(400)] = "changed"
            texts.append(" ".join(w))
    df = clashing(docs_of(spark, texts)).drop("id")
    got = simhash.simhash_components(df).collect()
    prints = [plain_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert len(links) > 5
    assert {r.id: r.component_id for r in got} == brute_components(links, range(len(texts))) and len(got) == len(texts)
    kept = simhash.keep_one_each(df)
    assert {r.doc_id for r in kept.collect()} == set(brute_components(links, range(len(texts))).values()) and kept.columns == df.columns
    assert simhash.simhash_components(docs_of(spark, [])).count() == 0
    unnamed = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "zz")], "doc_id long, text string")
    assert sorted(map(str, simhash.simhash_components(unnamed).select("id", "component_id").collect())) == sorted(["Row(id=None, component_id=3)", "Row(id=3, component_id=3)", "Row(id=3, component_id=3)", "Row(id=None, component_id=None)"])
    # one row of each group stays, also of copies that share an id or have none
    assert sorted(map(str, simhash.keep_one_each(unnamed).collect())) == sorted(["Row(doc_id=3, text='a b c d')", "Row(doc_id=None, text='zz')"])


def test_unlike_texts_of_one_id_are_kept_each_for_itself(spark):
    rows = [(1, "a b c d"), (5, "A b c d"), (5, "wholly other words"), (5, None), (0, ""), (6, "wholly other words")]
    kept = simhash.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == [(0, ""), (1, "a b c d"), (5, "wholly other words")]


def test_one_row_of_each_group_stays(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rnd.choices(words, k=60)) for _ in range(5)]
    rows = [(rnd.choice([None, *range(12)]), rnd.choice([None, "", *base, *(b + " more" for b in base)]), [k]) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more array<int>")
    got = simhash.keep_one_each(df).collect()
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    of = brute_components([(i, j) for i in range(150) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3], range(150))
    kept = Counter(of[r.more[0]] for r in got)
    assert set(kept) == set(of.values()) and set(kept.values()) == {1}
    for r in got:
        ids = [rows[k][0] for k in of if of[k] == of[r.more[0]]]
        assert r.doc_id == min((i for i in ids if i is not None), default=None) and tuple(r) == rows[r.more[0]]


# ---- toxicity


def toy_corpus(n, seed):
    rnd = random.Random(seed)
    clean = [f"word{i}" for i in range(400)]
    texts, toxic = [], []
    for i in range(n):
        w = rnd.choices(clean, k=rnd.randrange(5, 80))
        bad = i % 8 == 0
        if bad:
            for _ in range(1 + len(w) // 30):
                w.insert(rnd.randrange(len(w)), rnd.choice(["Vilest,", "vileness", "nastyone", "nasty."]))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity_on_held_out_rows(spark):
    texts, toxic = toy_corpus(900, 4)
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score_texts(clashing(docs), model).withColumn("held", toxicity.held_out()).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(rows) == 900
    right = sum((r.score >= 0.5) == bool(toxic[r.doc_id]) for r in held) / len(held)
    assert right > 0.95 and all(0 <= r.score <= 1 for r in rows)
    # the labels of held-out rows teach nothing
    other = spark.createDataFrame([(i, 1, t if zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    assert np.array_equal(toxicity.train(docs, other).weights, model.weights)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in rows)


def test_toxicity_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs_of(spark, HARD), empty)
    rows = toxicity.score_texts(docs_of(spark, HARD), model).collect()
    assert len(rows) == len(HARD) and all(r.score < 0.5 for r in rows)
    assert toxicity.score_texts(docs_of(spark, []), model).count() == 0
    clash = docs_of(spark, HARD).selectExpr("doc_id", "text AS score")
    assert toxicity.score_texts(clash, model, text_col="score").columns == ["doc_id", "score"]


def test_all_labels_toxic(spark):
    labels = spark.createDataFrame([(i, 1, 1) for i in range(len(HARD))], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, HARD)
    assert all(r.score > 0.5 for r in toxicity.score_texts(docs, toxicity.train(docs, labels)).collect())


@pytest.mark.parametrize("shift", [-3.0, 0.0, 4.0])
def test_risk_and_its_gradient(shift):
    rnd = np.random.default_rng(3)
    zp, zu, prior = rnd.normal(shift, 2, 7), rnd.normal(-1, 2, 11), 0.3

    def plain(zp, zu):
        """The two risks by the loss's definition, a row at a time."""
        loss = lambda z, y: math.log(1 + math.exp(-y * z))
        return prior * sum(loss(z, 1) for z in zp) / len(zp), sum(loss(z, -1) for z in zu) / len(zu) - prior * sum(loss(z, -1) for z in zp) / len(zp)

    positive, negative, dp, du = toxicity.pu_risk(zp, zu, prior)
    assert (positive, negative) == pytest.approx(plain(zp, zu))
    goes_down = (lambda p, u: sum(plain(p, u))) if negative >= 0 else (lambda p, u: -plain(p, u)[1])
    for side, d in ((0, dp), (1, du)):
        for k in range(len((zp, zu)[side])):
            ends = []
            for step in (1e-5, -1e-5):
                moved = [zp.copy(), zu.copy()]
                moved[side][k] += step
                ends.append(goes_down(*moved))
            assert d[k] / len(d) == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-7)
    assert (negative < 0) == (shift == 4.0)


def test_no_text_is_in_two_parts():
    rows = [(np.array([k % 9]), np.array([1.0], np.float32)) for k in range(40)]
    in_p, in_u, n = toxicity.parts(rows[:12], rows[5:])
    of = {}
    for (i, _), at in zip(rows[:12] + rows[5:], [*in_p, *in_u], strict=True):
        assert of.setdefault(int(i[0]), at) == at
    assert n == 5 and set(in_p) == set(in_u) == set(range(5))
    assert toxicity.fit_nnpu(rows[:1], rows, 0.5).score("a") < 0.5 and toxicity.fit_nnpu(rows[:3], rows[:1], 0.5).score("a") < 0.5


def test_nnpu_needs_no_negative_labels():
    rnd = np.random.default_rng(0)
    rows = [([int(c) * 7 + 1, int(rnd.integers(100, 200))], [1.0, 0.3]) for c in rnd.integers(0, 2, 600)]
    rows = [(np.array(i), np.array(v, np.float32)) for i, v in rows]
    positive = [r for r in rows[:300] if r[0][0] == 8]
    model = toxicity.fit_nnpu(positive, rows[300:], 0.5)
    assert model.weights[8] > 0 > model.weights[1]


# ---- LM scoring


def plain_losses(texts, ids):
    """The smoothed bigram losses by dictionaries."""
    grams = Counter(tuple(divmod(int(c), ids.size)) for t in texts for c in ids.cells(t))
    uni, left = Counter(), Counter()
    for (a, b), n in grams.items():
        uni[b] += n
        left[a] += n
    total = sum(uni.values()) + 0.5 * ids.size
    return lambda a, b: -math.log((grams[a, b] + 20 * (uni[b] + 0.5) / total) / (left[a] + 20))


def test_cross_entropy_difference(spark):
    rnd = random.Random(8)
    texts = [*HARD, *(" ".join(rnd.choices(["The", "cat,", "sat", "on", f"x{i}"], k=1 + i % 17)) for i in range(60))]
    target = ["the cat sat", "the cat sat on the mat", None, ""]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = lm_scoring.cross_entropy_difference(clashing(docs_of(spark, texts)).drop("id"), frame, size=6).collect()
    words = Counter(w.decode() for t in texts for w in lm_scoring.tokens(t)), Counter(w.decode() for t in target for w in lm_scoring.tokens(t))
    share = {w: max(words[0][w] / words[0].total(), (words[1][w] if words[1][w] > 1 else 0) / words[1].total()) for w in words[0] | words[1]}
    ids = lm_scoring.Ids(sorted(share, key=lambda w: (-share[w], w))[:6])
    of_target, of_all = plain_losses(target, ids), plain_losses(texts, ids)
    assert len(got) == len(texts)
    for r in got:
        cells = [divmod(int(c), ids.size) for c in ids.cells(texts[r.id])]
        assert r.n_tokens == len(cells)
        if cells:
            t, b = (sum(f(*c) for c in cells) / len(cells) for f in (of_target, of_all))
            assert r.ce_target == pytest.approx(t, abs=1e-5) and r.ce_background == pytest.approx(b, abs=1e-5) and r.score == pytest.approx(t - b, abs=1e-5)
        else:
            assert r.score is None
    assert lm_scoring.cross_entropy_difference(docs_of(spark, []), frame).count() == 0


@pytest.mark.parametrize("chunk", [50, 2_000_000])
def test_cross_entropy_tells_all_words_apart(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm_scoring, "CHUNK", chunk)
    rnd = random.Random(9)
    rare = [f"w{i}" for i in range(2_400)]
    texts = [*HARD, *(" ".join(rare[i : i + 30]) for i in range(0, 2_400, 30)), *(" ".join(rnd.choices(rare, k=40)) for _ in range(40)), "w7 w8", "w7 w9"]
    target = ["w7 w8 w7 w8", "only here", None]
    docs, frame = docs_of(spark, texts), spark.createDataFrame([(t,) for t in target], "text string")
    ids = lm_scoring.Ids(sorted({w.decode() for t in [*texts, *target] for w in lm_scoring.tokens(t)}))
    assert ids.size > 2_400
    got = {r.id: r for r in lm_scoring.cross_entropy_difference(docs.unionByName(docs.limit(0)), frame).collect()}
    of_target, of_all = plain_losses(target, ids), plain_losses(texts, ids)
    assert sorted(got) == list(range(len(texts)))
    for i, text in enumerate(texts):
        cells = [divmod(int(c), ids.size) for c in ids.cells(text)]
        assert got[i].n_tokens == len(cells)
        if cells:
            t, b = (sum(f(*c) for c in cells) / len(cells) for f in (of_target, of_all))
            assert got[i].ce_target == pytest.approx(t, abs=1e-9) and got[i].ce_background == pytest.approx(b, abs=1e-9) and got[i].score == pytest.approx(t - b, abs=1e-9)
        else:
            assert got[i].score is got[i].ce_target is None
    assert got[len(texts) - 2].score < got[len(texts) - 1].score


# ---- the pipeline


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_stages(spark, reference_coder):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400).cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = p.toxicity(spark, docs, SF).cache()
    assert clean.columns == docs.columns and clean.count() > 300
    single = p.simhash_dedup(spark, clean, SF).cache()
    left = {r.doc_id: plain_fingerprint(r.text) for r in clean.collect()}
    links = [(a, b) for a in left for b in left if a < b and (left[a] ^ left[b]).bit_count() <= 3]
    assert {r.doc_id for r in single.collect()} == set(brute_components(links, left).values())
    mixed = p.mixing(spark, single, SF).cache()
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    out = p.byte_bpe(spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect())
    for r in out[:80]:
        assert r.n_tokens == len(reference_coder.encode_ordinary(texts[r.doc_id])) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
