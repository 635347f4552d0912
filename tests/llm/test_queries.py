"""Every opN_ query and the pipeline over small tables with odd rows: each column of their contracts by brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tabplan.llm import lm_scoring, queries, sharding, tiff

from .test_table_operators import brute_links, filled
from .test_text_operators import brute_components, plain_fingerprint, plain_losses, reference_coder  # noqa: F401

RND = random.Random(11)
WORDS = [f"w{i}" for i in range(60)]
BASE = [" ".join(RND.choices(WORDS, k=90)) for _ in range(6)]
TEXTS = [None, "", " \t\n", "one", "a  B\r\nç 'tis", "é" * 70, "x" * 64, "long " * 30_000, *BASE, *BASE[:3], *(b + " end" for b in BASE), *(" ".join(RND.choices(WORDS, k=RND.randrange(1, 50))) for _ in range(60)), *["copied all over"] * 9]
DOCS = [(i, t, RND.choice(["en", None]), RND.choice(["a", "b", "É", "", None]), RND.choice([None, 3])) for i, t in enumerate(TEXTS)]
LABELS = [(i, RND.choice([0, 1, None]), int("w7" in (t or "").split())) for i, t in enumerate(TEXTS)] + [(None, 1, 1), (3, 0, None), (4, 0, 0), (4, 0, 0)]
VECTORS = [(i, [float(np.float32(x)) for x in (np.eye(8)[i % 3] + np.array([RND.gauss(0, s) for _ in range(8)]))], i % 2) for i, s in enumerate([0.0, 0.03, 0.07, 0.3] * 15)]
VECTORS += [(100, None, 1), (101, [0.0] * 8, 1), (102, [1.0, None], 1), (103, [float("nan")] * 8, 1), (104, VECTORS[0][1], None), (105, VECTORS[0][1], VECTORS[0][2]), (106, [], 0)]
PAGES = [(i, f"http://h/{i}" if i % 4 else None, h) for i, h in enumerate([None, "", "<p>a</p>", "<p>a</p>", "é" * 30, "", "z" * 200_000, "WARC/1.1\r\n\r\n", "<p>a</p>"])]
BENCHMARK = [(i, t) for i, t in enumerate(["w1 w2 w3", "w1 w2", None, "", "only here"])]
TURNS = [(c, t, r, x) for c in range(6) for t, (r, x) in enumerate([("system", "s"), ("user", None), ("assistant", "<|im_end|>a&b<\\|"), ("human", "h" * 9000), ("assistant", "é\n"), (None, "n")][: c + 1])] + [(3, 0, "system", "s"), (3, 0, "system", "s")]
EXTRA = ["'x' AS id", "1 AS Size", "2 AS shard", "3 AS SCORE", "'k' AS `key`", "4 AS grp", "5 AS media", "6 AS n", "7 AS node", "8 AS h", "9 AS fp", "'d' AS digest"]
TABLES = {
    "documents": (DOCS, "doc_id long, text string, lang string, source string, n_chars long"), "labels": (LABELS, "doc_id long, quality int, toxic int"), "embeddings": (VECTORS, "vec_id long, embedding array<float>, label int"),
    "pages": (PAGES, "page_id long, url string, html string"), "benchmark": (BENCHMARK, "item_id long, text string"), "conversations": (TURNS, "conv_id long, turn long, role string, text string"),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables with columns that clash with the operators' own, in several files."""
    out = tmp_path_factory.mktemp("tables")
    for name, (rows, schema) in TABLES.items():
        spark.createDataFrame(rows, schema).selectExpr("*", *EXTRA).repartition(3).write.parquet(f"{out}/{name}.parquet")
    return str(out)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for name, (_, schema) in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{out}/{name}.parquet")
    return str(out)


def run(spark, folder, name):
    return queries.queries()[name](spark, folder)


def by_id(df, key="doc_id", n=len(DOCS)):
    rows = df.collect()
    assert len(rows) == n and len({r[key] for r in rows}) == n
    return {r[key]: r for r in rows}


def raw(i):
    return (TEXTS[i] or "").encode()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty, name):
    assert run(spark, empty, name).count() == (1 if name == "op9_chat" else 0)


def test_op1(spark, folder):
    got = by_id(run(spark, folder, "op1_toxicity"))
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert len({r.score for i, r in got.items() if TEXTS[i] == "copied all over"}) == 1


def test_op2(spark, folder, reference_coder):  # noqa: F811
    for i, r in by_id(run(spark, folder, "op2_byte_bpe")).items():
        ids = reference_coder.encode_ordinary(TEXTS[i] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw(i)).hexdigest())


def test_op3(spark, folder):
    target = [t for _, t in BENCHMARK]
    ids = lm_scoring.Ids(sorted({w.decode() for t in [*TEXTS, *target] for w in lm_scoring.tokens(t)}))
    of_target, of_all = plain_losses(target, ids), plain_losses(TEXTS, ids)
    for i, r in by_id(run(spark, folder, "op3_cross_entropy")).items():
        cells = [divmod(int(c), ids.size) for c in ids.cells(TEXTS[i])]
        assert r.n_tokens == len(cells)
        if cells:
            assert r.score == pytest.approx(sum(of_target(*c) - of_all(*c) for c in cells) / len(cells), abs=1e-9)
        else:
            assert r.score is None


def test_op4(spark, folder):
    for i, r in by_id(run(spark, folder, "op4_tiff")).items():
        payload = raw(i) + bytes(-len(raw(i)) % 64 or (0 if raw(i) else 64))
        media = tiff.write_tiff([np.frombuffer(payload, np.uint8).reshape(-1, 64)])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw(i)), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        shape, mean = r.feature.split(" mean=")
        assert shape == f"64x{len(payload) // 64}x1 deflate/2" and re.fullmatch(r"\d+\.\d{4}", mean) and float(mean) == pytest.approx(sum(payload) / len(payload), abs=5.1e-5)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_op5(spark, folder):
    got = by_id(run(spark, folder, "op5_mixing"))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for i, t, _, source, _ in DOCS:
        sizes[source] += len(words(t))
        largest[source] = max(largest[source], len(words(t)))
        taken[source] += got[i].taken
    want = filled(sizes)
    for i, t, _, source, _ in DOCS:
        r, n = got[i], len(words(t))
        assert (r["size"], r.source_size) == (n, sizes[source]) and r.target == pytest.approx(want[source]) and r.taken in (0, n, 2 * n)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in want)
    assert {i: r.taken for i, r in by_id(run(spark, folder, "op5_mixing")).items()} == {i: r.taken for i, r in got.items()}


def test_op6(spark, folder):
    links = brute_links(VECTORS)
    of, degree = brute_components([(VECTORS[i][0], VECTORS[j][0]) for i, j in links], [v[0] for v in VECTORS]), Counter(VECTORS[k][0] for link in links for k in link)
    assert len(links) > 100
    for i, r in by_id(run(spark, folder, "op6_embedding_dedup"), "vec_id", len(VECTORS)).items():
        assert (r.n_links, r.component_id, r.kept) == (degree[i], of[i], of[i] == i)


def test_op7(spark, folder):
    got = by_id(run(spark, folder, "op7_sharding"))
    slots = defaultdict(list)
    for i, r in got.items():
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw(i)) + 1, zlib.crc32(raw(i)), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(8)) and max(map(len, slots.values())) - min(len(slots[k]) for k in range(8)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op8(spark, folder):
    payloads = {i: (h or "").encode() for i, _, h in PAGES}
    for i, r in by_id(run(spark, folder, "op8_warc"), "page_id", len(PAGES)).items():
        original = max(k for k, p in payloads.items() if p == payloads[i])
        assert (r.payload_bytes, r.payload_digest) == (len(payloads[i]), base64.b32encode(hashlib.sha1(payloads[i]).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if original == i else ("revisit", original))


def test_op9(spark, folder):
    turns = defaultdict(list)
    for c, t, r, x in TURNS:
        turns[c].append((t, r or "", x or ""))
    turns[-1] = [(0, "user", queries.HOSTILE), (1, "assistant", queries.HOSTILE)]
    escaped = lambda x: re.sub(r"<(\\*)\|", r"<\1\\|", x)
    for c, r in by_id(run(spark, folder, "op9_chat"), "conv_id", len(turns)).items():
        rows = sorted(turns[c])
        learned = "".join(x for _, role, x in rows if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(rows), hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in rows).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r.formatted_chars == sum(len(f"<|im_start|>{role}\n{escaped(x)}<|im_end|>\n") for _, role, x in rows)


def links_of(texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    return prints, brute_components([(i, j) for i in prints for j in prints if j < i and (prints[i] ^ prints[j]).bit_count() <= 3], prints)


def test_op10(spark, folder):
    prints, of = links_of(dict(enumerate(TEXTS)))
    for i, r in by_id(run(spark, folder, "op10_simhash")).items():
        assert (r.fingerprint, r.component_id) == (f"{prints[i]:016x}", of[i])


def test_pipeline(spark, folder, reference_coder):  # noqa: F811
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = {r.doc_id: r.text for r in p.toxicity(spark, docs, folder).collect()}
    assert set(clean) <= set(range(len(TEXTS)))
    single = {k: clean[k] for k in set(links_of(clean)[1].values())}
    got = Counter(r.doc_id for r in p.run(spark, folder).collect())
    sizes, taken, largest = Counter(), Counter(), Counter()
    for i, t in single.items():
        sizes[DOCS[i][3]] += len(words(t))
        largest[DOCS[i][3]] = max(largest[DOCS[i][3]], len(words(t)))
        taken[DOCS[i][3]] += got[i] * len(words(t))
        assert got[i] <= 2
    assert set(got) <= set(single) and all(abs(taken[s] - target) <= largest[s] / 2 + 1e-6 for s, target in filled(sizes).items())
    for r in p.run(spark, folder).collect():
        assert r.n_tokens == len(reference_coder.encode_ordinary(TEXTS[r.doc_id] or "")) and r.decoded_sha256 == hashlib.sha256(raw(r.doc_id)).hexdigest()


# ---- the SQL


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and np.isnan(v):
        return None
    return v if isinstance(v, str) else float(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("kind", ["folder", "empty"])
def test_query_equals_sql(spark, request, name, kind):
    where, c = request.getfixturevalue(kind), duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}/{t}.parquet/*.parquet')")
    got, want = run(spark, where, name).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


# ---- label propagation


def spark_hash(*values):
    """Spark's xxhash64 of ints, longs (as ("long", x)) and texts; nulls say nothing."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<q", v[1]) if isinstance(v, tuple) else struct.pack("<i", v)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_propagation(rows, quota, rounds):
    """The shards of rows (id, group, rows of the group, h, shard), a row at a time."""
    shards, now = len(quota), {i: s for i, _, _, _, s in rows}
    for turn in range(rounds):
        tally, best = defaultdict(Counter), {}
        for i, g, *_ in rows:
            tally[g][now[i]] += 1
        for g, found in tally.items():
            shift = spark_hash(g) % shards
            best[g] = max(found, key=lambda s: (found[s], (s + shift) % shards))
        load, flow = Counter(now.values()), Counter((now[i], best[g]) for i, g, *_ in rows if now[i] != best[g])
        into = Counter()
        for (_, t), m in flow.items():
            into[t] += m
        met = {(s, t): min(1.0, (flow.get((t, s), 0) + max(quota[t] - load[t], 0) * m / into[t]) / m) for (s, t), m in flow.items()}
        if not any(v > 0 for v in met.values()):
            break
        for i, g, n, h, _ in rows:
            large = n > max(1, min(quota) // 64)
            chance = spark_hash(sharding.SEED + turn, g, ("long", h) if large else None) % (1 << 30) / float(1 << 30)
            if chance < met.get((now[i], best[g]), 0.0):
                now[i] = best[g]
    return now


def cut_share(shard, groups):
    """The share of links, between rows of a group, whose ends are in two shards."""
    members = defaultdict(list)
    for i, g in groups.items():
        members[g].append(shard[i])
    pairs = lambda n: n * (n - 1) / 2
    return 1 - sum(pairs(m) for s in members.values() for m in Counter(s).values()) / sum(pairs(len(s)) for s in members.values())


@pytest.mark.parametrize("hot", [2, 700])
def test_propagation_by_brute_force(spark, hot):
    rnd = random.Random(hot)
    groups = {i: f"g{rnd.randrange(250)}" for i in range(1000)} | {1000 + i: "hot" for i in range(hot)}
    sizes = Counter(groups.values())
    rows = [(i, g, sizes[g], rnd.randrange(-(1 << 62), 1 << 62), rnd.randrange(8)) for i, g in groups.items()]
    quota = [len(rows) // 8 + (k < len(rows) % 8) for k in range(8)]
    df = spark.createDataFrame(rows, "id long, grp string, n long, h long, shard int")
    got = {r.id: r.shard for r in sharding.propagate(df, quota).collect()}
    assert got == plain_propagation(rows, quota, sharding.ROUNDS)
    before, after = cut_share({i: s for i, _, _, _, s in rows}, {i: g for i, g in groups.items() if g != "hot"}), cut_share(got, {i: g for i, g in groups.items() if g != "hot"})
    assert before > 0.8 and after < before / 2


def test_shards_cut_few_links(spark):
    rnd = random.Random(5)
    groups = {i: f"text {rnd.randrange(900)}" for i in range(4000)}
    placed = sharding.shard_documents(spark.createDataFrame(list(groups.items()), "doc_id long, text string"))
    shard = {r.id: r.shard for r in placed.select("id", F.col("shard")).collect()}
    assert cut_share(shard, groups) < 0.15  # chance alone would cut seven of eight
