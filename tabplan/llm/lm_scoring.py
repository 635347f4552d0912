"""LM scoring by cross-entropy difference: matched target and background bigram models over one vocabulary."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

#: Prior weight of the unigram in a bigram's probability, and of the even share in a unigram's; the same for both models.
BIGRAM_PRIOR, UNIGRAM_PRIOR = 20.0, 0.5
#: Words or bigrams a task counts before it hands them on.
HELD = 400_000
#: Words of a chunk, exceeded by one text at most; a chunk's different bigrams are looked up once.
CHUNK = 2_000_000
#: Buckets of hashes that counts are summed in; more where a bucket would look up over BUCKET_KEYS.
BUCKETS, BUCKET_KEYS = 1 << 10, 4_000_000
#: What no text's word is: the edge of a text, and the word that stands for those outside a bounded vocabulary.
EDGE, UNKNOWN = b"", b" "
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z) without ASCII punctuation; null counts as empty."""
    return (text or "").encode().translate(_CLEAN).split()


def count_words(texts: DataFrame) -> DataFrame:
    """(word, target, background) counts over all rows of (text, is_target), each task's summed before the shuffle."""
    schema = pa.schema([("word", pa.string()), ("target", pa.int64()), ("background", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def give() -> Iterator[pa.RecordBatch]:
            for is_target, found in held.items():
                if found:
                    n, zero = pa.array(found.values(), pa.int64()), pa.array(np.zeros(len(found), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), n if is_target else zero, zero if is_target else n], schema=schema)
                    found.clear()

        for part in slices(batches):
            for text, is_target in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                held[is_target].update(tokens(text))
            if sum(map(len, held.values())) >= HELD:
                yield from give()
        yield from give()

    return texts.mapInArrow(run, "word string, target long, background long").groupBy("word").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def vocabulary(counts: DataFrame, size: int) -> list[str]:
    """The words of the greatest share in either corpus, then by word; those met once in the target count by the background alone.

    So both models meet unknown words: in the target, too, rare words stand for them.
    """
    total = counts.agg(F.sum("target").cast("double"), F.sum("background").cast("double")).first()
    often = F.when(F.col("target") > 1, F.col("target")).otherwise(0)
    share = F.greatest(*(c / F.lit(max(1.0, n or 0.0)) for c, n in zip((often, F.col("background")), total, strict=True)))
    return [r.word for r in counts.orderBy(share.desc(), "word").limit(size).select("word").collect()]


class Ids:
    """Words as numbers: 0 unknown, 1 the edge of a text, then the vocabulary."""

    def __init__(self, words: list[str]):
        self.of = {w.encode(): i + 2 for i, w in enumerate(words)}
        self.size = len(words) + 2

    def cells(self, text: str | None) -> np.ndarray:
        """previous * size + next of each of the text's bigrams, the two at its edges included; none for a text without words."""
        found = tokens(text)
        if not found:
            return np.empty(0, np.int64)
        get = self.of.get
        ids = np.array([1, *(get(w, 0) for w in found), 1], np.int64)
        return ids[:-1] * self.size + ids[1:]


def pack(values: np.ndarray) -> bytes:
    """Numbers compressed byte by byte of their significance: those of small numbers, or of like ones, take next to nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes), "zstd", asbytes=True)


def unpack(packed: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed[8:], n * size, "zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def pack_sorted(keys: np.ndarray) -> bytes:
    """As pack(), of rising numbers: the steps between them."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, np.uint64), dtype=np.uint64)


def chunks(texts: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(chunk, is_target, ids, lengths, n, flat, hashes): rows of (id, text, is_target) as numbers, some CHUNK words together.

    flat holds an edge, then the words of each text that has any and an edge, as places in
    hashes, the chunk's different words. lengths are the texts' bigrams, n is their sum.
    With ``words``, all others are UNKNOWN.
    """
    sent = None if words is None else texts.sparkSession.sparkContext.broadcast({w.encode() for w in words})  # as many as the caller asked for
    schema = pa.schema([("chunk", pa.int64()), ("is_target", pa.bool_()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n", pa.int64()), ("flat", pa.binary()), ("hashes", pa.binary())])

    class Held:
        def __init__(self):
            self.place: defaultdict[bytes, int] = defaultdict()
            self.place.default_factory = self.place.__len__
            self.ids, self.lengths, self.flat = [], [], [np.array([self.place[EDGE]], np.int32)]
            self.n = 0

        def add(self, row_id: int | None, found: list[bytes]) -> None:
            self.ids.append(row_id)
            self.lengths.append(len(found) + 1 if found else 0)
            if found:
                self.flat.append(np.fromiter(map(self.place.__getitem__, [*found, EDGE]), np.int32, len(found) + 1))
            self.n += self.lengths[-1]

        def row(self, chunk: int, is_target: bool) -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.place), np.uint64, len(self.place))
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (chunk, is_target, self.ids, self.lengths, self.n, pack(np.concatenate(self.flat)), hashes.tobytes()), strict=True))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chunk, held = sent and sent.value, TaskContext.get().partitionId() << 32, {}
        for part in slices(batches):
            for row_id, text, is_target in zip(*(c.to_pylist() for c in part.columns), strict=True):
                found = tokens(text)
                if known is not None:
                    found = [w if w in known else UNKNOWN for w in found]
                at = held.get(is_target) or held.setdefault(is_target, Held())
                at.add(row_id, found)
                if at.n >= CHUNK or len(at.ids) >= CHUNK:
                    yield held.pop(is_target).row(chunk, is_target)
                    chunk += 1
        for is_target, at in held.items():
            yield at.row(chunk, is_target)
            chunk += 1

    return texts.mapInArrow(run, "chunk long, is_target boolean, ids array<long>, lengths array<long>, n long, flat binary, hashes binary")


class Grams:
    """A chunk's different bigrams (first, then; the place of each of flat's among them) and the order of its keys.

    Keys are hashes of 64 bits, first of the bigrams, even, then of the words, odd.
    """

    def __init__(self, flat: np.ndarray, hashes: np.ndarray):
        n = len(hashes)
        codes, self.place, times = np.unique(flat[:-1].astype(np.int64) * n + flat[1:], return_inverse=True, return_counts=True)
        self.first, self.then = np.divmod(codes, n)
        mixed = hashes[self.first] * np.uint64(0x9E3779B97F4A7C15) + hashes[self.then]
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        keys = np.concatenate([mixed & ~np.uint64(1), hashes | np.uint64(1)])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.times = np.concatenate([times, np.bincount(flat[1:], minlength=n)])[self.order]


def look_up(found: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, target, background, n_words): both corpora's counts of each chunk's keys, in their order, by bucket.

    Each chunk sends its different keys once, so that no bucket has more of a common word
    than of a rare one. n_words, in rows without a chunk, counts different words, EDGE among them.
    """
    sent = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("is_target", pa.bool_()), ("keys", pa.binary()), ("times", pa.binary())])
    back = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("target", pa.binary()), ("background", pa.binary()), ("n_words", pa.int64())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            chunk, is_target, flat, hashes = (c[0].as_py() for c in part.columns)
            grams = Grams(unpack(flat, np.int32), np.frombuffer(hashes, np.uint64))
            bucket = (grams.keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            ends = [*np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
            starts = [0, *ends[:-1]]
            rows = [(chunk, int(bucket[i]), is_target, pack_sorted(grams.keys[i:j]), pack(grams.times[i:j].astype(np.int64))) for i, j in zip(starts, ends, strict=True)]
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 256], strict=True), sent, strict=True)], schema=sent)

    def add(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        keys = [unpack_sorted(k) for k in rows["keys"].to_pylist()]
        is_target = np.repeat(rows["is_target"].to_numpy(), [len(k) for k in keys])
        times = np.concatenate([unpack(t, np.int64) for t in rows["times"].to_pylist()])
        different, place = np.unique(np.concatenate(keys), return_inverse=True)
        target, background = (np.bincount(place, times * m, len(different)).astype(np.int64)[place] for m in (is_target, ~is_target))
        out = [(None, bucket, None, None, int((different & np.uint64(1)).sum()))]
        start = 0
        for chunk, of_target, k in zip(rows["chunk"].to_pylist(), rows["is_target"].to_pylist(), keys, strict=True):
            if not of_target:
                out.append((chunk, bucket, *(pack(c[start : start + len(k)]) for c in (target, background)), None))
            start += len(k)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), back, strict=True)], schema=back)

    keyed = found.select("chunk", "is_target", "flat", "hashes").mapInArrow(send, "chunk long, bucket long, is_target boolean, keys binary, times binary")
    return keyed.groupBy("bucket").applyInArrow(add, "chunk long, bucket long, target binary, background binary, n_words long")


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int | None = None) -> DataFrame:
    """(id, n_tokens, ce_target, ce_background, score) of each row of docs.

    The background model counts all rows of docs, the target model all rows of target (a
    column text). score is the mean per token of the target's loss less the background's,
    in nats: the lower, the likelier a document is of the target's kind. n_tokens counts
    words and the end of the text; a text without words, null ones too, has 0 and null
    losses. Repeated rows count and are scored each time; an empty target leaves its model
    even; an empty docs gives an empty table. Other columns play no part.

    The models share the words of both corpora, or with ``size`` so many and an unknown
    word for the others. The unigram is smoothed by the even share, the bigram by the
    unigram, with the same prior weights whatever the counts: this is what makes two models
    match. Words and bigrams are told apart by 63 bits of hash.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    both = read.withColumn("is_target", F.lit(False)).unionByName(target.select(F.lit(None).cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.lit(True).alias("is_target")))
    words = None if size is None else vocabulary(materialize(count_words(both.select("text", "is_target"))), size)
    found = materialize(chunks(both, words))
    totals = {r.is_target: r for r in found.groupBy("is_target").agg(F.sum("n").alias("n"), F.sum(F.octet_length("hashes") / 8 + F.col("n")).alias("keys")).collect()}
    counts = materialize(look_up(found, max(BUCKETS, int(sum(r["keys"] for r in totals.values()) // BUCKET_KEYS))))
    n_words = len(words) + 2 if words is not None else 1 + (counts.agg(F.sum("n_words")).first()[0] or 0)  # EDGE and UNKNOWN among them
    of_target, of_background = (float(totals[m].n if m in totals else 0) for m in (True, False))
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ce_target", pa.float64()), ("ce_background", pa.float64()), ("score", pa.float64())])

    def score(chunk: pa.Table, rows: pa.Table) -> pa.Table:
        lengths = chunk["lengths"][0].values.to_numpy()
        has = lengths > 0
        grams = Grams(unpack(chunk["flat"][0].as_py(), np.int32), np.frombuffer(chunk["hashes"][0].as_py(), np.uint64))
        rows, means = rows.sort_by("bucket"), []
        for column, total in (("target", of_target), ("background", of_background)):
            n = np.empty(len(grams.order))
            n[grams.order] = np.concatenate([unpack(x, np.int64) for x in rows[column].to_pylist()])
            bigram, word = np.split(n, [len(grams.first)])
            unigram = (word + UNIGRAM_PRIOR) / (total + UNIGRAM_PRIOR * n_words)
            loss = np.log(word[grams.first] + BIGRAM_PRIOR) - np.log(bigram + BIGRAM_PRIOR * unigram[grams.then])
            mean = np.full(len(lengths), np.nan)
            if has.any():
                mean[has] = np.add.reduceat(loss[grams.place], (np.cumsum(lengths) - lengths)[has]) / lengths[has]
            means.append(mean)
        return pa.Table.from_arrays([chunk["ids"][0].values, pa.array(lengths), *(pa.array(m, mask=~has) for m in (*means, means[0] - means[1]))], schema=schema)

    scored = found.where("not is_target").select("chunk", "ids", "lengths", "flat", "hashes").groupBy("chunk").cogroup(counts.where("chunk is not null").select("chunk", "bucket", "target", "background").groupBy("chunk"))
    return scored.applyInArrow(score, "id long, n_tokens long, ce_target double, ce_background double, score double")
