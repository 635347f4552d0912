"""Toxicity by non-negative positive-unlabelled learning: a linear numpy classifier over hashed words."""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from math import log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import slices, without

FEATURES = 1 << 18
#: Bounds of the samples that the classifier is fitted on, taken by hash of the id.
POSITIVES, UNLABELLED = 1_500, 5_000
#: Buckets that fewer rows of the sample have are left out: a row would be learned by heart from them.
LEAST_ROWS = 4
#: Words of which a worker remembers the weight; then it starts afresh.
REMEMBERED = 400_000
#: Parts that the fitting rows are dealt to, each scored by a classifier that was fitted on the others.
PARTS = 5
FOLDS = 5
#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest parts words.
_CLEAN = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalnum() and b > 64 else b if chr(b).isdigit() and b < 128 else 32 for b in range(128)) + bytes(range(128, 256))


def words(text: str | None) -> Counter:
    return Counter((text or "").encode().translate(_CLEAN).split())


def features(word: bytes) -> list[int]:
    """The buckets of a word: itself and its beginnings of four to six bytes, for words not met in training."""
    return [zlib.crc32(b"w" + word) % FEATURES, *(zlib.crc32(b"p" + word[:n]) % FEATURES for n in (4, 5, 6) if len(word) > n)]


class Classifier:
    """score = sigmoid(bias + weights . x); x has log(1 + count) of each word in all its buckets, scaled to length 1 by words."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        self._seen: dict[bytes, float] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_seen": {}}

    def score(self, text: str | None) -> float:
        """0 to 1, of the whole text; a text without words gets what the bias says."""
        total = square = 0.0
        seen = self._seen
        for word, n in words(text).items():
            w = seen.get(word)
            if w is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                w = float(self.weights[features(word)].sum())
                if len(word) <= 64:
                    seen[word] = w
            g = log1p(n)
            total += g * w
            square += g * g
        z = self.bias + (total / sqrt(square) if square else 0.0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sparse(text: str | None) -> tuple[list[int], list[float]]:
    found = words(text)
    norm = sqrt(sum(log1p(n) ** 2 for n in found.values()))
    idx, val = [], []
    for w, n in found.items():
        for i in features(w):
            idx.append(i)
            val.append(log1p(n) / norm)
    return idx, val


class _Matrix:
    """Sparse rows in numpy."""

    def __init__(self, rows: list[tuple]):
        self.size = np.array([len(i) for i, _ in rows])
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.idx = np.concatenate([np.asarray(i, np.int32) for i, _ in rows] or [np.empty(0, np.int32)])
        self.val = np.concatenate([np.asarray(v, np.float32) for _, v in rows] or [np.empty(0, np.float32)])

    def keep(self, entries: np.ndarray) -> None:
        """Leave out all other entries; rows stay rows."""
        row = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)[entries]
        self.idx, self.val, self.size = self.idx[entries], self.val[entries], np.bincount(row, minlength=len(self.size))
        self.start = np.concatenate([[0], np.cumsum(self.size)])

    def take(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, values and the position in `chosen` of all entries of the chosen rows."""
        size = self.size[chosen]
        at = np.repeat(self.start[chosen] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return self.idx[at], self.val[at], np.repeat(np.arange(len(chosen)), size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def pu_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(positive risk, corrected negative risk, and what a step goes down, by each z of zp and of zu times their numbers).

    With the logistic loss, the risks are pi R_P(+) and R_U(-) - pi R_P(-). A step goes down
    their sum, but while the second is below zero, as no true risk can be, out of that alone.
    """
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    # derivatives: of log(1 + e^-z) it is sigmoid(z) - 1, of log(1 + e^z) it is sigmoid(z)
    if negative >= 0:
        return positive, negative, prior * (_sigmoid(zp) - 1) - prior * _sigmoid(zp), _sigmoid(zu)
    return positive, negative, prior * _sigmoid(zp), -_sigmoid(zu)


def _fit(positive: list[tuple], unlabelled: list[tuple], prior: float, steps: int, batch: int, rate: float, decay: float, seed: int) -> tuple[np.ndarray, float]:
    """Minimise the non-negative risk pi R_P(+) + max(0, R_U(-) - pi R_P(-)) by Adam, in so many steps of a batch, and to the end of a pass over the unlabelled rows."""
    rows = np.zeros(FEATURES, np.int32)
    for i, _ in positive + unlabelled:
        rows[np.unique(i)] += 1
    p, u, rng = _Matrix(positive), _Matrix(unlabelled), np.random.default_rng(seed)
    for matrix in (p, u):
        matrix.keep(rows[matrix.idx] >= LEAST_ROWS)
    seen = np.zeros(FEATURES, bool)
    seen[p.idx] = seen[u.idx] = True
    used, place = np.flatnonzero(seen), np.cumsum(seen, dtype=np.int32) - 1
    p.idx, u.idx = place[p.idx], place[u.idx]
    w, m, v = (np.zeros(len(used) + 1) for _ in range(3))  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    passed = max(1, -(-len(unlabelled) // batch))
    epochs, t = -(-steps // passed), 0
    for epoch in range(epochs):
        order = rng.permutation(len(unlabelled))
        for k in range(passed):
            rows_u = order[k * batch : (k + 1) * batch]
            rows_p = rng.choice(len(positive), min(len(positive), batch // 2), replace=False)
            grad = np.zeros_like(w)
            sides = []
            for matrix, rows in ((p, rows_p), (u, rows_u)):
                idx, val, row = matrix.take(rows)
                z = np.bincount(row, val * w[idx], len(rows)) + w[-1]
                sides.append((idx, val, row, z, len(rows)))
            _, _, dp, du = pu_risk(sides[0][3], sides[1][3], prior)
            for (idx, val, row, _, n), d in zip(sides, (dp, du), strict=True):
                grad += np.bincount(idx, val * (d / n)[row], len(w))
                grad[-1] += d.mean()
            t += 1
            grad[:-1] += decay * w[:-1]
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(FEATURES)
    weights[used] = w[:-1]
    return weights, w[-1]


def parts(positive: list[tuple], unlabelled: list[tuple], most: int = PARTS) -> tuple[np.ndarray, np.ndarray, int]:
    """(part of each positive row, of each unlabelled one, number of parts): rows of one text are in one part, on whichever side they stand."""
    of: dict[bytes, int] = {}
    place = [[of.setdefault(i.tobytes() + v.tobytes(), len(of)) for i, v in side] for side in (positive, unlabelled)]
    n = max(1, min(most, len(set(place[0])), len(of)))
    return np.array(place[0], int) % n, np.array(place[1], int) % n, n


def _fit_apart(positive: list[tuple], unlabelled: list[tuple], in_p: np.ndarray, in_u: np.ndarray, k: int, *options) -> tuple[np.ndarray, float, list[float], list[float]]:
    """(weights, bias) fitted on all rows but those of part k, and what they say of these, on either side."""
    away = [[r for r, at in zip(side, where, strict=True) if at != k] for side, where in ((positive, in_p), (unlabelled, in_u))]
    w, b = _fit(*away, *options)
    return w, b, *([b + float(w[i] @ v) for (i, v), at in zip(side, where, strict=True) if at == k] for side, where in ((positive, in_p), (unlabelled, in_u)))


def fit_nnpu(positive: list[tuple], unlabelled: list[tuple], prior: float, steps: int = 240, batch: int = 512, rate: float = 0.15, decay: float = 1e-3, seed: int = 7, run: Callable = map) -> Classifier:
    """The mean of PARTS classifiers, each fitted on all rows but those of one part, whose scores set the bias.

    A text that stands on both sides, or several times, is in one part, so that no classifier
    scores what it was fitted on. From these scores, the threshold is taken that maximises
    recall^2 / share of unlabelled rows above it, which needs no negative labels, among those
    with at most the prior's share above them; there, the score is 1/2. With fewer than two
    different positive texts, or nothing unlabelled to hold them against, nothing is toxic.
    `run` maps the fitting over the parts.
    """
    in_p, in_u, n = parts(positive, unlabelled)
    if n < 2 or any(not (in_u != k).any() for k in range(n)):
        return Classifier(np.zeros(FEATURES), -20.0)
    found = list(run(lambda k: _fit_apart(positive, unlabelled, in_p, in_u, k, prior, steps, batch, rate, decay, seed), range(n)))
    weights, bias = sum(f[0] for f in found) / n, sum(f[1] for f in found) / n
    zp, zu = (np.sort([z for f in found for z in f[side]]) for side in (2, 3))
    recall = 1 - np.arange(len(zp)) / len(zp)
    share = (len(zu) - np.searchsorted(zu, zp) + 1) / (len(zu) + 1)
    merit = np.where(share <= max(prior, share.min()), recall**2 / share, 0)
    best = zp[merit.argmax()]
    below = zu[zu < best]
    return Classifier(weights, bias - (best + (below[-1] if len(below) else best)) / 2)


def on_executors(spark: SparkSession) -> Callable:
    """A map whose calls are a task each; results come back in order."""

    def run(f: Callable, of: range) -> list:
        def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(f(k))], pa.binary())], names=["k", "made"])

        rows = spark.range(of.start, of.stop, 1, len(of)).mapInArrow(call, "k long, made binary").collect()
        return [pickle.loads(r.made) for r in sorted(rows, key=lambda r: r.k)]

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves no remainder; false for null ids, of which no label is learned either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _featurize(docs: DataFrame) -> list[tuple]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [sparse(t) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float32())), part.column(1)], names=["idx", "val", "toxic"])

    got = docs.mapInArrow(run, "idx array<int>, val array<float>, toxic boolean").toArrow()
    return [(i.values.to_numpy(), v.values.to_numpy(), t.as_py()) for i, v, t in zip(got["idx"], got["val"], got["toxic"], strict=True)]


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """Fit on rows outside the held-out fold: confirmed toxic ones, and labelled rows whose label is hidden.

    The class prior is the share of toxic rows among all training labels. Of these rows at
    most `positives` and `unlabelled` are used, those of least hash, so that a rerun takes
    the same ones; the driver gets their features only. Null ids and labels teach nothing;
    with repeated labels of one id, it is toxic if any says so. Without toxic labels nothing
    is toxic, and if all labels are, everything is.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where("__id is not null and toxic is not null")
    known = known.where(~held_out("__id")).groupBy("__id").agg((F.max("toxic") > 0).alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.sum(F.col("toxic").cast("long"))).first()
    if not toxic or toxic == n:
        return Classifier(np.zeros(FEATURES), 20.0 if toxic else -20.0)
    mark = F.xxhash64("__id")
    chosen = known.where("toxic").orderBy(mark, "__id").limit(positives).select("__id", F.lit(True).alias("toxic"))
    others = known.orderBy(F.xxhash64("__id", F.lit("u")), "__id").limit(unlabelled).select("__id", F.lit(False).alias("toxic"))
    ids = chosen.unionByName(others)
    # at most positives + unlabelled rows: small enough to go to every executor
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text")).where("__id is not null").join(F.broadcast(ids), "__id")
    rows = sorted(_featurize(texts.select("text", "toxic")), key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))
    return fit_nnpu([(i, v) for i, v, t in rows if t], [(i, v) for i, v, t in rows if not t], toxic / n, run=on_executors(docs.sparkSession))


def score_texts(docs: DataFrame, model: Classifier, text_col: str = "text", output: str = "score") -> DataFrame:
    """docs with a column `output`: the score of each whole text, null counting as empty.

    A column of that name, in any case, is replaced; all others stay. Each row stands by
    itself, so ties and repeated rows score alike, and an empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES floats, whatever the data

    kept = docs.select(*without(docs, output))
    at = [c.lower() for c in kept.columns].index(text_col.lower()) if text_col.lower() != output.lower() else None
    source = kept if at is not None else docs.select(*without(docs, output), F.col(text_col).alias("__text"))
    place = at if at is not None else len(source.columns) - 1
    schema = StructType([*kept.schema.fields, StructField(output, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part in slices(batches):
            scores = pa.array([model.score(t) for t in part.column(place).to_pylist()], pa.float64())
            columns = part.columns if at is not None else part.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, scores], names=schema.names)

    return source.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, model_docs: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """docs, less those that score at least `threshold`; columns stay as they are."""
    scored = score_texts(docs, train(docs if model_docs is None else model_docs, labels), output="__toxic_score")
    return scored.where(F.col("__toxic_score") < threshold).drop("__toxic_score")
