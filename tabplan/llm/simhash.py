"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified Hamming distance, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, materialize, slices, small
from .graph import connected_components

SEED, SHINGLE, DISTANCE, BITS = 42, 3, 3, 64
#: Shingles hashed and counted at once, so that a very long text needs no more memory than another.
SHINGLES_AT_ONCE = 1 << 16
_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """64 bits, as a signed integer; bit i is 1 if it is set in over half the hashes of the shingles.

    bytes.lower() and bytes.split() do just what the words ask for: only A-Z change, and
    words end at space and \\t to \\r.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    ends = ends[SHINGLE - 1 :] or [len(joined)]
    total, hashed = np.zeros(2048, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(ends), SHINGLES_AT_ONCE):
        part = [joined[s:e] for s, e in zip(starts[at : at + SHINGLES_AT_ONCE], ends[at : at + SHINGLES_AT_ONCE], strict=False)]
        h = np.fromiter(map(hashed, part, repeat(SEED)), np.uint64, len(part))
        total += np.bincount((h.astype(">u8").view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048)
    ones = np.einsum("bv,vi->bi", total.reshape(8, 256), _BIT).ravel()
    return int(np.packbits(ones * 2 > len(ends)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(id, fp) of each row of docs, from its whole text, and with `hashed` the text's hash; null and blank texts have fingerprint 0."""
    more = [F.xxhash64(text_col).alias("text_hash")] if hashed else []
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), *(("text_hash", pa.int64()) for _ in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            fps = [fingerprint(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64()), *part.columns[2:]], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *more).mapInArrow(run, ", ".join(f"{n} long" for n in schema.names))


def block_count(n: int, distance: int = DISTANCE) -> int:
    """The fewest blocks for which a fingerprint meets less than one unlike partner, of n spread evenly.

    Fingerprints at most `distance` apart agree on all but `distance` of m blocks; the rest,
    joined, is the key, of 64 (m - distance) / m bits. More rows call for longer keys.
    """
    return next(m for m in range(distance + 1, 17) if m == 16 or comb(m, distance) * n <= 2 ** (BITS * (m - distance) / m))


def block_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """A mask, as a signed integer, for each choice of the blocks that have to agree."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    each = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in (sum(x) for x in combinations(each, blocks - distance))]


def linked_fingerprints(distinct: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct column fp at Hamming distance 1 to `distance`, some repeated.

    The distance is a condition of the join itself: pairs that merely share a block are never rows.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(block_masks(block_count(n, distance), distance))])
    keyed = distinct.select("fp", F.inline(masks))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    same = (F.col("a.mask") == F.col("b.mask")) & (F.col("a.key") == F.col("b.key"))
    return a.join(b, same & (F.col("a.fp") < F.col("b.fp")) & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id, fp, component_id) of each row of docs.

    component_id is the smallest id that links of up to `distance` differing bits reach.
    Equal fingerprints are one node, so copies never make pairs. Null and blank texts have
    fingerprint 0 and link as any other; ids that repeat are documents of their own that
    bear one name; rows without an id take part, and a component of such rows only has a
    null component_id. Other columns of docs play no part. An empty table gives an empty one.
    """
    return components_of(fingerprints(docs, id_col, text_col), distance).select("id", "fp", "component_id")


def components_of(found: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of fingerprints() with their component_id and root, a fingerprint that stands for the component."""
    rows = materialize(found)
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(linked_fingerprints(nodes.select("fp"), nodes.count(), distance), "a", "b")
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = apart(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    named = materialize(grouped.join(least, "root").select("fp", "component_id", "root"))
    return rows.join(small(named), "fp")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, less all rows but one of each component: that of least id, then of least hash of its text; columns stay as they are.

    Rows without an id come last, and one of them stays where a component has no others. Of
    rows that agree in id and text any one stays. Unlike texts that share an id are rows of
    their own.
    """
    found = components_of(fingerprints(docs, id_col, text_col, hashed=True))
    keys = materialize(found.groupBy("root", "id", "text_hash").agg(F.count(F.lit(1)).alias("n")))
    best = apart(keys.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash")).alias("best")))
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text_hash") == F.col("best.text_hash"))
    decided = materialize(keys.join(best, "root").where(~stays | (F.col("n") > 1)).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), stays.alias("__stays")))
    marked = docs.select("*", docs[id_col].cast("long").alias("__of"), F.xxhash64(docs[text_col]).alias("__text"))
    same = F.col("__of").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash"))
    single = marked.join(small(decided), same, "left_anti")
    repeated = decided.where("__stays")
    if repeated.limit(1).count():  # rows that stay and are there more than once
        single = single.unionByName(marked.join(small(repeated), same, "left_semi").dropDuplicates(["__of", "__text"]))
    return single.drop("__of", "__text")
