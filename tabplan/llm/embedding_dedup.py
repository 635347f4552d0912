"""Embedding near-dedup by a subspace pigeonhole join over blocks of rotated vectors."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, materialize, slices, small
from .graph import connected_components

THRESHOLD, BLOCKS = 0.98, 4
#: Vectors of a cell that a task compares, in the mean, and pairs it verifies at once.
CHUNK, PAIRS = 8_192, 20_000
#: What shipping a copy of a vector costs, in pairs compared.
ROW_COST = 1_000
#: What rounding to single precision may add to a block's squared distance.
SLACK = 1e-6
#: Components travel to the range join in steps of 1/STEPS, and are off by half a step at most.
STEPS = 127
#: Vectors, those of least hash, that the rotation is fitted on, and those of the largest group that cells are tried on.
FITTED, TRIED = 4_000, 2_000
MOST_AXES = 12


def rotation(dim: int) -> np.ndarray:
    """An orthogonal matrix, the same for all vectors of `dim` components, that spreads their variance over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def principal_rotation(units: np.ndarray, blocks: int = BLOCKS) -> np.ndarray:
    """The principal axes of some unit vectors, dealt to the blocks in turn, so that each block begins with those that tell most vectors apart."""
    dim = units.shape[1]
    axes = np.linalg.eigh(np.cov(units.T).reshape(dim, dim))[1].T[::-1]
    edges, turned, taken = block_edges(dim, blocks), np.empty((dim, dim)), 0
    for k in range(dim):
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo + k < hi:
                turned[lo + k] = axes[taken]
                taken += 1
    return turned


def block_edges(dim: int, blocks: int = BLOCKS) -> list[int]:
    return [dim * i // min(blocks, dim) for i in range(min(blocks, dim) + 1)]


def budgets(dim: int, threshold: float, blocks: int = BLOCKS) -> np.ndarray:
    """Each block's share of the squared distance of two unit vectors at the threshold: one of them must be within its share."""
    return (2 - 2 * threshold) * np.diff(block_edges(dim, blocks)) / dim


def cells_of(part: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, their cells, whether they live there) of a block's leading components, in vectors of the cells' coordinates.

    Cells are cubes, twice the radius wide, so that a ball reaches one more cell on each
    axis. Of two vectors within the radius, that of the lesser cell comes to the other's.
    """
    y = part / (2 * radius)
    home = np.floor(y)
    beyond = np.where(y - home < 0.5, -1.0, 1.0)
    yield np.arange(len(part)), home, True
    for mask in range(1, 1 << part.shape[1]):
        chosen = np.array([bool(mask >> k & 1) for k in range(part.shape[1])])
        rows = np.flatnonzero(beyond[:, chosen.argmax()] > 0)
        if len(rows):
            yield rows, home[rows] + beyond[rows] * chosen, False


def grid_load(turned: np.ndarray, threshold: float, blocks: int = BLOCKS) -> list[tuple[float, float]]:
    """(copies of a vector, share of all pairs that meet) of a block of a grid on 0, 1, 2, ... axes, in the mean over the blocks, as these rotated vectors have them."""
    n, dim = turned.shape
    edges, shares, out = block_edges(dim, blocks), budgets(dim, threshold, blocks), []
    for axes in range(min(MOST_AXES, edges[1]) + 1):
        copies = pairs = 0.0
        for lo, share in zip(edges, shares, strict=False):
            found: dict[bytes, list[int]] = {}
            for _, cells, lives in cells_of(turned[:, lo : lo + axes], sqrt(share + SLACK)):
                copies += len(cells) / n
                for cell, m in zip(*np.unique(cells, axis=0, return_counts=True), strict=True) if axes else [(np.zeros(0), len(cells))]:
                    found.setdefault(cell.tobytes(), [0, 0])[not lives] += int(m)
            pairs += sum(h * (h / 2 + g) for h, g in found.values()) / (n * n)
        out.append((copies / len(shares), pairs / len(shares)))
        if out[-1][0] > 64:
            break
    return out


def axis_count(most: int, load: list[tuple[float, float]] | None = None) -> int:
    """On how many components cells are cut, for a largest group of `most` vectors. All counts give the same links.

    A copy costs as much as ROW_COST pairs, and cells of several chunks make for further
    copies. Without a measured load, each axis about doubles the copies that other cells get,
    and leaves about 0.6 of the pairs.
    """
    load = load or [(1 + (2**k - 1) / 2, 0.6**k / 2) for k in range(MOST_AXES + 1)]
    cost = [copies * ROW_COST * (1 + most * share / CHUNK) + most * share for copies, share in load]
    return cost.index(min(cost))


def _packed(raw: np.ndarray) -> bytes:
    """Single precision where that loses nothing, as with vectors that were read so."""
    short = raw.astype(np.float32)
    return short.tobytes() if (short == raw).all() else raw.tobytes()


def _unpacked(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * dim else np.float64).astype(np.float64)


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max()
    return raw / np.linalg.norm(raw)


def _rotations(vectors: DataFrame, blocks: int) -> dict[int, np.ndarray]:
    """By number of components, the rotation fitted on FITTED vectors at most; any rotation gives the same links."""
    units: dict[int, list[np.ndarray]] = {}
    for r in vectors.orderBy(F.xxhash64("node"), "node").limit(FITTED).select("vec").toArrow()["vec"]:
        raw = r.values.to_numpy(zero_copy_only=False).astype(np.float64)
        units.setdefault(len(raw), []).append(_unit(raw))
    return {dim: principal_rotation(np.stack(u), blocks) for dim, u in units.items() if len(u) > 2 * dim}


def _rotated(vectors: DataFrame, rotations: dict[int, np.ndarray]) -> DataFrame:
    """(node, grp, dim, raw, rotated) of (node, grp, vec): the components and the rotated unit vector in bytes; computed once and kept."""
    names = ["node", "grp", "dim", "raw", "rotated"]
    held = vectors.sparkSession.sparkContext.broadcast(rotations)  # a square matrix for each length of the fitted vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(held.value)
        for part in slices(batches, 2048):
            rows = []
            for node, grp, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                raw = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if len(raw) not in known:
                    known[len(raw)] = rotation(len(raw))
                rows.append((node, grp, len(raw), _packed(raw), (known[len(raw)] @ _unit(raw)).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=names)

    return vectors.select("node", "grp", "vec").mapInArrow(run, "node long, grp binary, dim int, raw binary, rotated binary")


#: What a cell's key holds after its group: the number of components and the block.
_KEY = np.dtype([("dim", ">u4"), ("block", "u1")])


def _cells(rotated: DataFrame, axes: int, threshold: float, blocks: int) -> DataFrame:
    """(node, cell, home, part): the cells of each block that a vector takes part in, whether it lives there, and its components up to the end of the block, in steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                rows = batch.take(pa.array(at))
                v = np.stack([np.frombuffer(b, np.float32) for b in rows.column(4).to_pylist()])
                stepped, grp = np.rint(v * STEPS).astype(np.int8), rows.column(1).to_pylist()
                edges, shares = block_edges(dim, blocks), budgets(dim, threshold, blocks)
                for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    key = np.array((dim, b), _KEY).tobytes()
                    parts = [p.tobytes() for p in stepped[:, :hi]]
                    for i, cells, lives in cells_of(v[:, lo : min(hi, lo + axes)].astype(np.float64), sqrt(shares[b] + SLACK)):
                        named = [grp[k] + key + c.tobytes() for k, c in zip(i, cells.astype(">i4"), strict=True)]
                        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(i)), pa.array(named, pa.binary()), pa.array(np.full(len(i), lives)), pa.array([parts[k] for k in i], pa.binary())], names=["node", "cell", "home", "part"])

    return rotated.mapInArrow(run, "node long, cell binary, home boolean, part binary")


def _tasks(cells: DataFrame) -> DataFrame:
    """cells (cell, node, home, part) with the comparisons (first, second) that each row takes part in, and on which side.

    A cell's vectors are cut into chunks, and each pair of chunks is a comparison: however
    many vectors lie in a cell, no task gets more than some chunks of them.
    """
    sizes = cells.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests")).where("homes > 0 and homes + guests > 1")
    met = cells.join(apart(sizes), "cell")
    chunk = lambda n: F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / CHUNK)).cast("int")
    many = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    numbered = met.select("cell", "node", "part", "home", F.when(F.col("home"), chunk("homes")).otherwise(chunk("guests")).alias("c"), many("homes").alias("hs"), many("guests").alias("gs"))
    side = lambda first, second, side: F.struct(first.alias("first"), second.alias("second"), side.alias("side"))
    zero, one = F.lit(0), F.lit(1)
    others = F.transform(F.sequence(zero, F.col("hs") - 1), lambda j: side(F.least("c", j), F.greatest("c", j), (F.col("c") > j).cast("int")))
    guests = F.when(F.col("gs") > 0, F.transform(F.sequence(zero, F.greatest(F.col("gs") - 1, zero)), lambda j: side(F.col("c"), F.col("hs") + j, zero))).otherwise(F.array().cast("array<struct<first:int,second:int,side:int>>"))
    as_guest = F.transform(F.sequence(zero, F.col("hs") - 1), lambda j: side(j, F.col("hs") + F.col("c"), one))
    whole = (F.col("hs") == 1) & (F.col("gs") <= 1)
    taken = F.when(whole, F.array(side(zero, zero, (~F.col("home")).cast("int")))).when(F.col("home"), F.concat(others, guests)).otherwise(as_guest)
    return numbered.select("cell", "node", "part", F.inline(taken))


def _layout(cell: bytes, blocks: int) -> tuple[int, int, list[int]]:
    """(number of components, block, edges of blocks) of a cell's vectors."""
    dim, own = np.frombuffer(cell[16 : 16 + _KEY.itemsize], _KEY)[0].tolist()
    return dim, own, block_edges(dim, blocks)


def _sides(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """The rows to be held against each other, and whether both are the same ones."""
    side = table["side"].to_numpy()
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return [(a, b, False), *([(a, a, True)] if table["first"][0].as_py() == table["second"][0].as_py() else [])]


def _near(part: np.ndarray, left: np.ndarray, right: np.ndarray, limit: float) -> np.ndarray:
    square = np.einsum("ij,ij->i", part, part)
    return square[left, None] + square[None, right] - 2 * part[left] @ part[right].T <= limit


def _strips(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Pieces of the comparison, of a million pairs at most: rows on the left and right, and which pairs count where both are the same."""
    step = max(1, (1 << 20) // max(1, table.num_rows))
    for left, right, once in _sides(table):
        for at in range(0, len(left), step) if len(right) else ():
            rows = left[at : at + step]
            yield rows, right, np.arange(at, at + len(rows))[:, None] < np.arange(len(right))[None, :] if once else None


def _candidates(threshold: float, blocks: int):
    """The rows of a comparison that have a partner within the block's budget, and surely within no earlier block's.

    Steps are off by half a step in each component, which the budgets give or take.
    """

    def run(table: pa.Table) -> pa.Table:
        dim, own, edges = _layout(table["cell"][0].as_py(), blocks)
        part = np.stack([np.frombuffer(b, np.int8) for b in table["part"].to_pylist()]).astype(np.float32) / STEPS
        shares, seen = budgets(dim, threshold, blocks), np.zeros(len(part), bool)
        off = [2 * sqrt(hi - lo) * (0.5 / STEPS + 1e-6) for lo, hi in zip(edges, edges[1:], strict=False)]
        block = lambda b: part[:, edges[b] : edges[b + 1]]
        for left, right, counts in _strips(table):
            near = _near(block(own), left, right, (sqrt(shares[own] + SLACK) + off[own]) ** 2 + 1e-6)
            if counts is not None:
                near &= counts
            for b in range(own):
                sure = sqrt(shares[b] + SLACK) - off[b]
                if not near.any():
                    break
                if sure > 0:
                    near &= ~_near(block(b), left, right, sure**2 - 1e-6)
            seen[left[near.any(axis=1)]] = True
            seen[right[near.any(axis=0)]] = True
        return table.filter(pa.array(seen)).select(["cell", "first", "second", "side", "node"])

    return run


def _compare(threshold: float, blocks: int):
    """A comparison's (node, links, root): links found here, by copies, and the least node they reach here.

    Only pairs within the block's budget are candidates; cosine in double precision
    decides. A pair belongs to the first block whose budget it keeps, so that no link
    counts twice.
    """

    def run(table: pa.Table) -> pa.Table:
        dim, own, edges = _layout(table["cell"][0].as_py(), blocks)
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        turned = np.stack([np.frombuffer(b, np.float32) for b in table["rotated"].to_pylist()]).astype(np.float64)
        raw = np.stack([_unpacked(b, dim) for b in table["raw"].to_pylist()])
        raw = raw / np.abs(raw).max(axis=1, keepdims=True)
        norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        limit = budgets(dim, threshold, blocks) + SLACK
        part = turned[:, edges[own] : edges[own + 1]]
        links, found = np.zeros(len(node), np.int64), []

        def verify(i: np.ndarray, j: np.ndarray) -> None:
            within = np.add.reduceat((turned[i] - turned[j]) ** 2, edges[:-1], axis=1) <= limit
            near = within[:, own] & ~within[:, :own].any(axis=1)
            i, j = i[near], j[near]
            near = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= threshold
            i, j = i[near], j[near]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            found.append((i, j))

        for left, right, counts in _strips(table):
            near = _near(part, left, right, limit[own] + 1e-9)
            if counts is not None:
                near &= counts
            i, j = np.nonzero(near)
            for k in range(0, len(i), PAIRS):
                verify(left[i[k : k + PAIRS]], right[j[k : k + PAIRS]])
        root, before = node.copy(), None
        i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        while before is None or (root != before).any():
            before = root.copy()
            np.minimum.at(root, i, before[j])
            np.minimum.at(root, j, before[i])
        seen = links > 0
        return pa.table({"node": pa.array(node[seen], pa.int64()), "links": pa.array(links[seen], pa.int64()), "root": pa.array(root[seen], pa.int64())})

    return run


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, blocks: int = BLOCKS) -> DataFrame:
    """(id, n_links, component_id, kept) of each row of vectors.

    Rows are linked if their labels are equal and not null, their vectors as long, and the
    cosine, in double precision, at least `threshold`, which has to be above 0. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing and are
    components of their own. Equal vectors of a label, by 128 bits of hash, are one
    representative with so many copies, and never make pairs; copies link one another, and
    with what the representative links with. Null ids take part; a component of such rows
    only has a null component_id, and kept is false. Repeated rows are rows of their own;
    other columns play no part; an empty table gives an empty one.

    The range join sees a vector's components in bytes, up to the end of each block. Only
    vectors that have a candidate there are sent whole to be compared exactly.
    """
    vec = F.col(vec_col).cast("array<double>")
    sound = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False)) & F.col(label_col).isNotNull()
    read = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(sound, F.unhex(F.md5(F.concat_ws("/", F.size(vec).cast("string"), F.col(label_col).cast("string"))))).alias("grp"), F.when(sound, F.transform(vec, lambda x: x + F.lit(0.0))).alias("vec"))
    rows = materialize(read.withColumn("place", F.monotonically_increasing_id()).withColumn("v1", F.xxhash64("vec")).withColumn("v2", F.xxhash64(F.lit(1), "vec")))
    whole, same = rows.where("grp is not null"), ["grp", "v1", "v2"]
    classes = materialize(whole.groupBy(*same).agg(F.min("place").alias("node"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")))
    largest = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "grp").first()
    several = classes.where("copies > 1")
    spare = materialize(whole.select(*same, "place").join(apart(several.select(*same, "node")), same).where("place <> node").select("place"))
    vectors = whole.select("place", "grp", "vec").join(small(spare), "place", "left_anti").withColumnRenamed("place", "node")
    rotated = materialize(_rotated(vectors, _rotations(vectors, blocks)))
    axes = 0
    if largest:
        tried = rotated.where(F.col("grp") == F.lit(bytes(largest.grp))).orderBy(F.xxhash64("node"), "node").limit(TRIED).select("rotated").collect()
        axes = axis_count(largest.n, grid_load(np.stack([np.frombuffer(r.rotated, np.float32) for r in tried]).astype(np.float64), threshold, blocks))
    compared = ["cell", "first", "second"]
    tasks = _tasks(_cells(rotated, axes, threshold, blocks))
    near = materialize(tasks.groupBy(*compared).applyInArrow(_candidates(threshold, blocks), "cell binary, first int, second int, side int, node long"))
    sent = rotated.select("node", "raw", "rotated").join(small(near), "node").join(small(several.select("node", "copies")), "node", "left").select(*compared, "side", "node", "raw", "rotated", F.coalesce("copies", F.lit(1)).alias("copies"))
    found = materialize(sent.groupBy(*compared).applyInArrow(_compare(threshold, blocks), "node long, links long, root long"))
    counted = materialize(found.groupBy("node").agg(F.sum("links").alias("links")))
    roots = materialize(connected_components(found.where("node <> root"), "node", "root").withColumnRenamed("node", "member"))
    joined = classes.join(small(counted), "node", "left").where("links is not null or copies > 1").join(small(roots), F.col("node") == F.col("member"), "left")
    known = materialize(joined.select(*same, "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("root")))
    named = materialize(known.join(apart(known.groupBy("root").agg(F.min("least").alias("component_id"))), "root").select(*same, "n_links", "component_id", F.lit(True).alias("linked")))
    given = rows.select("id", *same).join(small(named), same, "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    return given.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
