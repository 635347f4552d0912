"""Connected components by alternating star contractions, without collecting any edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, materialize


def _least(pairs: DataFrame) -> DataFrame:
    return apart(pairs.groupBy("u").agg(F.min("v").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least of its neighbourhood."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = _least(both)
    return both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x"), F.sum(F.xxhash64("lo", "hi") % 1_000_003).alias("s")).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of a proper edge; component is the smallest node reachable.

    Loops, repeated and null-ended edges say nothing and are left out; no edges give an empty
    table. A hub's rows meet in aggregates with map-side sums and in joins that adaptive
    execution can split. Each round is written to the shared folder, so that rounds don't
    pile up lineage; their number grows as the logarithm of the longest path.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    proper = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialize(proper.select(hi.alias("hi"), lo.alias("lo")).distinct())
    state = _state(now)
    while state[0]:
        now = materialize(_small_star(_large_star(now)))
        if (after := _state(now)) == state:
            break
        state = after
    nodes = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return nodes.unionByName(roots)
