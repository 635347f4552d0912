"""Reading Parquet tables as datasets, and cutting lineage through the shared folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.errors import PlanError
from ..plans.relation import ROW_ID, name


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where the session names none."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        named = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Ranges that a source's rows are numbered in: one for so many bytes, between these bounds; beyond, rows are sorted into a written table.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 16 << 20, 16, 64
SAMPLED = 32  # values of the first key for each range


def scanned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def with_row_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with _row_id first, numbered from 0 by keys, nulls last.

    Rows are dealt to ranges of the first key, whose bounds come from a sample of it, and each
    range numbers its own; how many stand before it is counted over the first key alone. All
    this is one lazy plan, and no part of it runs where no one asks for the ids. The first key
    should tell most rows apart: rows that agree in it are numbered by one task. Sources of
    more than MOST_RANGES ranges are sorted by all keys and written once instead.
    """
    ranges = max(LEAST_RANGES, scanned_bytes(df) // RANGE_BYTES)
    order = [name(k).asc_nulls_last() for k in keys]
    if ranges > MOST_RANGES:
        return sorted_ids(df, order).select(ROW_ID, *map(name, df.columns))
    key = name(keys[0])
    sample = df.select(key.alias("k"), F.monotonically_increasing_id().alias("i")).where("k is not null").orderBy(F.xxhash64("k", "i")).limit(ranges * SAMPLED)
    cuts = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.try_element_at("s", F.greatest(F.lit(1), (i * F.size("s") / ranges).cast("int"))))
    bounds = sample.agg(F.sort_array(F.collect_list("k")).alias("s")).select(cuts.alias("bounds"))

    def place(bounds: Column, k: Column) -> Column:
        """How many bounds are at most k, which is null last; spelled out, so that it compiles."""
        return sum(F.coalesce(F.try_element_at(bounds, F.lit(i)) <= k, k.isNull()).cast("int") for i in range(1, ranges))

    counted = df.select(key.alias("k"), bounds.scalar().alias("bounds")).select("bounds", place(F.col("bounds"), F.col("k")).alias("place")).groupBy("bounds", "place").agg(F.count(F.lit(1)).alias("n"))
    together = counted.agg(F.first("bounds").alias("bounds"), F.collect_list(F.struct("place", "n")).alias("counts"))
    before = lambda p: F.aggregate("counts", F.lit(0).cast("bigint"), lambda sofar, c: sofar + F.when(c["place"] < p, c["n"]).otherwise(0))
    # bounds and counts in one row, so that all rows are dealt by what was counted
    found = together.select(F.struct("bounds", F.transform(F.sequence(F.lit(0), F.lit(ranges - 1)), before).alias("before")).alias("found"))
    dealt = df.select("*", found.scalar().alias("__found")).select("*", place(F.col("__found.bounds"), key).alias("__place"))
    placed = dealt.select("*", F.element_at("__found.before", F.col("__place") + 1).alias("__before"))
    number = F.col("__before") + F.row_number().over(Window.partitionBy("__place").orderBy(*order)) - 1
    return placed.select(number.cast("bigint").alias(ROW_ID), *map(name, df.columns))


def sorted_ids(df: DataFrame, order: list[Column], out: str = ROW_ID) -> DataFrame:
    """df with a column 0, 1, 2, ... by `order`: range partitions number their own rows.

    The sorted rows are written to the shared folder once, and a table with a row for each
    partition tells how many stand before it.
    """
    placed = materialize(df.orderBy(*order).withColumn("__mono", F.monotonically_increasing_id()))
    part, place = F.shiftright("__mono", 33), F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))  # a row for each partition
    found = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return found.withColumn(out, (F.col("__before") + place).cast("bigint")).drop("__part", "__before", "__mono")


@dataclass
class Resolver:
    """Finds the DataFrames that plans name: datasets, answers of semantic stages, overrides."""

    datasets: dict[str, DataFrame | Callable[[], DataFrame]]
    answers: dict[str, DataFrame] = field(default_factory=dict)  # by step id, keyed by _row_id
    complete: set[str] = field(default_factory=set)  # step ids whose stage has all its answers
    overrides: DataFrame | None = None  # (row_id, column, value), a null value being an override too

    def dataset(self, dataset_id: str, path: str) -> DataFrame:
        if dataset_id not in self.datasets:
            raise PlanError(path, "unknown_dataset", f"dataset {dataset_id!r} does not exist", f"use one of {', '.join(sorted(self.datasets)[:30])}")
        found = self.datasets[dataset_id]
        df = found() if callable(found) else found
        if ROW_ID not in df.columns:
            raise PlanError(path, "no_row_id", f"dataset {dataset_id!r} has no {ROW_ID}")
        return df
