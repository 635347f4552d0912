"""What the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: A side of a join is broadcast only after its rows and their bytes were counted and found to be at most so many.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 48 << 20
#: Rows turned into Python objects at once; Arrow batches may hold thousands of long texts.
ROWS_AT_ONCE = 256
#: Bytes of one Arrow batch on its way back to the JVM, exceeded by one row at most.
BATCH_BYTES = 8 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); one of our own only where none is named."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        named = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder: later reads never go back to the sources."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if its rows are few and hold few bytes; df should be cheap to count, as materialized rows are.

    A column counts 8 bytes a row, texts and bytes besides what they hold.
    """
    long = [F.coalesce(F.sum(F.octet_length(f"`{f.name.replace('`', '``')}`")), F.lit(0)) for f in df.schema if isinstance(f.dataType, (StringType, BinaryType))]
    n, *held = df.limit(rows + 1).agg(F.count(F.lit(1)), *long).first()
    return F.broadcast(df) if n <= rows and 8 * n * len(df.columns) + sum(held) <= BROADCAST_BYTES else df


def apart(found: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """An aggregate that is to be joined back by its key: written first, and broadcast if it is small.

    In one plan, the join would take over the aggregate's partitions, and adaptive execution
    could not split a hot key's rows on the other side.
    """
    return small(materialize(found), rows)


def without(df: DataFrame, *names: str) -> list[Column]:
    """The columns of df but for these; names are compared as Spark does, without case."""
    gone = {n.lower() for n in names}
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in gone]


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Rows:
    """Collects output columns and gives them up as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.bytes = schema, 0
        self.columns: list[list] = [[] for _ in schema]

    def add(self, values, weight: int = 64) -> bool:
        """Take one row; true if the batch is full."""
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.bytes += weight
        return self.bytes >= BATCH_BYTES

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.bytes, self.columns = 0, [[] for _ in self.schema]
