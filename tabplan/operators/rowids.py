"""Dense row ids by a given order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.relation import ROW_ID
from ..sources.tables import materialize, sorted_ids

#: Up to so many bytes of sources, and so many rows of a join, one task numbers the rows; beyond, ranges of them are numbered apart.
ONE_TASK_BYTES, ONE_TASK_ROWS = 256 << 20, 200_000


def dense_ids(df: DataFrame, order: list[Column], scanned: int, out: str = ROW_ID) -> DataFrame:
    """df with a column 0, 1, 2, ... by `order`, which should decide between all rows.

    `scanned` bounds the bytes of df's rows. Small results are numbered by one window, large
    ones by range partitions.
    """
    if scanned <= ONE_TASK_BYTES:
        return df.withColumn(out, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    return sorted_ids(df, order, out)


def counted_ids(df: DataFrame, order: list[Column], out: str = ROW_ID) -> tuple[DataFrame, int]:
    """(dense ids of rows of which no one knows how many there are, their number): they are written once and counted."""
    held = materialize(df)
    n = held.count()
    return dense_ids(held, order, 0 if n <= ONE_TASK_ROWS else ONE_TASK_BYTES + 1, out), n
