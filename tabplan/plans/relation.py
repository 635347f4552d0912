"""What a step makes: a lazy DataFrame and what has to be known of it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "_row_id"
#: Logical types of the data model.
TYPES = {"integer": T.LongType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "boolean": T.BooleanType(), "text": T.StringType()}


def name(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def logical(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "double"
    return {T.DateType: "date", T.TimestampNTZType: "timestamp", T.TimestampType: "timestamp", T.BooleanType: "boolean"}.get(type(kind), "text")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    role: str = "source"


@dataclass(frozen=True)
class Relation:
    """df holds the fields, and hidden columns that only the ordering needs."""

    name: str
    df: DataFrame
    fields: tuple[Field, ...]
    ordering: tuple[tuple[str, bool], ...] = ((ROW_ID, False),)  # (column, descending)
    gates: dict[str, str] = field(default_factory=dict)  # a semantic column and its status
    pending: frozenset[str] = frozenset()  # semantic stages that aren't complete
    row_preserving: bool = True
    scanned: int = 0  # bytes of the sources, as the optimizer sees them

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def with_(self, **changes) -> Relation:
        return replace(self, **changes)

    def order(self) -> list[Column]:
        return [name(c).desc_nulls_last() if down else name(c).asc_nulls_last() for c, down in self.ordering]

    def visible(self) -> DataFrame:
        return self.df.select(*map(name, self.names))

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*self.order()).select(*map(name, self.names))

    @property
    def provisional(self) -> bool:
        return bool(self.pending)
