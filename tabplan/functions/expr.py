"""Expressions of the plan language as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import PlanError
from ..plans.relation import Relation, name
from ..plans.spec import Call, Expr, Lit, Ref

_COMPARE = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
_ARITHMETIC = {"add": "__add__", "sub": "__sub__", "mul": "__mul__"}
_ARITY = {**dict.fromkeys([*_COMPARE, *_ARITHMETIC, "div", "contains", "icontains", "starts_with", "ends_with", "in"], 2), **dict.fromkeys(["not", "is_null", "not_null", "lower", "upper", "trim", "length", "year", "month", "date", "to_number"], 1), "replace": 3}


def plain_double(x: Column) -> Column:
    """A double as text: shortest digits, plain from 1e-4 to under 1e16, else with an exponent of two digits at least and its sign."""
    text = x.cast("string")
    sign, bare = F.when(text.startswith("-"), "-").otherwise(""), F.ltrim(text, F.lit("-"))
    mantissa, exponent = F.substring_index(bare, "E", 1), F.substring_index(bare, "E", -1).try_cast("int")
    short = F.regexp_replace(mantissa, r"\.0$", "")
    digits = F.regexp_replace(short, r"\.", "")
    whole = F.rpad(digits, F.greatest(exponent + 1, F.lit(1)), "0")
    large = F.when(F.length(digits) <= exponent + 1, F.concat(whole, F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits))))
    tiny = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-exponent - 1, F.lit(0))), digits)
    scientific = F.concat(short, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), "0"))
    placed = F.when(exponent.between(0, 15), large).when(exponent.between(-4, -1), tiny).otherwise(scientific)
    special = F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf")))
    return F.coalesce(special, F.when(F.contains(bare, F.lit("E")), F.concat(sign, placed)).otherwise(text))


def safe_timestamp(x: Column) -> Column:
    """A timestamp without zone, or null; dates need year, month and day, parted by - or /."""
    text = F.regexp_replace(F.trim(x), "/", "-")
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"), text).try_cast("timestamp_ntz")


def safe_number(x: Column) -> Column:
    """A double, or null; endings that Spark takes for type suffixes make no number."""
    return F.when(~x.rlike(r"[dDfF]\s*$"), x).try_cast("double")


class ExprCompiler:
    """Compiles expressions over a relation, and remembers which columns they name."""

    def __init__(self, relation: Relation, path: str):
        self.relation, self.path = relation, path
        self.referenced: set[str] = set()

    def kind(self, column: Column) -> T.DataType:
        df: DataFrame = self.relation.df
        return df.select(column.alias("x")).schema["x"].dataType

    def text(self, column: Column) -> Column:
        kind = self.kind(column)
        if isinstance(kind, T.StringType):
            return column
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return plain_double(column.cast("double"))
        return column.cast("string")

    def timestamp(self, column: Column) -> Column:
        kind = self.kind(column)
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            return column.cast("timestamp_ntz")
        return safe_timestamp(self.text(column)) if isinstance(kind, T.StringType) else F.lit(None).cast("timestamp_ntz")

    def number(self, column: Column) -> Column:
        if isinstance(self.kind(column), T.NumericType):
            return column.cast("double")  # by way of text, 1e7 would lose its exponent sign
        return safe_number(F.regexp_replace(self.text(column), r"[^0-9.\-]", ""))

    def compile(self, e: Expr, path: str | None = None) -> Column:
        path = path or self.path
        if isinstance(e, Ref):
            if e.column not in self.relation.names:
                raise PlanError(path, "unknown_column", f"column {e.column!r} does not exist in {self.relation.name!r}", f"use one of {', '.join(self.relation.names[:30])}")
            self.referenced.add(e.column)
            return name(e.column)
        if isinstance(e, Lit):
            if isinstance(e.value, tuple):
                raise PlanError(path, "invalid_in", "a list stands as the second argument of 'in' only")
            return F.lit(e.value).cast("bigint") if type(e.value) is int else F.lit(e.value)
        return self._call(e, path)

    def _call(self, e: Call, path: str) -> Column:
        op, n = e.op, len(e.args)
        if n != _ARITY.get(op, n) or op in ("and", "or") and n < 2 or op == "coalesce" and n < 1 or op == "case" and (n < 3 or n % 2 == 0):
            wanted = _ARITY.get(op) or {"case": "pairs and an else value, so an odd number from 3,", "coalesce": "at least 1"}.get(op, "at least 2")
            raise PlanError(path, "arity", f"{op!r} takes {wanted} argument(s), got {n}")
        if op == "in":
            return self._in(e, path)
        args = [self.compile(a, f"{path}.args[{i}]") for i, a in enumerate(e.args)]
        first = args[0]
        if op in _COMPARE or op in _ARITHMETIC:
            return getattr(first, (_COMPARE | _ARITHMETIC)[op])(args[1])
        if op == "div":
            return F.try_divide(first.cast("double"), args[1].cast("double"))
        if op in ("and", "or"):
            return reduce(lambda a, b: a & b if op == "and" else a | b, args)
        if op == "case":
            pairs = list(zip(args[:-1:2], args[1::2], strict=True))
            return reduce(lambda w, p: w.when(*p), pairs[1:], F.when(*pairs[0])).otherwise(args[-1])
        simple = {
            "not": lambda: ~first,
            "is_null": first.isNull,
            "not_null": first.isNotNull,
            "coalesce": lambda: F.coalesce(*args),
            "contains": lambda: F.contains(self.text(first), args[1]),
            "icontains": lambda: F.contains(F.lower(self.text(first)), F.lower(args[1])),
            "starts_with": lambda: F.startswith(self.text(first), args[1]),
            "ends_with": lambda: F.endswith(self.text(first), args[1]),
            "lower": lambda: F.lower(self.text(first)),
            "upper": lambda: F.upper(self.text(first)),
            "trim": lambda: F.trim(self.text(first)),
            "length": lambda: F.length(self.text(first)).cast("bigint"),
            "year": lambda: F.year(self.timestamp(first)).cast("bigint"),
            "month": lambda: F.month(self.timestamp(first)).cast("bigint"),
            "date": lambda: self.timestamp(first).cast("date"),
            "to_number": lambda: self.number(first),
            "replace": lambda: F.when(args[1] == "", self.text(first)).otherwise(F.replace(self.text(first), args[1], args[2])),
        }
        return simple[op]()

    def _in(self, e: Call, path: str) -> Column:
        first, items = e.args
        column = self.compile(first, f"{path}.args[0]")
        if not isinstance(items, Lit) or not isinstance(items.value, tuple):
            raise PlanError(path, "invalid_in", "'in' needs a literal list as its second argument")
        known = [v for v in items.value if v is not None]
        if not items.value:
            return F.lit(False)
        found = column.isin(*known) if known else F.lit(False)
        return found if len(known) == len(items.value) else F.when(found, True).otherwise(F.lit(None).cast("boolean"))
