"""What is asked of finished and unfinished results: pages, aggregates, vectors, cells, provenance, overrides."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.expr import ExprCompiler
from .plans.compiler import metric
from .plans.errors import PlanError
from .plans.relation import ROW_ID, Relation, name
from .plans.spec import parse_expr, parse_metrics
from .sources.tables import sorted_ids



@dataclass(frozen=True)
class Bounds:
    """How much of a result a reader is given at once: rows, bytes of their JSON and characters of a cell."""

    rows: int
    bytes: int
    chars: int


# Fixed values of what a page holds for people and for agents, and of a sample.
WEB, AGENT, SAMPLE = Bounds(256, 256 << 10, 512), Bounds(50, 16 << 10, 240), Bounds(20, 8 << 10, 240)
PAGE_ROWS, CELL_CHARS = WEB.rows, WEB.chars
#: Rows that one task sorts for a page.
DEEP = 50_000


def _filtered(relation: Relation, where: dict | None) -> DataFrame:
    if where is None:
        return relation.df
    return relation.df.where(ExprCompiler(relation, "where").compile(parse_expr(where, "where")))


def _ordered_by(relation: Relation, sort: list[tuple[str, bool]] | None) -> list[Column]:
    if not sort:
        return relation.order()
    for c, _ in sort:
        if c not in relation.names:
            raise PlanError("sort", "unknown_column", f"column {c!r} does not exist", f"use one of {', '.join(relation.names[:30])}")
    return [name(c).desc_nulls_last() if down else name(c).asc_nulls_last() for c, down in [*sort, (ROW_ID, False)]]


def page(relation: Relation, columns: list[str] | None = None, where: dict | None = None, sort: list[tuple[str, bool]] | None = None, start: int = 0, limit: int = PAGE_ROWS) -> DataFrame:
    """Rows start to start + limit in the asked or the relation's own order, after the filter, which no status gates.

    Only the first start + limit rows are kept while sorting, in every task; for a page beyond
    DEEP rows all are numbered by ranges instead.
    """
    shown = columns or relation.names
    order = _ordered_by(relation, sort)
    if start + limit > DEEP:
        numbered = sorted_ids(_filtered(relation, where), order, "__at")
        return numbered.where(F.col("__at").between(start, start + limit - 1)).orderBy("__at").select(*map(name, shown))
    top = _filtered(relation, where).orderBy(*order).limit(start + limit)
    placed = top.withColumn("__at", F.row_number().over(Window.orderBy(*order)))
    return placed.where(F.col("__at") > start).orderBy("__at").select(*map(name, shown))


def rows_by_id(relation: Relation, row_ids: list[int], columns: list[str] | None = None) -> DataFrame:
    """The rows of some ids, in the order of the list."""
    spark: SparkSession = relation.df.sparkSession
    wanted = spark.createDataFrame(list(enumerate(row_ids)), "__at int, __want long")
    return relation.df.join(wanted, name(ROW_ID) == F.col("__want")).orderBy("__at").select(*map(name, columns or relation.names))


def summary(relation: Relation, where: dict | None = None) -> dict[str, Any]:
    """total rows after the filter, the relation's rows as denominator, and whether more may come."""
    total = _filtered(relation, where).count()
    denominator = relation.df.count() if where is not None else total
    return {"total": total, "denominator": denominator, "count_status": "provisional" if relation.provisional else "complete"}


def cut_cells(df: DataFrame, chars: int = CELL_CHARS) -> DataFrame:
    """Long texts cut, and a column _truncated that lists them."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    cut = [F.substring(name(c), 1, chars).alias(c) if c in texts else name(c) for c in df.columns]
    long = F.filter(F.array(*(F.when(F.length(name(c)) > chars, F.lit(c)) for c in texts)) if texts else F.array().cast("array<string>"), lambda x: x.isNotNull())
    return df.select(*cut, long.alias("_truncated"))


def bounded_page(relation: Relation, columns: list[str] | None = None, where: dict | None = None, sort: list[tuple[str, bool]] | None = None, start: int = 0, limit: int | None = None, bounds: Bounds = WEB) -> dict[str, Any]:
    """{rows, truncated, next}: a page's rows as dicts, as many as the bounds allow and one at least.

    Long texts are cut, and `_truncated` in such a row names them. truncated says whether
    anything was cut or left out, next where the following page begins, or None.
    """
    wanted = min(bounds.rows, limit or bounds.rows)
    found = cut_cells(page(relation, columns, where, sort, start, wanted + 1), bounds.chars).collect()  # a row more than a page
    rows, size, cut = [], 0, False
    for r in found[:wanted]:
        row = r.asDict(recursive=True)
        if not row["_truncated"]:
            del row["_truncated"]
        weight = len(json.dumps(row, default=str, ensure_ascii=False).encode())
        if rows and size + weight > bounds.bytes:
            cut = True
            break
        rows.append(row)
        size += weight
    left = len(found) > len(rows)
    return {"rows": rows, "truncated": cut or any("_truncated" in r for r in rows), "next": start + len(rows) if left else None}


def aggregate(relation: Relation, group_by: list[str], metrics: list[dict], where: dict | None = None, limit: int = 100) -> DataFrame:
    """Groups by the first metric, greatest first, nulls last, then by their keys."""
    found = parse_metrics(metrics, "metrics")
    for c in [*group_by, *(c for _, _, c in found if c is not None)]:
        if c not in relation.names:
            raise PlanError("group_by", "unknown_column", f"column {c!r} does not exist", f"use one of {', '.join(relation.names[:30])}")
    df = _filtered(relation, where)
    made = df.groupBy(*map(name, group_by)).agg(*(metric(df, fn, c).alias(out) for out, fn, c in found))
    return made.orderBy(name(found[0][0]).desc_nulls_last(), *(name(c).asc_nulls_last() for c in group_by)).limit(limit)


def vector(relation: Relation, column: str) -> DataFrame:
    """(_row_id, number) of a numeric column, (_row_id, code, label) of others, codes counting the sorted labels from 0."""
    df = relation.df.select(name(ROW_ID), name(column).alias("v"))
    if isinstance(df.schema["v"].dataType, T.NumericType):
        return df.select(ROW_ID, F.col("v").cast("double").alias("number"))
    text = df.select(ROW_ID, F.col("v").cast("string").alias("label"))
    labels = text.where("label is not null").select("label").distinct()
    codes = labels.withColumn("code", (F.row_number().over(Window.orderBy("label")) - 1).cast("bigint"))
    return text.join(codes, "label", "left").select(ROW_ID, "code", "label")


def range_filter(df: DataFrame, column: str, low: float | None, high: float | None, include_null: bool = False) -> DataFrame:
    """Rows from low to high, either of which may be open; null ones only if they are to be included."""
    c = name(column)
    inside = [c.isNotNull(), *([c >= low] if low is not None else []), *([c <= high] if high is not None else [])]
    within = reduce(lambda a, b: a & b, inside)
    return df.where(within | c.isNull() if include_null else within)


def label_filter(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Rows with one of the labels; without labels, all."""
    return df.where(name(column).isin(*labels)) if labels else df


def overrides(spark: SparkSession, cells: list[tuple[int, str, str | None]]) -> DataFrame:
    """Overrides (row id, column, text) for a resolver; seq tells which of several for a cell is the last."""
    return spark.createDataFrame([(r, c, v, i) for i, (r, c, v) in enumerate(cells)], "row_id long, column string, value string, seq int")


def cell(relation: Relation, row_id: int, column: str) -> Any:
    found = relation.df.where(name(ROW_ID) == row_id).select(name(column)).first()
    return found[0] if found else None


def provenance(answers: DataFrame, base: Relation, row_id: int, question: str) -> dict[str, Any]:
    """What stands behind a semantic cell: the source's row, the raw answer and the status."""
    source = base.df.where(name(ROW_ID) == row_id).first()
    found = answers.where(name(ROW_ID) == row_id).first()
    fields = {c: found[c] for c in answers.columns if c.startswith(f"{question}.")} if found else {}
    return {"row_id": row_id, "source": source.asDict() if source else None, "answer": fields}


def match_candidates(df: DataFrame, match: str) -> DataFrame:
    """(_row_id, right_row_id, p_same, retrieval_score, rank): the candidates of a match as rows."""
    kind = "array<struct<right_row_id:bigint,p_same:double,retrieval_score:double>>"
    rows = df.select(name(ROW_ID), F.posexplode(F.from_json(name(f"{match}.candidates"), kind)).alias("rank", "c"))
    return rows.select(ROW_ID, "c.*", "rank")
