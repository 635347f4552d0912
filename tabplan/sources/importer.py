"""Strict CSV and TSV import: dialect, header, rejects, types from all rows, dense row ids, statistics."""

from __future__ import annotations

import codecs
import csv
import gzip
import hashlib
import io
import json
import os
import re
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import safe_number, safe_timestamp
from ..plans.errors import PlanError
from ..plans.relation import ROW_ID, TYPES, name

# Fixed values of the import: limits, texts that stand for null, delimiters, texts of booleans.
MAX_BYTES, MAX_ROWS = 100 << 20, 100_000
NULLS = ("", "NA", "N/A", "null", "NULL", "None")
DELIMITERS = (",", "\t", ";", "|")
TRUE, FALSE = ("true", "yes", "t"), ("false", "no", "f")
SNIFFED, NEAR_MISS = 64 << 10, 0.9
#: Encodings by Python's names, as Spark's reader knows them.
ENCODINGS = {"utf-8": "UTF-8", "iso8859-1": "ISO-8859-1", "ascii": "US-ASCII", "utf-16": "UTF-16", "utf-16-be": "UTF-16BE", "utf-16-le": "UTF-16LE"}


@dataclass(frozen=True)
class Options:
    """How a file is to be read; what is None is found out from its beginning."""

    delimiter: str | None = None
    header: bool | None = None
    encoding: str = "utf-8"
    quote: str = '"'
    null_strings: tuple[str, ...] = NULLS

    def check(self) -> None:
        for field_, text in (("delimiter", self.delimiter), ("quote", self.quote)):
            if text is not None and len(text) != 1:
                raise PlanError(f"options.{field_}", "length", "one character is expected")
        try:
            known = codecs.lookup(self.encoding).name in ENCODINGS
        except LookupError:
            known = False
        if not known:
            raise PlanError("options.encoding", "choice", f"encoding {self.encoding!r} can't be read", f"use one of {', '.join(ENCODINGS)}")


@dataclass
class Report:
    delimiter: str
    has_header: bool
    rows: int = 0
    checksum: str = ""
    columns: list[dict[str, Any]] = field(default_factory=list)
    rejects: list[dict[str, Any]] = field(default_factory=list)
    coercions: list[dict[str, Any]] = field(default_factory=list)


def sanitize(names: list[str]) -> list[str]:
    """Column names: white space collapsed, dots as _, blank ones column_N, repeated ones (without case) numbered from _2."""
    out: list[str] = []
    taken: set[str] = set()
    for i, raw in enumerate(names):
        base = " ".join(raw.lstrip("﻿").split()).replace(".", "_") or f"column_{i + 1}"
        found, n = base, 1
        while found.lower() in taken:
            n += 1
            found = f"{base}_{n}"
        taken.add(found.lower())
        out.append(found)
    return out


def _open(path: str | bytes, encoding: str = "utf-8"):
    """The text of a file of the driver's disk, or of its bytes."""
    encoding = "utf-8-sig" if codecs.lookup(encoding).name == "utf-8" else encoding
    if isinstance(path, bytes):
        return io.TextIOWrapper(gzip.GzipFile(fileobj=io.BytesIO(path)) if path[:2] == b"\x1f\x8b" else io.BytesIO(path), encoding, newline="")
    return gzip.open(path, "rt", encoding=encoding, newline="") if path.endswith(".gz") else open(path, encoding=encoding, newline="")


def sniff(path: str | bytes, options: Options = Options()) -> tuple[str, bool]:
    """(delimiter, has_header), as the options have them or from the beginning of the file.

    The delimiter is the one that cuts most lines alike. The first line is the header unless
    a cell of it is a number; of a file without any numbers only `header` can say otherwise.
    """
    options.check()
    with _open(path, options.encoding) as f:
        sample = f.read(SNIFFED)
    best, merit = options.delimiter or ",", (-1, 0)
    for d in DELIMITERS if options.delimiter is None else ():
        rows = [r for r in csv.reader(io.StringIO(sample), delimiter=d, quotechar=options.quote) if r][:200]
        if not rows:
            continue
        width = len(rows[0])
        alike = sum(len(r) == width for r in rows)
        if width > 1 and (alike, width) > merit:
            best, merit = d, (alike, width)
    if options.header is not None:
        return best, options.header
    rows = [r for r in csv.reader(io.StringIO(sample), delimiter=best, quotechar=options.quote) if r][:200]
    number = re.compile(r"\s*[-+]?\d+(\.\d*)?([eE][-+]?\d+)?\s*$")
    header = bool(rows) and not any(number.match(c) for c in rows[0])
    return best, header


def _records(path: str | bytes, delimiter: str, expected: int, has_header: bool, options: Options = Options()) -> tuple[int, list[dict[str, Any]]]:
    """(records, rejects with their line): the file is bounded by MAX_BYTES, and Spark tells no line numbers."""
    rejects, n = [], 0
    with _open(path, options.encoding) as f:
        reader = csv.reader(f, delimiter=delimiter, quotechar=options.quote)
        if has_header:
            next(reader, None)
        before = reader.line_num
        for row in reader:
            line, before = before + 1, reader.line_num
            if not row:
                continue
            n += 1
            if len(row) != expected:
                rejects.append({"line": line, "column": min(len(row), expected), "error_type": "TOO MANY COLUMNS" if len(row) > expected else "MISSING COLUMNS", "error": f"{len(row)} cells, {expected} expected"})
    return n, rejects


def _conforming(column: str) -> dict[str, Column]:
    """Whether a cell fits a type; leading zeros make a code, not a number."""
    c = name(column)
    trimmed = F.trim(c)
    whole = trimmed.rlike(r"^[-+]?(0|[1-9]\d{0,18})$") & trimmed.try_cast("bigint").isNotNull()
    code = trimmed.rlike(r"^[-+]?0\d")
    return {
        "integer": whole,
        "double": safe_number(trimmed).isNotNull() & ~code,
        "date": safe_timestamp(c).isNotNull() & (F.length(trimmed) <= 10),
        "timestamp": safe_timestamp(c).isNotNull(),
        "boolean": F.lower(trimmed).isin(*TRUE, *FALSE),
    }


def detect_types(df: DataFrame, columns: list[str]) -> tuple[dict[str, str], list[dict[str, Any]]]:
    """The type of each column that all its non-null cells fit, in one pass over all columns, and near misses."""
    counts = [F.count(name(c)).alias(f"{i}|all") for i, c in enumerate(columns)]
    counts += [F.count_if(fits).alias(f"{i}|{kind}") for i, c in enumerate(columns) for kind, fits in _conforming(c).items()]
    got = df.agg(*counts).first().asDict()
    kinds, near = {}, []
    for i, c in enumerate(columns):
        total = got[f"{i}|all"]
        found = {kind: got[f"{i}|{kind}"] for kind in ("integer", "double", "date", "timestamp", "boolean")}
        kinds[c] = next((k for k, n in found.items() if total and n == total), "text")
        best = max(found, key=lambda k: found[k])
        if kinds[c] == "text" and total and found[best] >= NEAR_MISS * total:
            near.append({"column": c, "candidate": best, "conforming": found[best], "total": total})
    return kinds, near


def cast_cell(column: str, kind: str) -> Column:
    c = name(column)
    if kind == "boolean":
        low = F.lower(F.trim(c))
        return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    if kind in ("date", "timestamp"):
        return safe_timestamp(c).cast(TYPES[kind])
    return c if kind == "text" else F.trim(c).try_cast(TYPES[kind])


def read_text_table(spark: SparkSession, path: str, columns: list[str], delimiter: str, has_header: bool, own: Options = Options()) -> DataFrame:
    """All cells as text, one partition in file order; malformed records carry themselves in _corrupt."""
    schema = T.StructType([*(T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))), T.StructField("_corrupt", T.StringType())])
    options = {"sep": delimiter, "header": has_header, "multiLine": True, "quote": own.quote, "escape": own.quote, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "enforceSchema": True, "emptyValue": "", "encoding": ENCODINGS[codecs.lookup(own.encoding).name]}
    return spark.read.schema(schema).options(**options).csv(path)


def import_file(spark: SparkSession, path: str | bytes, out: str, permissive: bool = False, row_limit: int | None = None, options: Options = Options(), shared: str | None = None) -> Report:
    """Read a file of the driver's disk, or its bytes, into a Parquet snapshot at `out`, with _row_id in file order; PlanError where it is refused.

    Executors read it at `shared`, or at the same path if that isn't given.
    """
    size = len(path) if isinstance(path, bytes) else os.path.getsize(path)
    if size > MAX_BYTES:
        raise PlanError("file", "file_too_large", f"{size} bytes, {MAX_BYTES} at most")
    if not size:
        raise PlanError("file", "empty_file", "the file has no bytes")
    try:
        delimiter, has_header = sniff(path, options)
        with _open(path, options.encoding) as f:
            first = next((r for r in csv.reader(f, delimiter=delimiter, quotechar=options.quote) if r), [])
    except UnicodeDecodeError as e:
        raise PlanError("file", "encoding", f"the file is not {options.encoding}: {e.reason}", "give another encoding") from None
    columns = sanitize(first if has_header else [f"column_{i + 1}" for i in range(len(first))])
    if any(c.lower() == ROW_ID for c in columns):
        raise PlanError("file", "reserved_name", f"{ROW_ID} is reserved")
    records, rejects = _records(path, delimiter, len(columns), has_header, options)
    report = Report(delimiter, has_header, rejects=rejects, checksum=checksum(path))
    if not records:
        raise PlanError("file", "empty_file", "the file has no rows")
    if rejects and not permissive:
        raise PlanError("file", "malformed_rows", f"{len(rejects)} rows have other numbers of cells", "mend them or import permissively")
    if row_limit is not None and not 0 < row_limit <= MAX_ROWS:
        raise PlanError("row_limit", "range", f"1 to {MAX_ROWS} rows")
    if records - len(rejects) > MAX_ROWS and row_limit is None:
        raise PlanError("file", "too_many_rows", f"{records} rows, {MAX_ROWS} at most", "give a row_limit")
    read = read_text_table(spark, shared or path, columns, delimiter, has_header, options).cache()  # a cache keeps _corrupt apart from column pruning
    sound = read.where("_corrupt is null").select(F.monotonically_increasing_id().alias("__at"), *(F.when(~name(f"c{i}").isin(*options.null_strings) if options.null_strings else F.lit(True), name(f"c{i}")).alias(c) for i, c in enumerate(columns)))
    # multiLine reads a file in one task, so that the ids of its one partition are dense and in file order
    if row_limit is not None:
        sound = sound.where(F.col("__at") < row_limit)
    kinds, report.coercions = detect_types(sound, columns)
    typed = sound.select(F.col("__at").alias(ROW_ID), *(cast_cell(c, kinds[c]).alias(c) for c in columns))
    typed.write.mode("overwrite").option("compression", "zstd").parquet(out)
    read.unpersist()
    kept = spark.read.parquet(out)
    report.rows = kept.count()
    report.columns = statistics(kept, kinds)
    return report


def statistics(df: DataFrame, kinds: dict[str, str]) -> list[dict[str, Any]]:
    """Of each column nulls, an estimate of distinct values, the longest text and three samples, in one pass."""
    columns = list(kinds)
    aggs = []
    for i, c in enumerate(columns):
        text = name(c).cast("string")
        aggs += [F.count_if(name(c).isNull()).alias(f"{i}n"), F.approx_count_distinct(name(c)).alias(f"{i}d"), F.max(F.length(text)).alias(f"{i}m"), F.min_by(F.substring(text, 1, 80), ROW_ID).alias(f"{i}s")]
    got = df.agg(*aggs).first()
    head = df.orderBy(ROW_ID).limit(50).collect()
    out = []
    for i, c in enumerate(columns):
        samples = list(dict.fromkeys(str(r[c])[:80] for r in head if r[c] is not None))[:3]
        out.append({"name": c, "type": kinds[c], "null_count": got[f"{i}n"], "distinct_estimate": got[f"{i}d"], "max_length": got[f"{i}m"], "samples": samples})
    return out


def preview(spark: SparkSession, path: str, rows: int = 20, options: Options = Options()) -> tuple[list[str], list[list[str | None]]]:
    """(names, first rows) of a file as text; nothing is kept."""
    delimiter, has_header = sniff(path, options)
    with _open(path, options.encoding) as f:
        reader = (r for r in csv.reader(f, delimiter=delimiter, quotechar=options.quote) if r)
        first = next(reader, [])
        head = [] if has_header else [first]
        for r in reader:
            if len(head) >= min(rows, 100):
                break
            head.append(r)
    return sanitize(first if has_header else [f"column_{i + 1}" for i in range(len(first))]), [[None if c in options.null_strings else c for c in r] for r in head]


def checksum(path: str | bytes) -> str:
    if isinstance(path, bytes):
        return hashlib.sha256(path).hexdigest()
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def error_report(report: Report) -> dict[str, str]:
    """The files of a report on an import, by name."""
    out = io.StringIO(newline="")
    w = csv.DictWriter(out, ["line", "column", "error_type", "error"])
    w.writeheader()
    w.writerows(report.rejects)
    return {"rejects.csv": out.getvalue(), "report.json": json.dumps(asdict(report), indent=1)}
