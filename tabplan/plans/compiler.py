"""Plans to lazy DataFrames, a relation for each step and for the review view of each gated filter."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import ExprCompiler
from ..operators.rowids import counted_ids, dense_ids
from ..sources.tables import Resolver, scanned_bytes
from .errors import PlanError
from .relation import ROW_ID, Field, Relation, logical, name
from .spec import Call, Expr, Lit, Plan, Question, Ref, Source, Step, parse_plan

SOURCE, REVIEW = "source", "__review"
#: Statuses that a filter's gate lets pass; of a match, "matched" and "unmatched" are decisions as well.
GOOD, GOOD_MATCH = ("ok", "override"), ("ok", "override", "matched", "unmatched")


class Compiler:
    """compile() gives the relations by step id.

    Nothing runs but where joins and large results get their row ids, and those only if what
    is wanted needs them. Other relations can be run as well; one task numbers their joins.
    """

    def __init__(self, resolver: Resolver, compat_match_gate: bool = False):
        self.resolver, self.good = resolver, GOOD if compat_match_gate else GOOD_MATCH
        self.relations: dict[str, Relation] = {}
        self.numbered: set[str] = set()

    def compile(self, plan: Plan | dict | str, wanted: Iterable[str] | None = None) -> dict[str, Relation]:
        """The relations, of which those wanted, the output if not given, are to be run; with none, no row is read."""
        plan = plan if isinstance(plan, Plan) else parse_plan(plan)
        self.numbered = needing_ids(plan, {plan.output} if wanted is None else set(wanted))
        self.relations = {SOURCE: self.read(plan.source, SOURCE, "plan.source")}
        for i, step in enumerate(plan.steps):
            path = f"steps[{i}]"
            if step.id in self.relations:
                raise PlanError(f"{path}.id", "duplicate_id", f"{step.id!r} is taken")
            if step.input not in self.relations:
                known = ", ".join(self.relations)
                raise PlanError(f"{path}.input", "unknown_input", f"{step.input!r} is no earlier step", f"use one of {known}")
            given = self.relations[step.input]
            self.relations[step.id] = getattr(self, f"_{step.op}")(step, given, path).with_(name=step.id)
        if plan.output not in self.relations:
            raise PlanError("plan.output", "unknown_output", f"{plan.output!r} is no step")
        return self.relations

    def read(self, source: Source, label: str, path: str) -> Relation:
        df = self.resolver.dataset(source.dataset_id, path)
        fields = tuple(Field(f.name, logical(f.dataType), "row_id" if f.name == ROW_ID else "source") for f in df.schema)
        return Relation(label, df, fields, scanned=scanned_bytes(df))

    # ---- helpers

    @staticmethod
    def _known(columns, given: Relation, path: str) -> None:
        for i, c in enumerate(columns):
            if c not in given.names:
                raise PlanError(f"{path}[{i}]", "unknown_column", f"column {c!r} does not exist in {given.name!r}", f"use one of {', '.join(given.names[:30])}")

    @staticmethod
    def _fresh(names: list[str], path: str, code: str = "column_conflict") -> None:
        seen: set[str] = set()
        for n in names:
            if n.lower() in seen:
                raise PlanError(path, code, f"column {n!r} would stand twice", "choose another name or prefix")
            seen.add(n.lower())

    def _statuses(self, given: Relation, columns: set[str]) -> list[str]:
        return sorted({given.gates[c] for c in columns if c in given.gates})

    # ---- exact steps

    def _filter(self, step: Step, given: Relation, path: str) -> Relation:
        compiler = ExprCompiler(given, f"{path}.where")
        keep = compiler.compile(step.where)  # a filter drops null as it does false, and bare conditions are pushed down to the scan
        statuses = self._statuses(given, compiler.referenced)
        if not statuses or step.unknown_policy == "include":
            return given.with_(df=given.df.where(keep))
        good = reduce(lambda a, b: a & b, [F.coalesce(name(s).isin(*self.good), F.lit(False)) for s in statuses])
        if step.unknown_policy == "separate":
            near = [F.coalesce(name(n), F.lit(False)) for s in statuses for n in [s.removesuffix(".status") + ".near"] if n in given.names]
            doubtful = reduce(lambda a, b: a | b, near, ~good)
            self.relations[step.id + REVIEW] = given.with_(df=given.df.where(doubtful), name=step.id + REVIEW)
        return given.with_(df=given.df.where(keep).where(good))

    def _sort(self, step: Step, given: Relation, path: str) -> Relation:
        self._known([c for c, _ in step.by], given, f"{path}.by")
        tie = () if any(c == ROW_ID for c, _ in step.by) else ((ROW_ID, False),)
        return given.with_(ordering=(*step.by, *tie))

    def _project(self, step: Step, given: Relation, path: str) -> Relation:
        self._known(step.columns, given, f"{path}.columns")
        self._fresh(list(step.columns), f"{path}.columns")
        listed = list(step.columns) if ROW_ID in step.columns else [ROW_ID, *step.columns]
        by_name = {f.name: f for f in given.fields}
        # sort keys that go out of sight are carried along under names of their own
        hidden = {c: f"__order_{i}" for i, (c, _) in enumerate(given.ordering) if c not in listed}
        df = given.df.select(*map(name, listed), *(name(c).alias(h) for c, h in hidden.items()))
        gates = {c: s for c, s in given.gates.items() if c in listed and s in listed}
        return given.with_(df=df, fields=tuple(by_name[c] for c in listed), gates=gates, ordering=tuple((hidden.get(c, c), d) for c, d in given.ordering))

    def _compute(self, step: Step, given: Relation, path: str) -> Relation:
        columns, fields, gates = [], [], dict(given.gates)
        for i, (out, expr) in enumerate(step.columns):
            compiler = ExprCompiler(given, f"{path}.columns[{i}].expr")
            column = compiler.compile(expr)
            columns.append(column.alias(out))
            fields.append(Field(out, logical(compiler.kind(column)), "derived"))
            if len(statuses := self._statuses(given, compiler.referenced)) == 1:
                gates[out] = statuses[0]
        self._fresh([*given.names, *(f.name for f in fields)], f"{path}.columns")
        return given.with_(df=given.df.select("*", *columns), fields=(*given.fields, *fields), gates=gates)

    def _aggregate(self, step: Step, given: Relation, path: str) -> Relation:
        self._known(step.group_by, given, f"{path}.group_by")
        self._fresh([*step.group_by, *(m[0] for m in step.metrics), ROW_ID], f"{path}.metrics")
        metrics = []
        for i, (out, fn, column) in enumerate(step.metrics):
            if column is not None:
                self._known([column], given, f"{path}.metrics[{i}].column")
            metrics.append(metric(given.df, fn, column).alias(out))
        made = given.df.groupBy(*map(name, step.group_by)).agg(*metrics)
        kinds = {f.name: f.dataType for f in made.schema}
        fields = [Field(ROW_ID, "integer", "row_id"), *(Field(c, logical(kinds[c]), "group") for c in step.group_by), *(Field(m, logical(kinds[m]), "metric") for m, _, _ in step.metrics)]
        return self._renumbered(step.id, given, made, fields, [name(c).asc_nulls_last() for c in step.group_by] or [F.lit("")])

    def _renumbered(self, step: str, given: Relation, df: DataFrame, fields: list[Field], order: list[Column]) -> Relation:
        numbered = dense_ids(df, order, given.scanned if step in self.numbered else 0).select(*(name(f.name) for f in fields))
        return Relation(given.name, numbered, tuple(fields), pending=given.pending, row_preserving=False, scanned=given.scanned)

    def _distinct(self, step: Step, given: Relation, path: str) -> Relation:
        listed = list(step.columns) if step.columns else [c for c in given.names if c != ROW_ID]
        self._known(listed, given, f"{path}.columns")
        self._fresh(listed, f"{path}.columns")
        listed = [c for c in listed if c != ROW_ID] or listed
        by_name = {f.name: f for f in given.fields}
        made = given.df.select(*map(name, listed)).distinct()
        return self._renumbered(step.id, given, made, [Field(ROW_ID, "integer", "row_id"), *(by_name[c] for c in listed if c != ROW_ID)], [name(c).asc_nulls_last() for c in listed])

    def _limit(self, step: Step, given: Relation, path: str) -> Relation:
        return given.with_(df=given.df.orderBy(*given.order()).limit(step.n))

    def _join(self, step: Step, given: Relation, path: str) -> Relation:
        if isinstance(step.right, Source):
            right = self.read(step.right, step.right.dataset_id, f"{path}.right")
        elif step.right in self.relations:
            right = self.relations[step.right]
        else:
            raise PlanError(f"{path}.right", "unknown_input", f"{step.right!r} is no earlier step or review view")
        self._known([left for left, _ in step.on], given, f"{path}.on")
        self._known([r for _, r in step.on], right, f"{path}.on")
        taken = [c for c in right.names if c != ROW_ID] if step.right_columns is None else list(step.right_columns)
        self._known(taken, right, f"{path}.right_columns")
        kept = [f for f in given.fields if f.name != ROW_ID]
        by_name = {f.name: f for f in right.fields}
        fields = [Field(ROW_ID, "integer", "row_id"), Field("left_row_id", "integer", "source"), *kept, *(Field(step.right_prefix + c, by_name[c].type, "right") for c in taken)]
        self._fresh([f.name for f in fields], path)
        r = right.df.select(name(ROW_ID).alias("__right_id"), *(name(c).alias(f"__key_{i}") for i, (_, c) in enumerate(step.on)), *(name(c).alias(f"__right_{i}") for i, c in enumerate(taken)))
        left = given.df.select(name(ROW_ID).alias("left_row_id"), *(name(f.name) for f in kept))
        on = reduce(lambda a, b: a & b, [name(lc if lc != ROW_ID else "left_row_id") == F.col(f"__key_{i}") for i, (lc, _) in enumerate(step.on)])
        met = left.join(r, on, step.how)
        made = met.select("left_row_id", "__right_id", *(name(f.name) for f in kept), *(F.col(f"__right_{i}").alias(step.right_prefix + c) for i, c in enumerate(taken)))
        scanned, order = given.scanned + right.scanned, [F.col("left_row_id").asc(), F.col("__right_id").asc_nulls_last()]
        if step.id in self.numbered:  # a join may make any number of rows
            made, n = counted_ids(made, order)
            scanned = max(scanned, 8 * n * len(fields))
        else:
            made = dense_ids(made, order, 0)
        numbered = made.select(*(name(f.name) for f in fields))
        gates = {c: s for c, s in given.gates.items() if c != ROW_ID}
        return Relation(step.id, numbered, tuple(fields), gates=gates, pending=given.pending | right.pending, row_preserving=False, scanned=scanned)

    # ---- semantic steps

    def _needs_rows(self, given: Relation, path: str) -> None:
        if not given.row_preserving:
            raise PlanError(path, "needs_rows", "a semantic step needs the source's rows", "put it before aggregate, join and distinct")

    def _override(self, column: str) -> DataFrame | None:
        found = self.resolver.overrides
        if found is None:
            return None
        # of several overrides of one cell the last stands
        return found.where(F.col("column") == column).groupBy(F.col("row_id").cast("bigint").alias("__oid")).agg(F.max_by("value", "seq").alias("__value"))

    def _semantic_annotate(self, step: Step, given: Relation, path: str) -> Relation:
        self._needs_rows(given, path)
        self._known(step.columns, given, f"{path}.columns")
        outputs = [o for q in step.questions for o in q.outputs()]
        fields = [Field(n, t, "semantic") for n, t in outputs]
        self._fresh([*given.names, *(f.name for f in fields)], f"{path}.questions")
        df = self._with_answers(step.id, given.df, outputs)
        for q in step.questions:
            df = self._with_overrides(df, q)
        gates = {**given.gates, **{n: f"{q.name}.status" for q in step.questions for n, _ in q.outputs() if not n.endswith(".status")}}
        return given.with_(df=df, fields=(*given.fields, *fields), gates=gates, pending=given.pending | self._open(step))

    def _open(self, step: Step) -> set[str]:
        return set() if step.id in self.resolver.complete else {step.id}

    def _with_answers(self, step_id: str, df: DataFrame, outputs: list[tuple[str, str]]) -> DataFrame:
        kinds = {"boolean": "boolean", "double": "double", "text": "string", "integer": "bigint"}
        answers = self.resolver.answers.get(step_id)
        status = lambda n, c: F.coalesce(c, F.lit("pending")) if n.endswith(".status") else c
        if answers is None:
            return df.select("*", *(status(n, F.lit(None).cast(kinds[t])).alias(n) for n, t in outputs))
        have = set(answers.columns)
        keyed = answers.select(name(ROW_ID).alias("__aid"), *((name(n) if n in have else F.lit(None)).cast(kinds[t]).alias(f"__a_{i}") for i, (n, t) in enumerate(outputs)))
        met = df.join(keyed, name(ROW_ID) == F.col("__aid"), "left")
        return met.select(*map(name, df.columns), *(status(n, F.col(f"__a_{i}")).alias(n) for i, (n, _) in enumerate(outputs)))

    def _with_overrides(self, df: DataFrame, q: Question) -> DataFrame:
        column = f"{q.name}.value"
        overrides = self._override(column)
        if overrides is None:
            return df
        kind = df.schema[column].dataType
        met = df.join(overrides, name(ROW_ID) == F.col("__oid"), "left")
        is_set = F.col("__oid").isNotNull()
        value = F.when(is_set, F.col("__value").try_cast(kind)).otherwise(name(column))
        status = F.when(is_set, F.lit("override")).otherwise(name(f"{q.name}.status"))
        replaced = {column: value, f"{q.name}.status": status}
        return met.select(*(replaced[c].alias(c) if c in replaced else name(c) for c in df.columns))

    def _semantic_match(self, step: Step, given: Relation, path: str) -> Relation:
        self._needs_rows(given, path)
        self._known(step.left_columns, given, f"{path}.left_columns")
        right = self.read(step.right, step.right.dataset_id, f"{path}.right")
        self._known(step.right_columns, right, f"{path}.right_columns")
        taken = [c for c in right.names if c != ROW_ID] if step.right_output_columns is None else list(step.right_output_columns)
        self._known(taken, right, f"{path}.right_output_columns")
        outputs = [(f"{step.name}.{n}", t) for n, t in (("right_row_id", "integer"), ("score", "double"), ("near", "boolean"), ("status", "text"), ("candidates", "text"))]
        by_name = {f.name: f for f in right.fields}
        fields = [*(Field(n, t, "semantic") for n, t in outputs), *(Field(step.right_prefix + c, by_name[c].type, "right") for c in taken)]
        self._fresh([*given.names, *(f.name for f in fields)], path)
        df = self._with_answers(step.id, given.df, outputs)
        before = df.columns
        accepted = right.df.select(name(ROW_ID).alias("__rid"), *(name(c).alias(f"__r_{i}") for i, c in enumerate(taken)))
        met = df.join(accepted, name(f"{step.name}.right_row_id") == F.col("__rid"), "left")
        df = met.select(*map(name, before), *(F.col(f"__r_{i}").alias(step.right_prefix + c) for i, c in enumerate(taken)))
        status = f"{step.name}.status"
        gates = {**given.gates, **{f.name: status for f in fields if f.name != status}}
        return given.with_(df=df, fields=(*given.fields, *fields), gates=gates, pending=given.pending | self._open(step))


def needing_ids(plan: Plan, wanted: set[str]) -> set[str]:
    """The steps whose row ids play a part in the wanted relations."""
    live = {w.removesuffix(REVIEW) for w in wanted}
    need = set(live)
    named = any(f'"{c}"' in json.dumps(plan.raw) for c in (ROW_ID, "left_row_id"))
    for step in reversed(plan.steps):
        if step.id not in live:
            continue
        inputs = {step.input, *([step.right.removesuffix(REVIEW)] if step.op == "join" and isinstance(step.right, str) else [])}
        live |= inputs
        if step.op not in ("aggregate", "distinct") and (step.id in need or step.op == "limit") or step.op.startswith("semantic_") or named:
            need |= inputs
    return need


def metric(df: DataFrame, fn: str, column: str | None) -> Column:
    """An aggregate that ignores nulls; booleans count as 0 and 1 in sums, and sums of whole numbers stay whole."""
    if column is None:
        return F.count(F.lit(1))
    c = name(column)
    if fn in ("sum", "avg") and isinstance(df.schema[column].dataType, T.BooleanType):
        c = c.cast("bigint")
    return {"count": F.count, "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[fn](c)


def references(e: Expr) -> set[str]:
    if isinstance(e, Ref):
        return {e.column}
    return set() if isinstance(e, Lit) else set().union(*map(references, e.args)) if isinstance(e, Call) and e.args else set()


def run_plan(plan: Plan | dict | str, resolver: Resolver) -> DataFrame:
    """The output relation's visible columns, sorted as the plan says."""
    plan = plan if isinstance(plan, Plan) else parse_plan(plan)
    return Compiler(resolver).compile(plan)[plan.output].ordered()
