"""Plans as JSON: checked field by field and turned into frozen dataclasses."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from typing import Any

from .errors import PlanError

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}")
MAX_STEPS, MAX_LIMIT = 32, 1_000_000
# Fixed values of the plan language: its operators, metrics and policies.
OPERATORS = (
    "eq", "ne", "gt", "gte", "lt", "lte", "and", "or", "not", "contains", "icontains", "starts_with", "ends_with", "in", "is_null", "not_null",
    "add", "sub", "mul", "div", "coalesce", "lower", "upper", "length", "trim", "year", "month", "date", "to_number", "replace", "case",
)
METRICS = ("count", "count_distinct", "sum", "avg", "min", "max")
POLICIES = ("separate", "exclude", "include")
KINDS = ("boolean", "category", "score")


@dataclass(frozen=True)
class Ref:
    """A column in an expression."""

    column: str


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple[Any, ...]


Expr = Ref | Lit | Call


@dataclass(frozen=True)
class Source:
    dataset_id: str
    version_id: str | None = None


@dataclass(frozen=True)
class Question:
    name: str
    kind: str
    instruction: str
    criteria: dict[str, str] | None = None
    mode: str = "auto"
    true_min: float = 0.85
    false_max: float = 0.15
    options: dict[str, str | None] | None = None
    min_confidence: float = 0.0
    levels: tuple[str, ...] | None = None

    def outputs(self) -> list[tuple[str, str]]:
        third = ("near", "boolean") if self.kind == "boolean" else ("confidence", "double")
        value = "boolean" if self.kind == "boolean" else "text"
        return [(f"{self.name}.{n}", t) for n, t in (("value", value), ("score", "double"), third, ("status", "text"))]

    def signature(self) -> dict[str, Any]:
        """What an answer depends on: neither the name nor any threshold."""
        return {"kind": self.kind, "instruction": self.instruction, "criteria": self.criteria, "options": self.options, "levels": list(self.levels) if self.levels else None}


@dataclass(frozen=True)
class Step:
    id: str
    op: str
    input: str
    body: dict[str, Any] = field(hash=False)

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["body"][name]
        except KeyError:
            raise AttributeError(name) from None


@dataclass(frozen=True)
class Plan:
    source: Source
    steps: tuple[Step, ...]
    output: str
    model: str = "rules-1"
    title: str | None = None
    description: str | None = None
    raw: dict[str, Any] = field(default_factory=dict, hash=False, compare=False)

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.raw, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _need(ok: bool, path: str, code: str, message: str, fix: str = "") -> None:
    if not ok:
        raise PlanError(path, code, message, fix)


def _fields(value: Any, path: str, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict[str, Any]:
    _need(isinstance(value, dict), path, "type", "an object is expected")
    unknown = sorted(set(value) - {*required, *optional})
    _need(not unknown, path, "unknown_key", f"unknown key {unknown[0] if unknown else ''!r}", f"use {', '.join((*required, *optional))}")
    for name in required:
        _need(name in value, f"{path}.{name}", "missing", "a value is required")
    return value


def _name(value: Any, path: str) -> str:
    _need(isinstance(value, str) and NAME.fullmatch(value) is not None, path, "name", f"{value!r} is not a name", "letters, digits and _, 64 at most, no digit first")
    return value


def _texts(value: Any, path: str, least: int, most: int | None = None) -> tuple[str, ...]:
    _need(isinstance(value, list) and all(isinstance(x, str) for x in value), path, "type", "a list of texts is expected")
    _need(least <= len(value) and (most is None or len(value) <= most), path, "length", f"{least} to {most or 'any number of'} entries are expected, not {len(value)}")
    return tuple(value)


def _number(value: Any, path: str, low: float, high: float, whole: bool = False) -> Any:
    kinds = int if whole else (int, float)
    _need(isinstance(value, kinds) and not isinstance(value, bool) and low <= value <= high, path, "range", f"a number from {low} to {high} is expected")
    return value


def _choice(value: Any, path: str, of: tuple[str, ...]) -> str:
    _need(value in of, path, "choice", f"{value!r} is none of {', '.join(of)}")
    return value


def parse_expr(value: Any, path: str) -> Expr:
    _need(isinstance(value, dict), path, "type", "an expression is an object")
    if "column" in value:
        _fields(value, path, ("column",))
        _need(isinstance(value["column"], str), path, "type", "a column is named by a text")
        return Ref(value["column"])
    if "literal" in value:
        _fields(value, path, ("literal",))
        lit = value["literal"]
        scalar = lambda x: x is None or isinstance(x, (str, int, float, bool))
        _need(scalar(lit) or isinstance(lit, list) and all(map(scalar, lit)), path, "type", "a literal is a scalar or a list of scalars")
        return Lit(tuple(lit) if isinstance(lit, list) else lit)
    _fields(value, path, ("op",), ("args",))
    _need(value["op"] in OPERATORS, path, "unknown_op", f"unsupported operator {value['op']!r}")
    args = value.get("args", [])
    _need(isinstance(args, list), f"{path}.args", "type", "a list is expected")
    return Call(value["op"], tuple(parse_expr(a, f"{path}.args[{i}]") for i, a in enumerate(args)))


def _source(value: Any, path: str) -> Source:
    v = _fields(value, path, ("dataset_id",), ("version_id",))
    return Source(v["dataset_id"], v.get("version_id"))


def _criteria(value: Any, path: str) -> dict[str, str] | None:
    if value is not None:
        _fields(value, path, (), ("true", "false"))
    return value


def parse_question(value: Any, path: str) -> Question:
    v = _fields(value, path, ("name", "kind", "instruction"), ("criteria", "thresholds", "options", "min_confidence", "levels"))
    kind = _choice(v["kind"], f"{path}.kind", KINDS)
    text = v["instruction"]
    _need(isinstance(text, str) and 3 <= len(text) <= 4000, f"{path}.instruction", "length", "3 to 4000 characters are expected")
    t = _fields(v.get("thresholds", {}), f"{path}.thresholds", (), ("mode", "true_min", "false_max"))
    mode = _choice(t.get("mode", "auto"), f"{path}.thresholds.mode", ("auto", "fixed"))
    low, high = (_number(t.get(n, d), f"{path}.thresholds.{n}", 0, 1) for n, d in (("false_max", 0.15), ("true_min", 0.85)))
    _need(low <= high, f"{path}.thresholds", "order", "false_max is above true_min")
    options, levels = v.get("options"), v.get("levels")
    if kind == "category":
        _need(isinstance(options, dict) and 2 <= len(options) <= 255, f"{path}.options", "length", "2 to 255 options are expected")
    if kind == "score":
        levels = _texts(levels, f"{path}.levels", 2, 10)
    confidence = _number(v.get("min_confidence", 0.0), f"{path}.min_confidence", 0, 1)
    return Question(_name(v["name"], f"{path}.name"), kind, text, _criteria(v.get("criteria"), f"{path}.criteria"), mode, high, low, options, confidence, tuple(levels) if levels else None)


def _keys(value: Any, path: str) -> list[tuple[str, str]]:
    _need(isinstance(value, list) and value, path, "length", "a key at least is expected")
    return [(k["left"], k["right"]) for i, x in enumerate(value) for k in [_fields(x, f"{path}[{i}]", ("left", "right"))]]


def _filter(v: dict, p: str) -> dict:
    return {"where": parse_expr(v["where"], f"{p}.where"), "unknown_policy": _choice(v.get("unknown_policy", "separate"), f"{p}.unknown_policy", POLICIES)}


def _sort(v: dict, p: str) -> dict:
    _need(isinstance(v["by"], list) and v["by"], f"{p}.by", "length", "a key at least is expected")
    by = [_fields(k, f"{p}.by[{i}]", ("column",), ("direction",)) for i, k in enumerate(v["by"])]
    return {"by": [(k["column"], _choice(k.get("direction", "asc"), f"{p}.by[{i}].direction", ("asc", "desc")) == "desc") for i, k in enumerate(by)]}


def _compute(v: dict, p: str) -> dict:
    _need(isinstance(v["columns"], list) and v["columns"], f"{p}.columns", "length", "a column at least is expected")
    found = [_fields(c, f"{p}.columns[{i}]", ("name", "expr")) for i, c in enumerate(v["columns"])]
    return {"columns": [(c["name"], parse_expr(c["expr"], f"{p}.columns[{i}].expr")) for i, c in enumerate(found)]}


def parse_metrics(value: Any, p: str) -> list[tuple[str, str, str | None]]:
    _need(isinstance(value, list) and value, p, "length", "a metric at least is expected")
    out = []
    for i, x in enumerate(value):
        m = _fields(x, f"{p}[{i}]", ("name", "fn"), ("column",))
        fn, column = _choice(m["fn"], f"{p}[{i}].fn", METRICS), m.get("column")
        _need(column is not None or fn == "count", f"{p}[{i}]", "metric_column", f"{fn} needs a column")
        out.append((m["name"], fn, column))
    return out


def _aggregate(v: dict, p: str) -> dict:
    return {"group_by": _texts(v.get("group_by", []), f"{p}.group_by", 0), "metrics": parse_metrics(v["metrics"], f"{p}.metrics")}


def _join(v: dict, p: str) -> dict:
    right = v["right"] if isinstance(v["right"], str) else _source(v["right"], f"{p}.right")
    columns = v.get("right_columns")
    return {"right": right, "on": _keys(v["on"], f"{p}.on"), "how": _choice(v.get("how", "inner"), f"{p}.how", ("inner", "left")), "right_columns": None if columns is None else _texts(columns, f"{p}.right_columns", 0), "right_prefix": v.get("right_prefix", "right.")}


def _match(v: dict, p: str) -> dict:
    blocking = v.get("blocking")
    text = v["instruction"]
    _need(isinstance(text, str) and 3 <= len(text) <= 4000, f"{p}.instruction", "length", "3 to 4000 characters are expected")
    columns = v.get("right_output_columns")
    return {
        "name": _name(v.get("name", "match"), f"{p}.name"), "right": _source(v["right"], f"{p}.right"),
        "left_columns": _texts(v["left_columns"], f"{p}.left_columns", 1, 8), "right_columns": _texts(v["right_columns"], f"{p}.right_columns", 1, 8),
        "instruction": text, "criteria": _criteria(v.get("criteria"), f"{p}.criteria"),
        "candidates_per_row": _number(v.get("candidates_per_row", 5), f"{p}.candidates_per_row", 1, 5, True),
        "blocking": None if blocking is None else _keys([blocking], f"{p}.blocking")[0],
        "threshold_mode": _choice(v.get("threshold_mode", "auto"), f"{p}.threshold_mode", ("auto", "fixed")),
        "accept_min": _number(v.get("accept_min", 0.8), f"{p}.accept_min", 0, 1), "reject_max": _number(v.get("reject_max", 0.3), f"{p}.reject_max", 0, 1),
        "right_output_columns": None if columns is None else _texts(columns, f"{p}.right_output_columns", 0), "right_prefix": v.get("right_prefix", "match."),
    }


def _annotate(v: dict, p: str) -> dict:
    _need(isinstance(v["questions"], list) and 1 <= len(v["questions"]) <= 16, f"{p}.questions", "length", "1 to 16 questions are expected")
    return {"columns": _texts(v["columns"], f"{p}.columns", 1, 12), "questions": [parse_question(q, f"{p}.questions[{i}]") for i, q in enumerate(v["questions"])], "on_missing": _choice(v.get("on_missing", "unknown"), f"{p}.on_missing", ("unknown", "skip")), "white_space": _choice(v.get("white_space", "unicode"), f"{p}.white_space", ("unicode", "ascii"))}


#: Of each step its required and optional fields and what reads them.
STEPS = {
    "filter": (("where",), ("unknown_policy",), _filter),
    "sort": (("by",), (), _sort),
    "project": (("columns",), (), lambda v, p: {"columns": _texts(v["columns"], f"{p}.columns", 1)}),
    "compute": (("columns",), (), _compute),
    "aggregate": (("metrics",), ("group_by",), _aggregate),
    "join": (("right", "on"), ("how", "right_columns", "right_prefix"), _join),
    "distinct": ((), ("columns",), lambda v, p: {"columns": None if v.get("columns") is None else _texts(v["columns"], f"{p}.columns", 1)}),
    "limit": (("n",), (), lambda v, p: {"n": _number(v["n"], f"{p}.n", 1, MAX_LIMIT, True)}),
    "semantic_annotate": (("columns", "questions"), ("on_missing", "white_space"), _annotate),
    "semantic_match": (("right", "left_columns", "right_columns", "instruction"), ("name", "criteria", "candidates_per_row", "blocking", "threshold_mode", "accept_min", "reject_max", "right_output_columns", "right_prefix"), _match),
}


def parse_step(value: Any, path: str) -> Step:
    _need(isinstance(value, dict), path, "type", "a step is an object")
    op = _choice(value.get("op"), f"{path}.op", tuple(STEPS))
    required, optional, read = STEPS[op]
    _fields(value, path, ("id", "op", "input", *required), optional)
    return Step(_name(value["id"], f"{path}.id"), op, value["input"], read(value, path))


def parse_plan(value: Any) -> Plan:
    """A plan of a dict or a JSON text; PlanError names the first thing wrong with it."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError as e:
            raise PlanError("plan", "json", str(e)) from None
    v = _fields(value, "plan", ("source", "steps", "output"), ("plan_version", "model", "title", "description"))
    _need(v.get("plan_version", "1") == "1", "plan.plan_version", "choice", "the version is '1'")
    _need(isinstance(v["steps"], list) and 1 <= len(v["steps"]) <= MAX_STEPS, "plan.steps", "length", f"1 to {MAX_STEPS} steps are expected")
    for name, most in (("title", 200), ("description", 2000)):
        _need(len(v.get(name) or "") <= most, f"plan.{name}", "length", f"{most} characters at most")
    steps = tuple(parse_step(s, f"steps[{i}]") for i, s in enumerate(v["steps"]))
    return Plan(_source(v["source"], "plan.source"), steps, v["output"], v.get("model", "rules-1"), v.get("title"), v.get("description"), v)
