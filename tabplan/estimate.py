"""What a plan would do, before it runs: schemas of all steps, sampled cost, warnings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from math import ceil
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.annotate import cache_key, payload
from .operators.judge import ITEM_TOKENS, REQUEST_TOKENS, estimated_tokens, tokens_of
from .operators.match import MAX_PAIRS
from .plans.compiler import SOURCE, Compiler
from .plans.errors import PlanError
from .plans.relation import ROW_ID, Relation, name
from .plans.spec import Plan, Step, parse_plan
from .results import SAMPLE, Bounds, bounded_page
from .sources.tables import Resolver
from .streaming.jobs import Limits

#: Rows of the sample, the tokens of a pair and of each of its columns, and a route's rates.
SAMPLE_ROWS, SAMPLE_SEED = 120, 3
PAIR_TOKENS, PAIR_COLUMN_TOKENS = 120, 40
REQUESTS_PER_MINUTE, TOKENS_PER_SECOND = 1_200, 250_000


@dataclass
class Estimate:
    source_rows: int = 0
    semantic_rows: int = 0
    attempts: int = 0
    requests: int = 0
    input_tokens: int = 0
    cost_usd: float = 0.0
    pairs: int = 0
    cache_hits: int = 0
    floor_seconds: float = 0.0
    stages: list[dict[str, Any]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def sample(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """`rows` rows by hash of their id: the same ones for one seed, and exactly so many if there are."""
    return df.orderBy(F.xxhash64(name(ROW_ID), F.lit(seed)), name(ROW_ID)).limit(rows)


def head(df: DataFrame, rows: int = 20) -> DataFrame:
    return df.orderBy(name(ROW_ID)).limit(rows)


def bounded_head(relation: Relation, bounds: Bounds = SAMPLE) -> list[dict[str, Any]]:
    """The first rows, as many as the bounds of a sample allow."""
    return bounded_page(relation, sort=[(ROW_ID, False)], bounds=bounds)["rows"]


def _settled(plan: Plan, relations: dict[str, Relation], step: Step) -> tuple[Relation, str]:
    """The step's input, or its nearest ancestor that no pending stage feeds, whose rows bound it."""
    inputs, at = {s.id: s.input for s in plan.steps}, step.input
    while relations[at].pending and at != SOURCE:
        at = inputs[at]
    return relations[at], "exact" if at == step.input else "upper_bound"


def _annotate_stage(step: Step, given: Relation, rows: int, limits: Limits, cache: DataFrame | None, model: str) -> dict[str, Any]:
    known = [c for c in step.columns if c in given.names]
    picked = sample(given.df, SAMPLE_ROWS, SAMPLE_SEED)
    text, missing = payload(picked, known or [ROW_ID])
    asked = sum(tokens_of(json.dumps(q.signature())) + ITEM_TOKENS for q in step.questions)
    texts = picked.select(text.alias("t"), missing.alias("m"))
    mean = (texts.agg(F.avg(estimated_tokens(F.col("t")))).first()[0] or 60.0) + asked
    ratio = 0.0
    if cache is not None:
        keys = texts.where("not m").select(F.explode(F.array(*(cache_key(F.col("t"), q, model, "default") for q in step.questions))).alias("key"))
        total = keys.count()
        ratio = keys.join(cache, "key", "left_semi").count() / total if total else 0.0
    attempts = rows * len(step.questions)
    hits = round(attempts * ratio)
    sent = rows * (1 - ratio)
    requests = ceil(sent / limits.rows_per_request)
    return {"kind": "annotate", "attempts": attempts - hits, "cache_hits": hits, "requests": requests, "tokens": int(sent * mean + requests * REQUEST_TOKENS), "mean_tokens": round(mean, 1), "pairs": 0}


def _match_stage(step: Step, resolver: Resolver, rows: int, limits: Limits, warnings: list[str]) -> dict[str, Any]:
    right = resolver.dataset(step.right.dataset_id, f"{step.id}.right").count()
    pairs = rows * step.candidates_per_row
    if pairs > MAX_PAIRS:
        warnings.append(f"step {step.id!r}: {pairs} pairs, {MAX_PAIRS} at most; the job will end as partial")
    pairs = min(pairs, MAX_PAIRS)
    each = PAIR_TOKENS + PAIR_COLUMN_TOKENS * (len(step.left_columns) + len(step.right_columns))
    return {"kind": "match", "right_rows": right, "attempts": pairs, "cache_hits": 0, "requests": ceil(pairs / limits.rows_per_request), "tokens": pairs * each, "pairs": pairs}


def estimate(plan: Plan | dict | str, resolver: Resolver, limits: Limits = Limits(), cache: DataFrame | None = None, routes: int = 1) -> Estimate:
    plan = plan if isinstance(plan, Plan) else parse_plan(plan)
    relations = Compiler(resolver).compile(plan, ())
    found = Estimate(source_rows=relations[SOURCE].df.count())
    for step in plan.steps:
        if not step.op.startswith("semantic_"):
            continue
        given, bound = _settled(plan, relations, step)
        total = given.df.count()
        rows = total if limits.max_source_rows is None else min(total, limits.max_source_rows)
        if total > rows:
            found.warnings.append(f"step {step.id!r}: {total} rows, {rows} at most; the job will end as partial")
        stage = _annotate_stage(step, given, rows, limits, cache, plan.model) if step.op == "semantic_annotate" else _match_stage(step, resolver, rows, limits, found.warnings)
        found.stages.append({"step": step.id, "rows": rows, "bound": bound, **stage})
        found.semantic_rows = max(found.semantic_rows, rows)
        found.attempts += stage["attempts"]
        found.requests += stage["requests"]
        found.input_tokens += stage["tokens"]
        found.pairs += stage["pairs"]
        found.cache_hits += stage["cache_hits"]
    found.cost_usd = round(found.input_tokens / 1e6 * limits.usd_per_million_tokens, 6)
    if found.requests:
        found.floor_seconds = round(max(found.input_tokens / (TOKENS_PER_SECOND * routes), found.requests / (REQUESTS_PER_MINUTE / 60 * routes)), 2)
    if limits.spend_target_usd is not None and found.cost_usd > limits.spend_target_usd:
        found.warnings.append(f"the cost of ${found.cost_usd:.4f} is above the target of ${limits.spend_target_usd:.2f}")
    if limits.max_provider_requests is not None and found.requests > limits.max_provider_requests:
        found.warnings.append(f"{found.requests} requests, {limits.max_provider_requests} at most")
    if not found.stages:
        found.warnings.append("no semantic steps: nothing is asked of a judge")
    return found


def validate(plan: Plan | dict | str, resolver: Resolver, limits: Limits = Limits()) -> dict[str, Any]:
    """{valid, issues} or {valid, plan, steps, estimate}: all steps are bound to types, no row is read but for the estimate."""
    try:
        parsed = plan if isinstance(plan, Plan) else parse_plan(plan)
        relations = Compiler(resolver).compile(parsed, ())
        steps = {n: [{"name": f.name, "type": f.type, "role": f.role} for f in r.fields] for n, r in relations.items()}
        return {"valid": True, "plan": parsed.digest(), "steps": steps, "estimate": asdict(estimate(parsed, resolver, limits))}
    except PlanError as e:
        return {"valid": False, "issues": [e.as_dict()]}
