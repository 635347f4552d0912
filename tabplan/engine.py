"""Plans run at once: every semantic stage answered, calibrated and kept before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .operators.annotate import annotate
from .operators.calibrate import calibrate_boolean, calibrate_match
from .operators.judge import Judge
from .operators.match import match
from .plans.compiler import Compiler
from .plans.relation import Relation
from .plans.spec import Plan, parse_plan
from .sources.tables import Resolver, materialize


def answer_all(plan: Plan | dict | str, resolver: Resolver, judge: Judge) -> dict[str, Relation]:
    """The plan's relations with all answers; a stage is a barrier, so that no judge is asked twice."""
    plan = plan if isinstance(plan, Plan) else parse_plan(plan)
    found = Resolver(resolver.datasets, dict(resolver.answers), set(resolver.complete), resolver.overrides)
    for step in plan.steps:
        if not step.op.startswith("semantic_") or step.id in found.complete:
            continue
        given = Compiler(found).compile(plan, {step.input})[step.input]
        if step.op == "semantic_annotate":
            answers = materialize(annotate(given.visible(), step, judge, plan.model).answers)
            for q in step.questions:
                if q.kind == "boolean":
                    answers, _ = calibrate_boolean(answers, q.name, q.mode)
        else:
            right = found.dataset(step.right.dataset_id, f"{step.id}.right")
            answers, _ = calibrate_match(materialize(match(given.visible(), right, step, judge)), step.name, step.threshold_mode)
        found.answers[step.id] = answers
        found.complete.add(step.id)
    return Compiler(found).compile(plan)


def run(plan: Plan | dict | str, resolver: Resolver, judge: Judge) -> DataFrame:
    """The output's visible columns in the plan's order."""
    plan = plan if isinstance(plan, Plan) else parse_plan(plan)
    return answer_all(plan, resolver, judge)[plan.output].ordered()
