"""Plans from requests in words: a model drafts one, and hears what is wrong with it until it is right."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .estimate import bounded_head, validate
from .plans.compiler import Compiler
from .plans.errors import PlanError
from .plans.spec import KINDS, METRICS, OPERATORS, POLICIES, STEPS, Plan, Source, parse_plan
from .sources.tables import Resolver
from .streaming.jobs import Limits

ATTEMPTS = 3

#: A conversation in, the model's next words out.
Model = Callable[[list[dict[str, str]]], str]


@dataclass
class Draft:
    plan: Plan | None = None
    attempts: int = 0
    issues: list[dict[str, str]] = field(default_factory=list)  # of the last draft
    estimate: dict[str, Any] | None = None


def language() -> str:
    """What a plan may be made of, from the language's own tables."""
    steps = "\n".join(f"- {op}: needs {', '.join(('id', 'op', 'input', *needs)) }; may have {', '.join(may) or 'nothing else'}" for op, (needs, may, _) in STEPS.items())
    return (
        'A plan is one JSON object with "source" {"dataset_id"}, "steps" and "output", the id of a step. The first input is "source". Steps:\n' + steps
        + f"\nExpressions are {{\"column\"}}, {{\"literal\"}} or {{\"op\", \"args\"}} with the operators {', '.join(OPERATORS)}. Metrics: {', '.join(METRICS)}."
        + f" Questions are of the kinds {', '.join(KINDS)}; a filter's unknown_policy is one of {', '.join(POLICIES)}. Answer with the object alone."
    )


def describe(resolver: Resolver, datasets: list[str]) -> str:
    """Columns with their types and some rows of each dataset, within the bounds of a sample."""
    out = []
    for d in datasets:
        relation = Compiler(resolver).read(Source(d), d, "source")
        out.append(json.dumps({"dataset_id": d, "columns": {f.name: f.type for f in relation.fields}, "rows": bounded_head(relation)}, default=str, ensure_ascii=False))
    return "\n".join(out)


def object_in(text: str) -> str:
    """The outermost JSON object of an answer that may have words around it."""
    return text[text.find("{") : text.rfind("}") + 1] or text


def draft(request: str, datasets: list[str], resolver: Resolver, model: Model, limits: Limits = Limits(), attempts: int = ATTEMPTS) -> Draft:
    """A valid plan for a request, or the issues of the last of `attempts` drafts; no judge is asked and no plan is run."""
    talk = [{"role": "system", "content": language()}, {"role": "user", "content": f"{describe(resolver, datasets)}\n\n{request}"}]
    made = Draft()
    while made.attempts < attempts:
        made.attempts += 1
        answer = model(talk)
        try:
            plan = parse_plan(object_in(answer))
        except PlanError as e:
            made.issues = [e.as_dict()]
        else:
            found = validate(plan, resolver, limits)
            if found["valid"]:
                return Draft(plan, made.attempts, [], found["estimate"])
            made.issues = found["issues"]
        talk += [{"role": "assistant", "content": answer}, {"role": "user", "content": "The plan is not valid. Mend it and answer with the whole plan:\n" + json.dumps(made.issues, ensure_ascii=False)}]
    return made
