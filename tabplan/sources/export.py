"""Exports: CSV safe for spreadsheets, Parquet, and a manifest that says how complete they are."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import REVIEW
from ..plans.relation import Relation, name
from ..plans.spec import Plan

#: Text cells that begin so would be formulas.
FORMULA = r"^[=+\-@\t\r]"


def escape_formulas(df: DataFrame) -> DataFrame:
    """Text columns with ' before what would be a formula; numbers, negative ones too, stay numbers."""
    safe = lambda c: F.when(c.rlike(FORMULA), F.concat(F.lit("'"), c)).otherwise(c)
    return df.select(*((safe(name(f.name)) if isinstance(f.dataType, T.StringType) else name(f.name)).alias(f.name) for f in df.schema))


def pending_counts(relation: Relation) -> dict[str, int]:
    """Rows still pending by status column, of those that the relation shows."""
    statuses = sorted({s for s in relation.gates.values() if s in relation.names})
    if not statuses:
        return {}
    got = relation.df.agg(*(F.count_if(name(s) == "pending").alias(f"n{i}") for i, s in enumerate(statuses))).first()
    return {s: got[f"n{i}"] for i, s in enumerate(statuses)}


def manifest(plan: Plan, relations: dict[str, Relation], step: str, extra: dict[str, Any] | None = None, state: dict[str, Any] | None = None) -> dict[str, Any]:
    """What an export holds and how complete it is; `state` of a job adds its counts, cuts and usage."""
    relation = relations[step]
    told = {} if state is None else {"counts": state["counts"], "cuts": state["cuts"], "usage": {k: state[k] for k in ("requests", "asked", "pairs", "tokens", "spent_usd")}, "job": {"state": state["state"], "reason": state["reason"]}}
    return {
        "plan": plan.digest(), "model": plan.model, "step": step, "columns": [{"name": f.name, "type": f.type, "role": f.role} for f in relation.fields],
        "completion": "provisional" if relation.provisional else "complete", "pending": pending_counts(relation), "pending_stages": sorted(relation.pending),
        "review_views": sorted(n for n in relations if n.endswith(REVIEW)), **told, **(extra or {}),
    }


def export(plan: Plan, relations: dict[str, Relation], step: str, out: str, form: str = "csv", raw: bool = False, state: dict[str, Any] | None = None) -> dict[str, Any]:
    """Write a step to the folder `out`, in its order, and return the manifest, which lies beside it."""
    df = relations[step].ordered()
    if form == "csv":
        (df if raw else escape_formulas(df)).write.mode("overwrite").csv(out, header=True, escape='"', emptyValue="")
    else:
        df.write.mode("overwrite").option("compression", "zstd").parquet(out)
    found = manifest(plan, relations, step, {"format": form, "escaped": form == "csv" and not raw}, state)
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.mode("overwrite").text(out.rstrip("/") + ".manifest")
    return found
