"""Estimates, workers and incoming rows."""

from __future__ import annotations

from tabplan.estimate import estimate, head, sample, validate
from tabplan.operators.judge import RuleJudge
from tabplan.plans.spec import parse_plan
from tabplan.queries import call, lit, plan_of, sort, where
from tabplan.sources.tables import Resolver
from tabplan.streaming.incoming import answer_incoming
from tabplan.streaming.jobs import Job, Limits
from tabplan.streaming.worker import STALE_SECONDS, Worker

ANNOTATE = {"op": "semantic_annotate", "columns": ["text"], "questions": [{"name": "q", "kind": "boolean", "instruction": "yes?", "thresholds": {"mode": "fixed"}}]}


def table(spark, n=300):
    return spark.createDataFrame([(i, f"row {i % 7}") for i in range(n)], "_row_id long, text string")


def test_estimate(spark):
    data = Resolver({"t": table(spark)})
    plan = plan_of("t", where(call("ne", "text", lit("row 0"))), ANNOTATE, where(call("eq", "q.value", lit(True))), ANNOTATE | {"questions": [ANNOTATE["questions"][0] | {"name": "r"}]})
    found = estimate(plan, data, Limits(max_source_rows=200))
    assert found.source_rows == 300 and [s["bound"] for s in found.stages] == ["exact", "upper_bound"] and found.stages[0]["rows"] == 200
    assert found.requests == 40 and found.cost_usd > 0 and len(found.warnings) == 2
    assert estimate(plan_of("t", sort("text")), data).warnings[0].startswith("no semantic")
    assert validate(plan, data)["valid"] and validate(plan_of("t", sort("nope")), data)["issues"][0]["code"] == "unknown_column"


def test_samples(spark):
    df = table(spark)
    assert sample(df, 20, 7).count() == 20 and sample(df, 20, 7).collect() == sample(df.repartition(5), 20, 7).collect()
    assert [r._row_id for r in head(df, 3).collect()] == [0, 1, 2]


def test_workers_claim_and_reclaim(spark, tmp_path):
    data, now = Resolver({"t": table(spark, 40)}), [1000.0]
    open_job = lambda folder: Job(spark, folder, plan_of("t", ANNOTATE), data, RuleJudge())
    for n in ("a", "b"):
        open_job(str(tmp_path / n))
    one, two = (Worker(str(tmp_path), open_job, lambda: now[0]) for _ in range(2))
    first = one.claim()
    second = two.claim()
    assert first and second not in (None, first) and one.claim() is None
    lost = open_job(first)
    lost.state.state = "running"
    lost._save()
    assert two.claim() is None
    now[0] += STALE_SECONDS + 1
    assert [two.claim(), two.claim(), two.claim()] == [second, first, None]  # queued ones come first
    assert open_job(first).run().state == "succeeded"


def test_incoming_rows(spark, tmp_path):
    step = parse_plan(plan_of("t", ANNOTATE)).steps[0]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        table(spark, 50).where(f"_row_id % 2 = {k}").coalesce(1).write.mode("append").parquet(folder)
        answer_incoming(spark, folder, "_row_id long, text string", step, RuleJudge(), out, str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(out).collect()
    assert sorted(r._row_id for r in got) == list(range(50)) and {r.batch for r in got} == {0, 1} and {r["q.status"] for r in got} == {"ok"}
