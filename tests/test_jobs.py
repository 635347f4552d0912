"""What jobs ask and spend, services and their failures, planning, bounds of pages, import options and metrics of small tables."""

from __future__ import annotations

import json
import math
import random
from collections import Counter
from dataclasses import asdict

import pytest

from tabplan import results
from tabplan.functions import metrics
from tabplan.operators.judge import BatchJudge, RequestFailed, RuleJudge
from tabplan.operators.provider import ATTEMPTS, Route, Routes, TryAgain
from tabplan.planner import draft
from tabplan.plans.compiler import Compiler
from tabplan.plans.errors import PlanError
from tabplan.plans.spec import Source
from tabplan.queries import aggregate, call, lit, plan_of, project, where
from tabplan.sources.catalog import Catalog
from tabplan.sources.export import manifest
from tabplan.sources.files import Files
from tabplan.sources.importer import Options, import_file, preview, sniff
from tabplan.sources.tables import Resolver
from tabplan.streaming import jobs as jobs_module
from tabplan.streaming.jobs import Job, Jobs, Limits

QUESTION = {"name": "q", "kind": "boolean", "instruction": "yes?", "thresholds": {"mode": "fixed"}}
ANNOTATE = {"op": "semantic_annotate", "columns": ["text"], "questions": [QUESTION]}
PLAN = plan_of("t", ANNOTATE)


@pytest.fixture(scope="module")
def data(spark):
    return Resolver({"t": spark.createDataFrame([(i, f"row {i % 45}" if i % 9 else " ") for i in range(120)], "_row_id long, text string")})


def counting(folder):
    """A service that leaves a file for each request that it is sent."""

    def answer(texts, questions):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}.asked", "w") as f:
            f.write("\n".join(texts))
        return [{q["name"]: {"p": 0.9} for q in questions} for _ in texts]

    return BatchJudge(answer)


def asked(folder):
    return [line for f in folder.glob("*.asked") for line in f.read_text().split("\n")]


# ---- jobs


def test_a_job_asks_each_payload_once_and_counts_it(spark, tmp_path, data):
    texts = {f"text: row {i % 45}" for i in range(120) if i % 9}
    job = Job(spark, str(tmp_path / "j"), PLAN, data, counting(str(tmp_path)), chunk_rows=60)
    assert job.run().state == "succeeded"
    assert Counter(asked(tmp_path)) == Counter(texts)
    state = job.state
    assert state.asked == len(texts) and state.pairs == 0
    assert state.tokens > sum(len(t) / 3.6 for t in texts) and state.spent_usd == pytest.approx(state.tokens / 1e6 * 0.042)
    assert state.counts["s0"] == {"succeeded": sum(i % 9 > 0 for i in range(120)), "missing": sum(i % 9 == 0 for i in range(120))}
    # a job of the same folder has nothing left to ask
    assert Job(spark, str(tmp_path / "j"), PLAN, data, counting(str(tmp_path))).run().asked == len(texts) and len(asked(tmp_path)) == len(texts)


def test_a_job_stops_before_it_spends_too_much_and_goes_on(spark, tmp_path, data):
    folder = str(tmp_path / "j")
    first = Job(spark, folder, PLAN, data, counting(str(tmp_path)), Limits(spend_target_usd=5e-5), chunk_rows=40)
    state = first.run()
    assert (state.state, state.reason) == ("partial", "budget") and 0 < state.spent_usd <= 5e-5
    before = Counter(asked(tmp_path))
    assert 0 < len(before) < 40 and sum(before.values()) == state.asked
    again = Job(spark, folder, PLAN, data, counting(str(tmp_path)), chunk_rows=40)
    assert again.run().state == "succeeded" and set(Counter(asked(tmp_path)).values()) == {1}
    assert Job(spark, str(tmp_path / "none"), PLAN, data, counting(str(tmp_path)), Limits(spend_target_usd=1e-9)).run().reason == "budget"


def test_pairs_are_bounded_over_all_chunks(spark, tmp_path, monkeypatch):
    left = spark.createDataFrame([(i, f"thing {i}") for i in range(100)], "_row_id long, a string")
    tables = Resolver({"l": left, "r": spark.createDataFrame([(i, f"thing {i}") for i in range(9)], "_row_id long, b string")})
    plan = plan_of("l", {"op": "semantic_match", "right": {"dataset_id": "r"}, "left_columns": ["a"], "right_columns": ["b"], "instruction": "same?", "threshold_mode": "fixed"})
    monkeypatch.setattr(jobs_module, "MAX_PAIRS", 330)
    job = Job(spark, str(tmp_path / "j"), plan, tables, RuleJudge(), chunk_rows=40)
    state = job.run()
    assert (state.state, state.reason, state.pairs) == ("partial", "pair_budget", 300) and len(job.committed(job.plan.steps[0])) == 2
    monkeypatch.setattr(jobs_module, "MAX_PAIRS", 500)
    again = Job(spark, str(tmp_path / "j"), plan, tables, RuleJudge(), chunk_rows=40)
    assert again.run().state == "succeeded" and again.state.pairs == 500 and again.state.counts["s0"] == {"matched": 9, "unmatched": 91}


def test_flagged_rows_are_counted(spark, tmp_path):
    scores = [random.Random(i).random() for i in range(90)]
    table = Resolver({"t": spark.createDataFrame([(i, f"p={s:.3f}") for i, s in enumerate(scores)], "_row_id long, text string")})
    job = Job(spark, str(tmp_path / "j"), plan_of("t", ANNOTATE | {"questions": [QUESTION | {"thresholds": {"mode": "auto"}}]}), table, RuleJudge())
    job.run()
    cut = job.state.cuts["s0.q"]["cut"]
    told = manifest(job.plan, job.relations(), "s0", state=asdict(job.state))
    assert told["usage"]["asked"] == len({f"{s:.3f}" for s in scores}) and told["job"] == {"state": "succeeded", "reason": None} and told["cuts"]["s0.q"]["cut"] == cut and told["counts"] == job.state.counts
    assert job.state.counts["s0"] == {"succeeded": 90, "flagged": sum(abs(round(s, 3) - cut) <= 0.1 + 1e-12 for s in scores)}


def test_jobs_by_key_and_page(spark, tmp_path, data):
    found = Jobs(spark, str(tmp_path))
    for k in "abc":
        found.submit(k, PLAN, data, RuleJudge())
    found.submit("b", PLAN, data, RuleJudge()).run()
    assert found.get("b")["state"] == "succeeded" and found.get("a")["state"] == "queued"
    page = found.list(1, 1)
    assert page["total"] == 3 and [j["key"] for j in page["jobs"]] == ["b"] and [j["key"] for j in found.list(state="queued")["jobs"]] == ["c", "a"]
    with pytest.raises(PlanError):
        found.get("z")


def test_files(spark, tmp_path):
    files, at = Files(spark), str(tmp_path / "a/b")
    assert files.read(at) is None and files.create(at, "ä") and not files.create(at, "b") and files.read(at) == "ä"
    files.write(at, "c")
    assert files.read(at) == "c" and files.names(str(tmp_path / "a")) == ["b"]
    files.make(str(tmp_path / "d"))
    assert files.move(str(tmp_path / "d"), str(tmp_path / "e")) and not files.exists(str(tmp_path / "d"))
    files.make(str(tmp_path / "d"))
    assert not files.move(str(tmp_path / "d"), str(tmp_path / "e")) and not files.exists(str(tmp_path / "d"))


# ---- services


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def test_requests_are_spread_over_routes_and_keep_their_rates():
    clock, seen = Clock(), Counter()
    answer = lambda n: lambda texts, questions: seen.update([n]) or [{"q": n}] * len(texts)
    routes = Routes([Route(n, answer(n), requests_per_minute=60) for n in "ab"], clock=clock, sleep=clock.sleep)
    for _ in range(40):
        routes(["x"], [])
    assert seen == {"a": 20, "b": 20}
    assert clock.now >= 16  # two a second, after two at once on each


def test_a_request_goes_to_another_route_and_gives_up_at_last():
    clock, calls = Clock(), []

    def busy(texts, questions):
        calls.append(("busy", clock.now))
        raise TryAgain("429", after=30)

    def broken(texts, questions):
        raise RequestFailed("400")

    routes = Routes([Route("busy", busy), Route("good", lambda t, q: calls.append(("good", clock.now)) or ["yes"] * len(t))], clock=clock, sleep=clock.sleep)
    assert [routes(["x"], []) for _ in range(5)] == [["yes"]] * 5
    assert [c for c, _ in calls].count("busy") == 1 and clock.now < 30  # it rests, and no one waits for it
    calls.clear()
    alone = Routes([Route("busy", busy)], clock=clock, sleep=clock.sleep)
    with pytest.raises(RequestFailed):
        alone(["x"], [])
    assert len(calls) == ATTEMPTS and all(b - a >= 30 for (_, a), (_, b) in zip(calls, calls[1:], strict=False))
    with pytest.raises(RequestFailed):
        Routes([Route("broken", broken)], clock=clock, sleep=clock.sleep)(["x"], [])
    with pytest.raises(RequestFailed):
        Routes([])(["x"], [])


# ---- planning


def test_a_model_hears_what_is_wrong(data):
    good = json.dumps(plan_of("t", aggregate(["text"], ("n", "count"))))
    answers = iter(["no idea", json.dumps(plan_of("t", aggregate(["nope"], ("n", "count")))), f"Here it is:\n```json\n{good}\n```"])
    talks = []

    def model(talk):
        talks.append([t["content"] for t in talk])
        return next(answers)

    made = draft("How many rows of each text?", ["t"], data, model)
    assert made.attempts == 3 and made.plan.output == "s0" and made.estimate["source_rows"] == 120
    assert '"dataset_id": "t"' in talks[0][1] and "unknown_column" in talks[2][-1] and len(talks[2]) == 6
    failed = draft("?", ["t"], data, lambda talk: "{}", attempts=2)
    assert failed.plan is None and failed.attempts == 2 and failed.issues[0]["code"] == "missing"


# ---- pages


def test_pages_are_bounded(spark):
    table = spark.createDataFrame([(i, "x" * (i * 10), i) for i in range(400)], "_row_id long, t string, v int")
    relation = Compiler(Resolver({"d": table})).read(Source("d"), "d", "")
    for bounds in (results.WEB, results.AGENT, results.SAMPLE):
        start, seen = 0, []
        while start is not None:
            page = results.bounded_page(relation, start=start, bounds=bounds)
            assert 0 < len(page["rows"]) <= bounds.rows and all(len(r["t"]) <= bounds.chars for r in page["rows"])
            assert len(page["rows"]) == 1 or sum(len(json.dumps(r)) for r in page["rows"]) <= bounds.bytes
            assert all(("_truncated" in r) == (r["v"] * 10 > bounds.chars) for r in page["rows"])
            seen += [r["v"] for r in page["rows"]]
            start = page["next"]
        assert seen == list(range(400))


def test_deep_pages(spark, monkeypatch):
    monkeypatch.setattr(results, "DEEP", 10)
    table = spark.range(300).selectExpr("id AS _row_id", "id % 7 AS v").repartition(5)
    relation = Compiler(Resolver({"d": table})).read(Source("d"), "d", "")
    want = sorted(range(300), key=lambda i: (-(i % 7), i))
    assert [r._row_id for r in results.page(relation, ["_row_id"], sort=[("v", True)], start=100, limit=20).collect()] == want[100:120]


# ---- import


def test_import_options(spark, tmp_path):
    path = str(tmp_path / "t.txt")
    with open(path, "w", encoding="latin-1") as f:
        f.write("é;'a;b'\nNA;-\n'it''s';c\n")
    options = Options(delimiter=";", header=False, encoding="latin-1", quote="'", null_strings=("-",))
    assert sniff(path, options) == (";", False) and preview(spark, path, 5, options)[1] == [["é", "a;b"], ["NA", None], ["it's", "c"]]
    report = import_file(spark, path, str(tmp_path / "out"), options=options)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("_row_id").collect()
    assert [tuple(r) for r in got] == [(0, "é", "a;b"), (1, "NA", None), (2, "it's", "c")] and [c["name"] for c in report.columns] == ["column_1", "column_2"]
    for bad in (Options(delimiter="ab"), Options(encoding="nope"), Options(quote="")):
        with pytest.raises(PlanError):
            import_file(spark, path, str(tmp_path / "out"), options=bad)
    with pytest.raises(PlanError) as e:
        import_file(spark, path, str(tmp_path / "out"))
    assert e.value.code == "encoding"
    catalog = Catalog(spark, str(tmp_path / "c"))
    ids = [catalog.import_dataset(path, n, options=options) for n in "xyz"]
    assert [m["id"] for m in catalog.list(1, 1)] == ids[1:2] and catalog.version(ids[0]).count() == 3
    with pytest.raises(PlanError):
        catalog.import_dataset(path, "w")
    assert len(catalog.list()) == 3


# ---- metrics


def plain_entropy(labels):
    return -sum(n / len(labels) * math.log(n / len(labels)) for n in Counter(labels).values())


def test_metrics_of_small_and_empty_tables(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "a string, b string")
    for rows, kappa, ari, nmi in (([], None, None, None), ([("x", "x")], 1.0, None, 1.0), ([("x", "x"), ("x", "x")], 1.0, 1.0, 1.0), ([("x", "y"), ("x", "z")], 0.0, 0.0, None)):
        df = pairs(rows)
        assert (metrics.cohen_kappa(df, "a", "b").first().kappa, metrics.adjusted_rand(df, "a", "b").first().ari, metrics.normalized_mutual_information(df, "a", "b").first().nmi) == (kappa, ari, nmi), rows
    keys = lambda ks: spark.createDataFrame([(k,) for k in ks], "k int")
    for found, gold, want in (([], [], (None, None, None, None)), ([1], [], (0.0, None, 0.0, 0.0)), ([], [1], (None, 0.0, 0.0, 0.0)), ([1, 2], [2, 3], (0.5, 0.5, 0.5, 1 / 3))):
        r = metrics.precision_recall(keys(found), keys(gold), "k").first()
        assert (r.precision, r.recall, r.f1, r.jaccard) == pytest.approx(want) if None not in want else (r.precision, r.recall, r.f1, r.jaccard) == want
    ranks = lambda n: spark.createDataFrame([(i, float(i)) for i in range(n)], "k int, s double")
    assert metrics.spearman(ranks(2), ranks(9), "k", "s").first().rho is None and metrics.spearman(ranks(3), ranks(9), "k", "s").first().rho == 1
    assert tuple(metrics.score_percentiles(ranks(0), "s").first()) == (0, None, None, None, None, None)
    assert tuple(metrics.score_percentiles(ranks(200), "s").first()) == (200, 0.0, 100.0, 180.0, 198.0, 199.0)


def test_metrics_by_brute_force(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("xyz"), rnd.choice("xyzw")) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = zip(*rows, strict=True)
    mi = plain_entropy(a) + plain_entropy(b) - plain_entropy(rows)
    assert metrics.normalized_mutual_information(df, "a", "b").first().nmi == pytest.approx(mi / math.sqrt(plain_entropy(a) * plain_entropy(b)))
    f1 = lambda c: 2 * sum(r == (c, c) for r in rows) / (a.count(c) + b.count(c))
    scope = [r for r in rows if r[0] in "xy" or r[1] in "xy"]
    got = metrics.class_summary(df, "a", "b", ["x", "y"]).first()
    assert got.macro_f1 == pytest.approx((f1("x") + f1("y")) / 2) and got.accuracy_in_scope == pytest.approx(sum(x == y for x, y in scope) / len(scope))


def test_gates_and_projections_read_what_they_need(spark, tmp_path):
    spark.range(50).selectExpr("id AS _row_id", "cast(id AS string) AS text", "repeat('x', 100) AS wide", "id % 3 AS g").write.parquet(str(tmp_path / "t"))
    from tabplan.plans.compiler import run_plan

    plan = run_plan(plan_of("t", where(call("eq", "g", lit(1))), project("text")), Resolver({"t": lambda: spark.read.parquet(str(tmp_path / "t"))}))._jdf.queryExecution().executedPlan().toString()
    assert "wide" not in plan and "PushedFilters: [IsNotNull(g), EqualTo(g,1)]" in plan
