"""Import, catalog, jobs, results, export and metrics."""

from __future__ import annotations

import gzip
import json
import math
import os

import pytest

from tabplan import queries, results
from tabplan.functions import metrics
from tabplan.operators.judge import RuleJudge
from tabplan.plans.compiler import Compiler
from tabplan.plans.errors import PlanError
from tabplan.plans.spec import Source, parse_plan
from tabplan.queries import call, compute, lit, plan_of, project, sort, where
from tabplan.sources import export as exporting
from tabplan.sources.catalog import AnswerCache, Catalog, ResultStore
from tabplan.sources.importer import MAX_ROWS, detect_types, import_file, preview, sanitize, sniff
from tabplan.sources.tables import Resolver
from tabplan.streaming.jobs import Job, Jobs, Limits, chunk_bounds

TSV = 'id\tamount\tprice\tnote\tflag\tday\tcode\n1\t5\t1.5\t"two\nlines"\tyes\t2024-01-05\t007\n2\tNA\t2\t\tno\t2024/02/01\t010\n3\t7\t-3.25\t"say ""hi"""\ttrue\t2024-03-01\t011\n'


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_names():
    assert sanitize(["Date received", "Date received", "", "1abc", "ok_name", "_row_id"]) == ["Date received", "Date received_2", "column_3", "1abc", "ok_name", "_row_id"]
    assert sanitize(["a.b", "a.b", " x \n y ", "﻿z", "Z"]) == ["a_b", "a_b_2", "x y", "z", "Z_2"]


def test_import(spark, tmp_path):
    path = write(tmp_path / "t.tsv", TSV)
    assert sniff(path) == ("\t", True)
    report = import_file(spark, path, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("_row_id").collect()
    assert {c["name"]: c["type"] for c in report.columns} == {"id": "integer", "amount": "integer", "price": "double", "note": "text", "flag": "boolean", "day": "date", "code": "text"}
    assert [r._row_id for r in got] == [0, 1, 2] and [r.note for r in got] == ["two\nlines", None, 'say "hi"'] and got[1].amount is None and got[1].flag is False
    assert report.rows == 3 and report.columns[1]["null_count"] == 1 and report.columns[0]["samples"] == ["1", "2", "3"]


def test_gzip_and_preview(spark, tmp_path):
    path = str(tmp_path / "t.csv.gz")
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write("a;b\n" + "".join(f"{i};x{i}\n" for i in range(50)))
    assert preview(spark, path, 20)[0] == ["a", "b"] and len(preview(spark, path, 20)[1]) == 20
    assert import_file(spark, path, str(tmp_path / "out"), row_limit=10).rows == 10


def test_malformed_rows(spark, tmp_path):
    path = write(tmp_path / "m.csv", "a,b\n1,x\n2,y,extra\n3,z\n")
    with pytest.raises(PlanError) as e:
        import_file(spark, path, str(tmp_path / "out"))
    assert e.value.code == "malformed_rows"
    report = import_file(spark, path, str(tmp_path / "out"), permissive=True)
    assert report.rows == 2 and [r["line"] for r in report.rejects] == [3]
    assert [r._row_id for r in spark.read.parquet(str(tmp_path / "out")).orderBy("_row_id").collect()] == [0, 1]


@pytest.mark.parametrize("text,code", [("", "empty_file"), ("a,b\n", "empty_file"), ("_row_id,b\n1,2\n", "reserved_name")])
def test_refused_files(spark, tmp_path, text, code):
    with pytest.raises(PlanError) as e:
        import_file(spark, write(tmp_path / "f.csv", text), str(tmp_path / "out"))
    assert e.value.code == code
    with pytest.raises(PlanError):
        import_file(spark, write(tmp_path / "g.csv", "a,b\n1,2\n"), str(tmp_path / "out"), row_limit=MAX_ROWS + 1)


def test_types_need_all_rows(spark):
    df = spark.createDataFrame([(str(i), f"{i}.5", "x" if i == 0 else "1", None) for i in range(20)], "a string, b string, c string, d string")
    kinds, near = detect_types(df, ["a", "b", "c", "d"])
    assert kinds == {"a": "integer", "b": "double", "c": "text", "d": "text"} and near[0]["column"] == "c" and near[0]["candidate"] == "integer"


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    d = catalog.import_dataset(write(tmp_path / "t.tsv", TSV), "things")
    assert catalog.list()[0]["name"] == "things" and catalog.describe(d)["columns"][0]["name"] == "id"
    assert catalog.patch(d, [(0, "amount", "9"), (0, "amount", "11"), (1, "note", None), (2, "price", "x")]) == 2
    got = {r._row_id: r for r in catalog.version(d).collect()}
    assert len(got) == 3 and got[0].amount == 11 and got[2].price is None and got[0].note == "two\nlines"
    assert catalog.patch(d, [(0, "amount", "1")], parent=1) == 3 and catalog.version(d, 1).where("_row_id = 0").first().amount == 5
    for cells in ([(0, "nope", "1")], [(0, "_row_id", "1")], []):
        with pytest.raises(PlanError):
            catalog.patch(d, cells)
    catalog.delete(d)
    assert catalog.list() == []
    with pytest.raises(PlanError):
        catalog.version(d)


def test_result_versions(tmp_path):
    store = ResultStore(str(tmp_path))
    first = store.create(PLAN, "d", 1)
    second = store.override(first, [(0, "q.value", "true")], "seen", "me")
    third = store.override(second, [(0, "q.value", None)])
    assert store.cells(first) == [] and store.cells(third) == [(0, "q.value", "true"), (0, "q.value", None)] and store.lineage(third) == [third, second, first]
    with pytest.raises(PlanError):
        store.load("nope")


def test_candidates_as_rows(spark):
    df = spark.createDataFrame([(3, '[{"right_row_id":7,"p_same":0.5,"retrieval_score":81.25},{"right_row_id":8,"p_same":null,"retrieval_score":2}]'), (4, "[]")], "_row_id long, `m.candidates` string")
    assert [tuple(r) for r in results.match_candidates(df, "m").collect()] == [(3, 7, 0.5, 81.25, 0), (3, 8, None, 2.0, 1)]


# ---- jobs

ANNOTATE = {"op": "semantic_annotate", "columns": ["text"], "questions": [{"name": "q", "kind": "boolean", "instruction": "yes?", "thresholds": {"mode": "fixed"}}]}
PLAN = plan_of("t", ANNOTATE, where(call("eq", "q.value", lit(True))))


@pytest.fixture(scope="module")
def data(spark):
    return Resolver({"t": spark.createDataFrame([(i, "a refund" if i % 4 == 0 else "unsure" if i % 4 == 1 else f"row {i}") for i in range(130)], "_row_id long, text string")})


def test_chunks():
    assert list(chunk_bounds(500)) == [(0, 50), (50, 250), (250, 450), (450, 500)]
    assert list(chunk_bounds(10)) == [(0, 10)] and list(chunk_bounds(0)) == [] and list(chunk_bounds(100, 40))[0] == (0, 20)


def test_job_stops_and_goes_on(spark, tmp_path, data):
    folder, job = str(tmp_path / "j"), None
    job = Job(spark, folder, PLAN, data, RuleJudge(), Limits(max_provider_requests=5), chunk_rows=60)
    assert job.run().state == "partial" and job.state.reason == "max_provider_requests"
    some = job.relations()
    counts = {r["q.status"]: r["count"] for r in some["s0"].df.groupBy("`q.status`").count().collect()}
    assert some["s1"].provisional and counts["pending"] == 130 - 80
    os.makedirs(f"{folder}/stages/s0/_tmp_00002", exist_ok=True)  # what a lost worker left behind
    again = Job(spark, folder, PLAN, data, RuleJudge(), chunk_rows=60)
    before = again.committed(again.plan.steps[0])
    again.state.state = "queued"
    assert again.run().state == "succeeded" and before == [0, 1] and again.committed(again.plan.steps[0]) == [0, 1, 2]
    done = again.relations()
    assert not done["s1"].provisional and done["s1"].df.count() == 33 and done["s1__review"].df.count() == 33
    kinds = [e["event"] for e in again.events()]
    assert kinds[0] == "queued" and kinds[-1] == "finished" and kinds.count("chunk_committed") == 3 and [e["seq"] for e in again.events(3)][0] == 4
    assert again.state.counts["s0"] == {"succeeded": 97, "uncertain": 33}
    cached = AnswerCache(spark, f"{folder}/cache").read().count()
    assert cached == data.dataset("t", "").select("text").distinct().count()


def test_cancel_deadline_and_rows(spark, tmp_path, data):
    job = Job(spark, str(tmp_path / "a"), PLAN, data, RuleJudge())
    job.cancel()
    assert job.run().state == "cancelled" and job.run().state == "cancelled"
    ticks = iter(range(0, 100_000, 400))
    assert Job(spark, str(tmp_path / "b"), PLAN, data, RuleJudge(), clock=lambda: next(ticks)).run().reason == "deadline"
    assert Job(spark, str(tmp_path / "c"), PLAN, data, RuleJudge(), Limits(max_source_rows=30)).run().reason == "max_source_rows"


def test_a_job_without_bounds(spark, tmp_path, data):
    ticks = iter(range(0, 100_000, 900))
    job = Job(spark, str(tmp_path), PLAN, data, RuleJudge(), Limits(None, None, None, None), chunk_rows=60, clock=lambda: next(ticks))
    assert job.run().state == "succeeded" and sum(job.state.counts["s0"].values()) == 130


def test_job_resume_ends_however_long_it_takes(spark, tmp_path, monkeypatch):
    ticks, jobs = iter(range(0, 10_000_000, 400)), []

    def slow(*given, **options):
        jobs.append(Job(*given, **options, clock=lambda: next(ticks)))
        return jobs[-1]

    monkeypatch.setattr(queries, "Job", slow)
    spark.range(1_300).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["rude_status"]: r["count"] for r in queries.QUERIES["job_resume"](spark, str(tmp_path)).groupBy("rude_status").count().collect()}
    assert got == {"ok": 1_300} and [j.state.reason for j in jobs] == ["max_provider_requests", None]
    assert jobs[1].limits.max_source_rows is None


def test_one_key_one_job(spark, tmp_path, data):
    jobs = Jobs(spark, str(tmp_path))
    assert jobs.submit("k", PLAN, data, RuleJudge()).folder == jobs.submit("k", PLAN, data, RuleJudge()).folder
    with pytest.raises(PlanError):
        jobs.submit("k", plan_of("t", sort("text")), data, RuleJudge())


# ---- results


@pytest.fixture(scope="module")
def relation(spark):
    base = spark.createDataFrame([(0, "b", 2.0), (1, "=a", None), (2, None, -5.0), (3, "c", 2.0)], "_row_id long, t string, v double")
    return Compiler(Resolver({"d": base})).read(Source("d"), "d", "")


def test_pages_and_vectors(spark, relation):
    assert [r._row_id for r in results.page(relation, sort=[("v", True)]).collect()] == [0, 3, 2, 1]
    assert [r._row_id for r in results.page(relation, sort=[("v", False)], start=1, limit=2).collect()] == [0, 3]
    assert [r._row_id for r in results.rows_by_id(relation, [3, 0]).collect()] == [3, 0]
    assert results.summary(relation, call("gt", "v", 0)) == {"total": 2, "denominator": 4, "count_status": "complete"}
    assert {r._row_id: (r.code, r.label) for r in results.vector(relation, "t").collect()} == {0: (1, "b"), 1: (0, "=a"), 2: (None, None), 3: (2, "c")}
    assert {r._row_id: r.number for r in results.vector(relation, "v").collect()}[2] == -5.0
    assert results.range_filter(relation.df, "v", 0, None, include_null=True).count() == 3 and results.label_filter(relation.df, "t", []).count() == 4
    assert results.cell(relation, 3, "t") == "c" and results.cell(relation, 9, "t") is None
    cut = results.cut_cells(spark.createDataFrame([("x" * 600, "y")], "a string, b string")).first()
    assert len(cut.a) == 512 and cut._truncated == ["a"]
    with pytest.raises(PlanError):
        results.page(relation, sort=[("nope", True)])


def test_export(spark, tmp_path, relation):
    plan = parse_plan(plan_of("d", compute(w=call("mul", "v", 2)), project("t", "w")))
    relations = Compiler(Resolver({"d": relation.df})).compile(plan)
    found = exporting.export(plan, relations, "s1", str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part*"))
    assert "'=a" in text and "-10.0" in text and "'-10.0" not in text and found["completion"] == "complete"
    assert json.loads("".join(p.read_text() for p in (tmp_path / "csv.manifest").glob("part*")))["plan"] == plan.digest()
    exporting.export(plan, relations, "s1", str(tmp_path / "pq"), "parquet")
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 4


def test_export_of_unfinished_results(spark, data):
    plan = parse_plan(PLAN)
    found = exporting.manifest(plan, Compiler(data).compile(plan), "s0")
    assert found["completion"] == "provisional" and found["pending"] == {"q.status": 130} and found["review_views"] == ["s1__review"]


# ---- metrics


def test_metrics(spark):
    a = spark.createDataFrame([(i,) for i in (1, 2, 3, None)], "k int")
    b = spark.createDataFrame([(i,) for i in (2, 3, 4, 5)], "k int")
    got = metrics.precision_recall(a, b, "k").first()
    assert (got.tp, got.fp, got.fn) == (2, 1, 2) and got.precision == pytest.approx(2 / 3) and got.jaccard == pytest.approx(0.4)
    same = spark.createDataFrame([("x", "p"), ("x", "p"), ("y", "q"), ("z", None)], "a string, b string")
    assert metrics.adjusted_rand(same, "a", "b").first().ari == pytest.approx(1) and metrics.normalized_mutual_information(same, "a", "b").first().nmi == pytest.approx(1)
    agree = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15, "a int, b int")
    assert metrics.cohen_kappa(agree, "a", "b").first().kappa == pytest.approx(0.4)
    left = spark.createDataFrame([(i, float(i)) for i in range(10)], "k int, s double")
    right = spark.createDataFrame([(i, float(-i)) for i in range(10)], "k int, s double")
    assert metrics.spearman(left, right, "k", "s").first().rho == pytest.approx(-1) and metrics.top_k_overlap(left, right, "k", "s", 6).first().overlap == pytest.approx(2 / 6)
    assert {r.share: r.value for r in metrics.nearest_rank(left, "s", [0.0, 0.5, 1.0]).collect()} == {0.0: 0.0, 0.5: 5.0, 1.0: 9.0}
    assert math.isclose(sum(r.n for r in metrics.score_summary(left.selectExpr("s / 9 AS s"), "s").collect()), 10)
