"""The plan language: specification, expressions, exact steps, gates, calibration, matching."""

from __future__ import annotations

import datetime
import json
import random
import statistics
import uuid

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabplan.engine import answer_all, run
from tabplan.functions.expr import plain_double
from tabplan.functions.text import TokenSets, common_subsequence, indel_distance, token_set_ratio, token_sets_ratio
from tabplan.operators import match as matching
from tabplan.operators.annotate import annotate, cache_key, clean_cell
from tabplan.operators.calibrate import find_cut, otsu
from tabplan.operators.judge import BatchJudge, RequestFailed, RuleJudge, pack, tokens_of
from tabplan.operators.rowids import dense_ids
from tabplan.plans.compiler import Compiler, run_plan
from tabplan.plans.errors import PlanError
from tabplan.plans.spec import Question, parse_plan
from tabplan.queries import QUERIES, SQL, aggregate, call, compute, lit, plan_of, project, resolver, sort, where
from tabplan.results import overrides
from tabplan.sources import tables as tables_module
from tabplan.sources.tables import Resolver, with_row_ids

JUDGE = RuleJudge()
RND = random.Random(2024)
SHOP = [(i, RND.choice(["lamp", "Desk", "chair ", None]), RND.choice([f"EUR {RND.randrange(900) / 4}", f"{RND.randrange(5)} {RND.randrange(100, 999)}", f"-{RND.randrange(9)}.5", "n/a", "1.2.3", None]), RND.choice([None, *range(6)]), RND.choice(["Turin", "Oslo", "Lyon", None])) for i in range(40)]
DEPOTS = [(i, RND.choice(["Oslo", "Lyon", "Bern", None]), f"depot {i}") for i in range(7)]


@pytest.fixture(scope="module")
def tables(spark):
    shop = spark.createDataFrame(SHOP, "_row_id long, item string, cost string, units long, town string").repartition(3)
    return Resolver({"shop": shop, "depots": spark.createDataFrame(DEPOTS, "_row_id long, place string, label string")})


def rows(df):
    return [tuple(r) for r in df.collect()]


def column(tables, e, source="shop"):
    """The values of an expression in the order of the rows."""
    return [r[1] for r in run_plan(plan_of(source, compute(x=e), project("x")), tables).collect()]


def number_of(text):
    """What is left of a text without all but digits, points and minus signs, if that is a number."""
    try:
        return None if text is None else float("".join(c for c in text if c in "0123456789.-"))
    except ValueError:
        return None


def last(value, descending=False):
    """A key that sorts nulls behind all else."""
    return (value is None, 0 if value is None else -value if descending else value)


def test_to_number_and_sort(tables):
    worth = {i: None if number_of(cost) is None or units is None else number_of(cost) * units for i, _, cost, units, _ in SHOP}
    assert len({v is None for v in worth.values()}) == 2 and len(set(worth.values())) < len(worth)
    got = rows(run_plan(plan_of("shop", compute(n=call("to_number", "cost")), compute(worth=call("mul", "n", "units")), sort("-worth"), project("worth")), tables))
    assert got == [(i, worth[i]) for i in sorted(worth, key=lambda i: (last(worth[i], True), i))]


def test_filter_is_two_valued(tables):
    is_lamp = call("eq", "item", lit("lamp"))
    assert [r[0] for r in rows(run_plan(plan_of("shop", where(is_lamp)), tables))] == [r[0] for r in SHOP if r[1] == "lamp"]
    assert [r[0] for r in rows(run_plan(plan_of("shop", where(call("not", is_lamp))), tables))] == [r[0] for r in SHOP if r[1] not in ("lamp", None)]


def test_aggregate_renumbers(tables):
    groups = {}
    for _, _, _, units, town in SHOP:
        groups.setdefault(town, []).append(units)
    want = [(town, len(u), sum(x for x in u if x is not None)) for town, u in sorted(groups.items(), key=lambda g: (g[0] is None, g[0] or ""))]
    got = rows(run_plan(plan_of("shop", aggregate(["town"], ("n", "count"), ("units", "sum", "units"))), tables))
    assert got == [(i, *w) for i, w in enumerate(want)]
    nothing = plan_of("shop", where(call("eq", "town", lit("Rome"))), aggregate([], ("n", "count"), ("units", "sum", "units")))
    assert rows(run_plan(nothing, tables)) == [(0, 0, None)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_has_dense_ids(tables, how):
    want = []
    for i, *_, town in SHOP:
        met = [label for _, place, label in DEPOTS if town is not None and place == town]
        want += [(i, label) for label in met or ([None] if how == "left" else [])]
    got = run_plan(plan_of("shop", {"op": "join", "right": {"dataset_id": "depots"}, "on": [{"left": "town", "right": "place"}], "how": how}), tables).collect()
    assert [(r["left_row_id"], r["right.label"]) for r in got] == want and [r["_row_id"] for r in got] == list(range(len(want)))


def test_limit_follows_the_order(tables):
    best = sorted((r for r in SHOP if r[1] is not None), key=lambda r: (last(r[3], True), r[0]))[:5]
    assert [r[0] for r in rows(run_plan(plan_of("shop", sort("-units"), project("item"), where(call("not_null", "item")), {"op": "limit", "n": 5}), tables))] == [r[0] for r in best]


def test_distinct(tables):
    towns = sorted({r[4] for r in SHOP}, key=lambda t: (t is None, t or ""))
    assert rows(run_plan(plan_of("shop", {"op": "distinct", "columns": ["town"]}), tables)) == list(enumerate(towns))


def test_expressions(tables):
    units, items, towns = ([r[k] for r in SHOP] for k in (3, 1, 4))
    each = lambda f, values: [None if v is None else f(v) for v in values]
    assert column(tables, call("div", "units", 0)) == [None] * 40
    assert column(tables, call("div", 6, "units")) == each(lambda v: 6 / v if v else None, units)
    assert column(tables, call("in", "town", lit([]))) == [False] * 40
    assert column(tables, call("in", "town", lit(["Oslo", None]))) == [True if t == "Oslo" else None for t in towns]
    assert column(tables, call("replace", "item", lit("a"), lit("--"))) == each(lambda v: v.replace("a", "--"), items)
    assert column(tables, call("case", call("gt", "units", 2), lit("many"), lit("few"))) == ["many" if v is not None and v > 2 else "few" for v in units]
    assert column(tables, call("coalesce", "units", -7)) == [-7 if v is None else v for v in units]
    assert column(tables, call("icontains", "item", lit("DES"))) == each(lambda v: "des" in v.lower(), items)
    assert column(tables, call("trim", "item")) == each(str.strip, items) and column(tables, call("length", "item")) == each(len, items)


def test_casts_that_engines_read_unlike(spark, tables):
    texts = ["2024", "2024-01", "2024/01/05", "2024-01-05 10:11:12", "x", None, "1.5d", "1e5", " 7 "]
    tables.datasets["casts"] = spark.createDataFrame(list(enumerate(texts)), "_row_id long, text string")
    day = datetime.date(2024, 1, 5)
    assert column(tables, call("date", "text"), "casts") == [None, None, day, day, None, None, None, None, None]
    assert column(tables, call("year", "text"), "casts")[2:4] == [2024, 2024]
    doubles = [1e7, 123456789.0, 1e20, 1e-5, -2.5e-4, 0.1, 1.5e16, 9007199254740993.0, 1234567.5, float("nan"), -12345678.25]
    df = spark.createDataFrame([(float(x),) for x in doubles], "x double")
    got = [r[0] for r in df.select(plain_double(df.x)).collect()]
    assert got == ["10000000.0", "123456789.0", "1e+20", "1e-05", "-0.00025", "0.1", "1.5e+16", "9007199254740992.0", "1234567.5", "nan", "-12345678.25"]
    tables.datasets["numbers"] = spark.createDataFrame([(i, float(x)) for i, x in enumerate(doubles[:3])], "_row_id long, v double")
    assert column(tables, call("to_number", "v"), "numbers") == doubles[:3]


@pytest.mark.parametrize(
    "steps,code",
    [
        ([where(call("eq", "nope", 1))], "unknown_column"), ([where(call("eq", "units"))], "arity"), ([where({"op": "like", "args": []})], "unknown_op"), ([where(call("in", "units", 3))], "invalid_in"),
        ([{"op": "explode"}], "choice"), ([sort("nope")], "unknown_column"), ([{"op": "limit", "n": 0}], "range"), ([compute(units=lit(1))], "column_conflict"), ([{"op": "limit", "n": 1, "x": 2}], "unknown_key"),
        ([{"op": "limit", "n": 1, "input": "later"}], "unknown_input"), ([{"id": "a", "op": "limit", "n": 1}, {"id": "a", "op": "limit", "n": 1}], "duplicate_id"),
        ([aggregate(["town"], ("n", "count")), {"op": "semantic_annotate", "columns": ["town"], "questions": [{"name": "q", "kind": "boolean", "instruction": "yes?"}]}], "needs_rows"),
        ([aggregate([], ("n", "sum"))], "metric_column"),
    ],
)
def test_errors(tables, steps, code):
    with pytest.raises(PlanError) as e:
        run_plan(plan_of("shop", *steps), tables)
    assert e.value.code == code and set(e.value.as_dict()) == {"path", "code", "message", "fix"}


def test_plan_limits():
    with pytest.raises(PlanError):
        parse_plan(plan_of("shop", *[{"op": "limit", "n": 1}] * 33))
    with pytest.raises(PlanError):
        parse_plan("{")
    assert parse_plan(json.dumps(plan_of("shop", sort("a")))).digest() == parse_plan(plan_of("shop", sort("a"))).digest()


def test_dense_ids_by_ranges(spark, monkeypatch):
    import tabplan.operators.rowids as module

    df = spark.range(3000).selectExpr("(id * 7919) % 3001 AS k")
    small = dense_ids(df, [df.k.asc()], 0).collect()
    large = dense_ids(df, [df.k.asc()], module.ONE_TASK_BYTES + 1).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, large)) and {r._row_id for r in large} == set(range(3000))


@pytest.mark.parametrize("keys", [["a"], ["b", "a"], ["t", "a"]])
@pytest.mark.parametrize("bytes_", [1 << 10, 1 << 40])
def test_source_ids_by_ranges(spark, monkeypatch, keys, bytes_):
    monkeypatch.setattr(tables_module, "scanned_bytes", lambda df: bytes_)
    rnd = random.Random(8)
    data = [(a, rnd.choice([None, 1, 2, *range(50)]), rnd.choice([None, "", "x", "é", "zz"])) for a in rnd.sample(range(10_000), 700)]
    got = with_row_ids(spark.createDataFrame(data, "a long, b int, t string").repartition(7), keys).collect()
    place = {"a": 0, "b": 1, "t": 2}
    want = sorted(data, key=lambda r: [(r[place[k]] is None, r[place[k]] if r[place[k]] is not None else 0 if k != "t" else "") for k in keys])
    assert [tuple(r)[1:] for r in sorted(got, key=lambda r: r._row_id)] == want and [r._row_id for r in sorted(got, key=lambda r: r._row_id)] == list(range(700))
    assert with_row_ids(spark.createDataFrame([], "a long, b int, t string"), keys).count() == 0


def test_no_source_is_numbered_in_one_task(spark, tmp_path):
    spark.range(1000).selectExpr("id AS doc_id", "cast(id % 7 AS string) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    found = resolver(spark, str(tmp_path))
    plan_text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    main = plan_text(run_plan(plan_of("documents", where(call("eq", "text", lit("3")))), found)).split("Subquery")[0]
    assert "Window" in main and "SinglePartition" not in main
    # and no one who doesn't ask for ids pays for them
    assert "Window" not in plan_text(run_plan(plan_of("documents", aggregate(["text"], ("n", "count"))), found).where("n > 1")).split("Scan")[1]


# ---- semantic steps

TEXTS = ["Please refund me!", "I am unsure", "good day", "", None, "  \t ", "REFUND!!! now!", "thanks", "unsure about a refund"]
QUESTION = {"name": "money", "kind": "boolean", "instruction": "Is it about money?", "thresholds": {"mode": "fixed"}}
ANNOTATE = {"op": "semantic_annotate", "columns": ["text"], "questions": [QUESTION, {"name": "urgency", "kind": "score", "instruction": "How urgent?", "levels": ["low", "mid", "high"]}]}


def plain_answer(text):
    """(probability, exclamation marks up to 2) by the judge's rules, or None without a text."""
    if not (text or "").strip():
        return None
    return (0.92 if "refund" in text.lower() else 0.5 if "unsure" in text.lower() else 0.04), min(2, text.count("!"))


@pytest.fixture(scope="module")
def support(spark):
    return Resolver({"t": spark.createDataFrame(list(enumerate(TEXTS)), "_row_id long, text string")})


def test_annotate_gates_and_reviews(support):
    relations = answer_all(plan_of("t", ANNOTATE, where(call("eq", "money.value", lit(True))), sort("-urgency.score")), support, JUDGE)
    answers = {i: plain_answer(t) for i, t in enumerate(TEXTS)}
    sure = [i for i, a in answers.items() if a and a[0] >= 0.85]
    assert [r["_row_id"] for r in relations["s2"].ordered().collect()] == sorted(sure, key=lambda i: (-answers[i][1], i))
    review = {r["_row_id"]: r["money.status"] for r in relations["s1__review"].df.collect()}
    assert review == {i: "uncertain" if a else "missing" for i, a in answers.items() if a is None or 0.15 < a[0] < 0.85}
    assert {r["_row_id"]: r["urgency.value"] for r in relations["s0"].df.collect()} == {i: a and ["low", "mid", "high"][a[1]] for i, a in answers.items()}
    assert not relations["s2"].provisional


def test_without_answers_all_is_pending(support):
    relations = Compiler(support).compile(plan_of("t", ANNOTATE, where(call("eq", "money.value", lit(True)), unknown_policy="include"), aggregate(["money.status"], ("n", "count"))))
    assert {r["money.status"] for r in relations["s0"].df.collect()} == {"pending"} and relations["s2"].provisional and relations["s1"].df.count() == 0


def test_overrides_win(spark, support):
    support.overrides = overrides(spark, [(1, "money.value", "false"), (1, "money.value", "true"), (0, "money.value", None)])
    got = {r["_row_id"]: (r["money.value"], r["money.status"]) for r in answer_all(plan_of("t", ANNOTATE), support, JUDGE)["s0"].df.collect()}
    support.overrides = None
    assert got[1] == (True, "override") and got[0] == (None, "override") and got[2] == (False, "ok")


def test_batch_judge_answers_as_rules_do(support):
    known = {f"text: {t}": plain_answer(t) for t in TEXTS if plain_answer(t)}  # goes to the workers, as this module doesn't

    def answer(texts, questions):
        return [{q["name"]: {"p": known[t][0]} if q["kind"] == "boolean" else {"score": float(known[t][1]), "level": known[t][1], "confidence": 0.8} for q in questions} for t in texts]

    want = answer_all(plan_of("t", ANNOTATE), support, JUDGE)["s0"].df.collect()
    assert sorted(map(str, answer_all(plan_of("t", ANNOTATE), support, BatchJudge(answer))["s0"].df.collect())) == sorted(map(str, want))


def test_each_payload_is_asked_once(spark, tmp_path):
    texts = [f"row {i % 11}" for i in range(60)]
    folder = str(tmp_path)

    def answer(found, questions):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:  # by whichever process asks
            f.write("\n".join(found))
        if "text: row 3" in found:
            raise RequestFailed("no answer")
        return [{q["name"]: {"p": 0.9} for q in questions} for _ in found]

    step = parse_plan(plan_of("t", ANNOTATE | {"questions": [QUESTION]})).steps[0]
    made = annotate(spark.createDataFrame(list(enumerate(texts)), "_row_id long, text string"), step, BatchJudge(answer, rows_per_request=1))
    got = {r["_row_id"]: r["money.status"] for r in made.answers.collect()}
    assert got == {i: "failed" if t == "row 3" else "ok" for i, t in enumerate(texts)}
    assert made.entries.count() == 10 and made.asked.count() == 11
    asked = [line for p in tmp_path.iterdir() for line in p.read_text().split("\n")]
    assert sorted(asked) == sorted(f"text: {t}" for t in set(texts))


def test_cells_are_cleaned(spark):
    df = spark.createDataFrame([(" a　",), ("\t\n",), (None,)], "t string")
    assert [r[0] for r in df.select(clean_cell(df, "t")).collect()] == ["a", None, None]


def test_cache_key_ignores_names_and_thresholds(spark):
    from pyspark.sql import functions as F

    a, b, c = Question("a", "boolean", "same"), Question("b", "boolean", "same", true_min=0.9), Question("a", "boolean", "other")
    one = spark.range(1).select(*(cache_key(F.lit("x"), q, "m", "w").alias(f"k{i}") for i, q in enumerate((a, b, c)))).first()
    assert one[0] == one[1] != one[2]


def test_packing():
    packed = list(pack([10] * 25 + [40_000, 30_000, 30_000, 30_000], [50], 10))
    assert [len(p) for p in packed] == [10, 10, 7, 1] and 25 not in sum(packed, [])
    assert tokens_of("") == 1 and tokens_of("abcd") == 3


# ---- calibration


def bins(scores):
    counts = [0] * 100
    for s in scores:
        counts[min(int(min(max(s, 0), 1) * 100), 99)] += 1
    return counts


def plain_cut(scores):
    """Otsu's edge by the variance between both sides, computed for each edge from all scores."""
    centres = [(min(int(min(max(x, 0), 1) * 100), 99) + 0.5) / 100 for x in scores]
    apart = {}
    for edge in range(1, 100):
        low, high = ([c for c in centres if (c < edge / 100) == side] for side in (True, False))
        if low and high:
            apart[edge] = len(low) * len(high) / len(scores) ** 2 * (sum(low) / len(low) - sum(high) / len(high)) ** 2
    if not apart:
        return (round(centres[0] * 100 - 0.5) + 1) / 100
    return round(statistics.median(e for e, v in apart.items() if v > max(apart.values()) - 1e-11) / 100, 4)


def test_cuts():
    rnd = random.Random(31)
    for mix in ([(0.1, 0.05, 120), (0.7, 0.1, 30)], [(0.5, 0.2, 90)], [(0.02, 0.01, 200), (0.97, 0.01, 3)], [(0.9, 0.03, 80)], [(0.3, 0.0, 60)], [(0.1, 0.0, 50), (0.5, 0.0, 1), (0.9, 0.0, 50)]):
        scores = [rnd.gauss(m, d) for m, d, n in mix for _ in range(n)]
        found = find_cut(bins(scores))
        assert found.otsu == pytest.approx(plain_cut(scores)) and found.cut == min(0.8, max(0.2, found.otsu)) and found.clamped == (found.cut != found.otsu)
    assert find_cut(bins([0.4] * 49)).cut is None and find_cut(bins([0.4] * 50)).otsu == otsu(bins([0.4])) == 0.41 and find_cut(bins([0.1] * 200), "fixed").cut is None


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=50, max_size=200))
def test_cut_is_within_bounds(scores):
    assert 0.2 <= find_cut(bins(scores)).cut <= 0.8


def test_calibrated_stage(spark):
    rnd = random.Random(77)
    scores = [round(min(0.99, max(0.0, rnd.gauss(0.12, 0.08))), 2) for _ in range(150)] + [round(min(0.99, rnd.gauss(0.66, 0.15)), 2) for _ in range(60)]
    table = spark.createDataFrame([(i, f"line {i} p={s:.2f}") for i, s in enumerate(scores)], "_row_id long, text string")
    auto = {"op": "semantic_annotate", "columns": ["text"], "questions": [{"name": "q", "kind": "boolean", "instruction": "yes?"}]}
    cut = min(0.8, max(0.2, plain_cut(scores)))
    for n in (1, 7):
        got = answer_all(plan_of("t", auto), Resolver({"t": table.repartition(n)}), JUDGE)["s0"].df.collect()
        assert {r["_row_id"]: (r["q.value"], r["q.near"], r["q.status"]) for r in got} == {i: (s >= cut, abs(s - cut) <= 0.1 + 1e-12, "ok") for i, s in enumerate(scores)}
    assert 0 < sum(s >= cut for s in scores) < 210


# ---- matching


def test_match(spark):
    goods = ["oak table, round", "garden-hose 20 m", "Wall clock", "blue mug", "blue mug large"]
    asked = ["OAK TABLE, ROUND", "garden hose 20-m", "sun hat", "Blue Mug", None, "clock wall"]
    left, right = spark.createDataFrame(list(enumerate(asked)), "_row_id long, wish string"), spark.createDataFrame([(i, g, f"G{i}") for i, g in enumerate(goods)], "_row_id long, name string, code string")
    step = {"op": "semantic_match", "right": {"dataset_id": "r"}, "left_columns": ["wish"], "right_columns": ["name"], "instruction": "the same thing?", "threshold_mode": "fixed"}
    resolver = Resolver({"l": left, "r": right})
    got = {r["_row_id"]: r for r in run(plan_of("l", step), resolver, JUDGE).collect()}
    plain = lambda t: t.replace("-", " ").lower()
    for i, wish in enumerate(asked):
        same = next((k for k, g in enumerate(goods) if plain(g) == plain(wish or "")), None)
        assert (got[i]["match.code"], got[i]["match.status"]) == ((f"G{same}", "matched") if same is not None else (None, "unmatched"))
        best = sorted(range(5), key=lambda k: (-token_set_ratio(wish or "", goods[k]), k))
        assert [c["right_row_id"] for c in json.loads(got[i]["match.candidates"])] == best
    kept = run(plan_of("l", step, where(call("gte", "match.score", 0.9))), resolver, JUDGE)
    assert [r["_row_id"] for r in kept.collect()] == [i for i in got if got[i]["match.status"] == "matched"]
    blocked = step | {"blocking": {"left": "wish", "right": "code"}}
    assert {r["match.status"] for r in run(plan_of("l", blocked), resolver, JUDGE).collect()} == {"no_candidates"}


def test_match_blocked_matches_every_customer(spark, tmp_path):
    rnd = random.Random(4)
    suppliers = [(k, f"{rnd.choice(['Steel', 'Brass', 'Tin'])} works {k % 9}", rnd.choice([None, *range(6)])) for k in range(40)]
    customers = [(k, s[1].replace(" ", "-") if k % 50 == 0 else f"{rnd.choice(['steel', 'Brass', 'old'])} works {k % 11}", s[2] if k % 50 == 0 else rnd.choice([None, *range(8)])) for k in range(700) for s in [rnd.choice(suppliers)]]
    rnd.shuffle(customers)
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["_row_id"]: r for r in QUERIES["match_blocked"](spark, str(tmp_path)).collect()}
    assert len(got) == len(customers)
    plain = lambda t: t.replace("-", " ").lower()
    for rid, (_, named, nation) in enumerate(sorted(customers)):
        found = sorted(((-token_set_ratio(named, s), k, s) for k, s, n in suppliers if n == nation), key=lambda x: x[:2])[:5]
        r = got[rid]
        assert r["c_name"] == named
        assert [(c["right_row_id"], c["retrieval_score"]) for c in json.loads(r["match_candidates"])] == [(k, pytest.approx(-s, abs=1e-3)) for s, k, _ in found]
        best = next((k for _, k, s in found if plain(s) == plain(named)), None)
        assert r["match_status"] == ("no_candidates" if not found else "unmatched" if best is None else "matched")
        assert r["match_right_row_id"] == best and r["match_s_name"] == (suppliers[best][1] if best is not None else None)
    assert {"matched", "unmatched"} <= {r["match_status"] for k, r in got.items() if k >= 300}


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *(max(row[j] + 1 if x == y else 0, row[j + 1]) for j, y in enumerate(b))]
        for j in range(1, len(row)):
            row[j] = max(row[j], row[j - 1])
    return row[-1]


def test_similarity():
    rnd = random.Random(0)
    for _ in range(400):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randrange(90))) for _ in range(2))
        assert common_subsequence(a, b) == plain_lcs(a, b) and indel_distance(a, b) == indel_distance(b, a)
        assert token_set_ratio(a, b) == pytest.approx(token_set_ratio(b, a)) and 0 <= token_set_ratio(a, b) <= 100
    assert token_set_ratio("a b c", "c b") == 100 and token_set_ratio("", "a") == 0 and token_set_ratio("ab", "cd") == 0


def test_token_sets_compare_with_many_at_once():
    rnd = random.Random(9)
    for size, long, tokens in ((1, 4, 2), (30, 3, 3), (90, 12, 2), (90, 150, 1), (120, 2, 6)):
        words = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(1, long + 1))) for _ in range(12)]
        some = lambda: frozenset(rnd.sample(words, rnd.randrange(min(12, tokens) + 1)))
        sets = [some() for _ in range(size)]
        compared = TokenSets(sets)
        for x in [some() for _ in range(20)]:
            assert compared.ratios(x).tolist() == [token_sets_ratio(x, y) for y in sets]


def many_suppliers(spark, folder, n=5_300):
    """As match_blocked's tables, with more right rows than were once let through, of 700 names."""
    customers = [(k, f"works {k % 7} ab{k}", k % 3) for k in range(25)] + [(5_290, "firm-3", 1)]
    suppliers = [(k, f"firm {k % 700}", k % 3) for k in range(n)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey long").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey long").write.parquet(f"{folder}/supplier.parquet")
    return customers, suppliers


@pytest.mark.parametrize("slice_rows", [None, 1_000])
def test_match_blocked_takes_every_right_row(spark, tmp_path, monkeypatch, slice_rows):
    if slice_rows:
        monkeypatch.setattr(matching.candidates, "__defaults__", (slice_rows,))
    customers, suppliers = many_suppliers(spark, tmp_path)
    got = {r["_row_id"]: r for r in QUERIES["match_blocked"](spark, str(tmp_path)).collect()}
    assert len(got) == len(customers)
    for rid, (_, named, nation) in enumerate(customers):
        found = sorted((-token_set_ratio(named, s), k) for k, s, n in suppliers if n == nation)[:5]
        assert [(c["right_row_id"], c["retrieval_score"]) for c in json.loads(got[rid]["match_candidates"])] == [(k, pytest.approx(-s, abs=1e-3)) for s, k in found]
    assert got[25]["match_status"] == "matched"


def test_match_no_candidates_takes_every_right_row(spark, tmp_path):
    customers, _ = many_suppliers(spark, tmp_path)
    got = {r["_row_id"]: r["match_status"] for r in QUERIES["match_no_candidates"](spark, str(tmp_path)).collect()}
    assert got == {i: "unmatched" for i in range(len(customers))}  # each customer's key is a supplier's


# ---- texts too long for a request, which no rule sends


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Documents of which some are too long for a service: (quiet, rude, doubtful, short, none, long and quiet)."""
    folder, long = str(tmp_path_factory.mktemp("long")), 130_000
    texts = ["q" * long + "!", "x" * long + " idiot", "the " * (long // 4), "a short one", None, "z" * long + "!!!"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_annotate_boolean_fixed_reads_long_texts(spark, long_texts):
    got = rows(QUERIES["annotate_boolean_fixed"](spark, long_texts).orderBy("_row_id").select("rude_value", "rude_score", "rude_status"))
    assert got == [(False, 0.04, "ok"), (True, 0.92, "ok"), (None, 0.5, "uncertain"), (False, 0.04, "ok"), (None, None, "missing"), (False, 0.04, "ok")]


def test_a_service_is_not_sent_texts_too_long(spark, long_texts):
    judge = BatchJudge(lambda texts, questions: [{questions[0]["name"]: {"p": 0.9}} for _ in texts])
    found = run(plan_of("documents", {"op": "semantic_annotate", "columns": ["text"], "questions": [QUESTION]}), resolver(spark, long_texts), judge)
    assert [r["money.status"] for r in found.collect()] == ["input_too_long"] * 3 + ["ok", "missing", "input_too_long"]


def test_annotate_score_reads_long_texts(spark, long_texts):
    got = rows(QUERIES["annotate_score"](spark, long_texts).orderBy("_row_id").select("urgency_value", "urgency_score", "urgency_status"))
    assert got[0] == ("middle", 1.0, "ok") and got[5] == ("high", 2.0, "ok")


def test_annotate_then_aggregate_counts_long_texts(spark, long_texts):
    assert rows(QUERIES["annotate_then_aggregate"](spark, long_texts).orderBy("_row_id")) == [(0, "missing", 1), (1, "ok", 4), (2, "uncertain", 1)]


def test_filter_gate_include_keeps_long_texts(spark, long_texts):
    assert rows(QUERIES["filter_gate_include"](spark, long_texts).orderBy("_row_id")) == [(1, 1, "ok"), (2, 2, "uncertain")]


def test_override_overlay_keeps_answers_of_long_texts(spark, long_texts):
    got = rows(QUERIES["override_overlay"](spark, long_texts).orderBy("_row_id").select("rude_value", "rude_status"))
    assert got == [(False, "ok"), (True, "ok"), (None, "uncertain"), (True, "override"), (None, "missing"), (None, "override")]


# ---- odd texts, held against the queries' SQL


def equals_sql(spark, folder, key, texts):
    """The query's rows over documents of these texts, which have to be those of its SQL."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    made, duck = QUERIES[key](spark, str(folder)), duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    got = sorted(rows(made))
    assert got == sorted(duck.execute(f"SELECT {', '.join(made.columns)} FROM ({SQL[key]})").fetchall())
    return got


def test_annotate_score_asks_about_rows_without_a_text(spark, tmp_path):
    got = equals_sql(spark, tmp_path, "annotate_score", ["now!", None, "", " \n\t", "\u3000", "now!!!"])
    assert [r[1:] for r in got] == [("middle", 1.0, "ok"), *[("low", 0.0, "ok")] * 4, ("high", 2.0, "ok")]


def test_annotate_then_aggregate_takes_no_scores_from_texts(spark, tmp_path):
    got = equals_sql(spark, tmp_path, "annotate_then_aggregate", ["http://x?p=0.9", "the p=0.1 idiot", "step=0.5", "a the p=0.99", None])
    assert got == [(0, "missing", 1), (1, "ok", 3), (2, "uncertain", 1)]


def test_filter_gate_include_lowers_dotted_capitals(spark, tmp_path):
    got = equals_sql(spark, tmp_path, "filter_gate_include", ["\u0130D\u0130OT!", "ID\u0130OT", "\u0131diot", "THE \u0130", "idio\u03a3"])
    assert got == [(0, 0, "ok"), (1, 1, "ok"), (3, 3, "uncertain")]


def test_override_overlay_keeps_white_space_that_sql_keeps(spark, tmp_path):
    got = equals_sql(spark, tmp_path, "override_overlay", ["a the \u00a0", "\u3000", "a the \x0b", "x", "a the \n\f", None, " \t\r\n", "\x1c", "\u2003idiot\x85"])
    assert [r[2] for r in got] == ["uncertain", "ok", "uncertain", "override", "ok", "override", "missing", "ok", "ok"]
