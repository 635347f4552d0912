"""Evaluation metrics as aggregates: each gives a table of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rowids import counted_ids


def _ratio(a: Column, b: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def precision_recall(found: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1, jaccard) of two sets of keys; null keys are in neither.

    Without found keys there is no precision, without gold ones no recall, without either no
    f1 and no jaccard.
    """
    f = found.select(F.col(key).alias("k"), F.lit(1).alias("f")).where("k is not null").distinct()
    g = gold.select(F.col(key).alias("k"), F.lit(1).alias("g")).where("k is not null").distinct()
    both = f.join(g, "k", "full")
    counts = both.agg(F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return counts.select("tp", "fp", "fn", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp, tp + fp + fn).alias("jaccard"))


def _contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(x, y, n, rows, columns, total): the table of two labellings with its margins."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    margin = lambda *by: F.sum("n").over(Window.partitionBy(*by))
    return cells.select("x", "y", "n", margin("x").alias("nx"), margin("y").alias("ny"), margin().alias("total"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(kappa) of two labellings of the same rows; 1 if chance alone would make them agree, null without rows."""
    cells = _contingency(df, a, b)
    chosen = cells.where("x = y").agg(F.sum("n").alias("agree"), F.sum(F.col("nx").cast("double") * F.col("ny")).alias("chance"))
    total = cells.agg(F.max("total").alias("t"))
    po, pe = F.coalesce("agree", F.lit(0)) / F.col("t"), F.coalesce("chance", F.lit(0.0)) / (F.col("t").cast("double") * F.col("t"))
    return chosen.crossJoin(total).select(F.when(F.col("t") > 0, F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0)).alias("kappa"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ari) of two clusterings; null below two rows."""
    cells = _contingency(df, a, b)
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    # each margin's pairs are shared out over its cells, so that one pass sums them
    got = cells.agg(F.sum(pairs("n")).alias("s"), F.sum(pairs("nx") * F.col("n") / F.col("nx")).alias("sx"), F.sum(pairs("ny") * F.col("n") / F.col("ny")).alias("sy"), F.max(pairs("total")).alias("t"))
    expected, most = F.try_divide(F.col("sx") * F.col("sy"), F.col("t")), (F.col("sx") + F.col("sy")) / 2
    return got.select(F.when(F.col("t") > 0, F.when(most != expected, (F.col("s") - expected) / (most - expected)).otherwise(1.0)).alias("ari"))


def normalized_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """(nmi) of two clusterings, by the geometric mean of both entropies; of two without entropy 1, of one without or no rows null."""
    cells = _contingency(df, a, b)
    n, nx, ny, t = (F.col(c).cast("double") for c in ("n", "nx", "ny", "total"))
    got = cells.agg(F.sum(n / t * F.log(n * t / (nx * ny))).alias("mi"), F.sum(-n / t * F.log(nx / t)).alias("hx"), F.sum(-n / t * F.log(ny / t)).alias("hy"))
    mean = F.sqrt(F.col("hx") * F.col("hy"))
    return got.select(F.when(mean > 0, F.col("mi") / mean).when((F.col("hx") <= 0) & (F.col("hy") <= 0), 1.0).alias("nmi"))


def spearman(left: DataFrame, right: DataFrame, key: str, score: str) -> DataFrame:
    """(rho, n) of two rankings on their common keys, ranks by score, greatest first, then key; null below three keys."""
    met = left.select(F.col(key).alias("k"), F.col(score).alias("a")).join(right.select(F.col(key).alias("k"), F.col(score).alias("b")), "k")
    by_a, _ = counted_ids(met, [F.col("a").desc_nulls_last(), F.col("k")], "ra")
    ranked, _ = counted_ids(by_a, [F.col("b").desc_nulls_last(), F.col("k")], "rb")
    d = (F.col("ra") - F.col("rb")).cast("double")
    got = ranked.agg(F.sum(d * d).alias("s"), F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    return got.select(F.when(n > 2, 1 - 6 * F.col("s") / (n * (n * n - 1))).alias("rho"), "n")


def top_k_overlap(left: DataFrame, right: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """(overlap): the share of the k best of either that the other has as well."""
    best = lambda df: df.orderBy(F.col(score).desc_nulls_last(), key).limit(k).select(key)
    return best(left).join(best(right), key).agg((F.count(F.lit(1)) / F.lit(float(k))).alias("overlap"))


def class_report(df: DataFrame, gold: str, found: str) -> DataFrame:
    """(label, support, precision, recall, f1) by class; a null prediction is a miss."""
    rows = df.where(F.col(gold).isNotNull()).select(F.col(gold).cast("string").alias("g"), F.col(found).cast("string").alias("f"))
    both = rows.select(F.explode(F.array(F.struct(F.col("g").alias("label"), F.lit(1).alias("gold"), F.coalesce(F.col("g") == F.col("f"), F.lit(False)).cast("int").alias("hit"), F.lit(0).alias("said")), F.struct(F.col("f").alias("label"), F.lit(0).alias("gold"), F.lit(0).alias("hit"), F.lit(1).alias("said")))).alias("r")).select("r.*")
    got = both.where("label is not null").groupBy("label").agg(F.sum("gold").alias("support"), F.sum("hit").alias("tp"), F.sum("said").alias("said"))
    tp = F.col("tp")
    return got.select("label", "support", _ratio(tp, F.col("said")).alias("precision"), _ratio(tp, F.col("support")).alias("recall"), _ratio(2 * tp, F.col("said") + F.col("support")).alias("f1"))


def class_summary(df: DataFrame, gold: str, found: str, classes: list[str]) -> DataFrame:
    """(macro_f1, accuracy_in_scope): the mean f1 of some classes, and the share of right rows among those that either side puts in one of them.

    A class that neither side has is left out of the mean; without any, both are null.
    """
    per = class_report(df, gold, found).where(F.col("label").isin(*classes))
    rows = df.where(F.col(gold).isNotNull()).select(F.col(gold).cast("string").alias("g"), F.col(found).cast("string").alias("f"))
    scope = rows.where(F.col("g").isin(*classes) | F.coalesce(F.col("f").isin(*classes), F.lit(False)))
    right = scope.agg(F.avg(F.coalesce(F.col("g") == F.col("f"), F.lit(False)).cast("int")).alias("accuracy_in_scope"))
    return per.agg(F.avg("f1").alias("macro_f1")).select("macro_f1", right.scalar().alias("accuracy_in_scope"))


def cell_errors(found: DataFrame, gold: DataFrame, keys: list[str], value: str, tolerance: float = 0.005) -> DataFrame:
    """(cells, exact, within_1pct, wrong, missing, extra) of a table of sums against the true one."""
    f = found.select(*keys, F.col(value).alias("a"), F.lit(1).alias("has_a"))
    g = gold.select(*keys, F.col(value).alias("b"), F.lit(1).alias("has_b"))
    met = f.join(g, keys, "full")
    gap = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    kind = F.when(F.col("has_a").isNull(), "missing").when(F.col("has_b").isNull(), "extra").when(gap <= tolerance, "exact").when(gap <= 0.01 * F.abs(F.col("b")), "within_1pct").otherwise("wrong")
    return met.agg(F.count_if(F.col("has_b").isNotNull()).alias("cells"), *(F.count_if(kind == k).alias(k) for k in ("exact", "within_1pct", "wrong", "missing", "extra")))


def score_summary(df: DataFrame, score: str, bins: int = 10) -> DataFrame:
    """(bin, n, low, high) histogram of scores from 0 to 1; nulls are left out."""
    c = F.col(score)
    at = F.least(F.floor(c * bins).cast("int"), F.lit(bins - 1))
    return df.where(c.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("low"), F.max(c).alias("high"))


def nearest_rank(df: DataFrame, score: str, shares: list[float]) -> DataFrame:
    """(share, value): nearest-rank percentiles, exact."""
    ranked, n = counted_ids(df.where(F.col(score).isNotNull()).select(F.col(score).alias("value")), [F.col("value")], "r")
    wanted = F.explode(F.array(*(F.struct(F.lit(float(x)).alias("share"), F.lit(min(int(x * n), n - 1)).cast("bigint").alias("at")) for x in shares)))
    return ranked.select("value", "r", wanted.alias("w")).where("r = w.at").select("w.share", "value")


def score_percentiles(df: DataFrame, score: str) -> DataFrame:
    """(n, min, p50, p90, p99, max) of scores, by nearest rank; nulls are left out."""
    shares = {"min": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "max": 1.0}
    found = nearest_rank(df, score, list(shares.values()))
    n = df.where(F.col(score).isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    return found.agg(*(F.max(F.when(F.col("share") == x, F.col("value"))).alias(c) for c, x in shares.items())).select(n.scalar().alias("n"), *shares)
