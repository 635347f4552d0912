"""The decision cut: Otsu's threshold on a histogram of scores, without labels."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rule.
BINS, LEAST_SCORES = 100, 50
LOWEST, HIGHEST, MARGIN = 0.20, 0.80, 0.10
SAME = 1e-12


@dataclass(frozen=True)
class Cut:
    cut: float | None  # None: too few scores, the fixed thresholds stand
    otsu: float | None
    scores: int
    clamped: bool = False


def otsu(counts: list[int]) -> float:
    """The edge between bins that parts the scores best, the median of the best edges if several are; of one bin only, its upper edge."""
    n = len(counts)
    filled = [i for i, c in enumerate(counts) if c]
    if len(filled) == 1:
        return round((filled[0] + 1) / n, 4)
    total, weighted = sum(counts), sum(c * (i + 0.5) / n for i, c in enumerate(counts))
    best, edges, below, sum_below = -1.0, [], 0, 0.0
    for edge in range(1, n):
        below += counts[edge - 1]
        sum_below += counts[edge - 1] * (edge - 0.5) / n
        above = total - below
        if not below or not above:
            continue
        apart = below / total * (above / total) * (sum_below / below - (weighted - sum_below) / above) ** 2
        if apart > best + SAME:
            best, edges = apart, [edge]
        elif abs(apart - best) <= SAME:
            edges.append(edge)
    return round(median(edges) / n, 4)


def find_cut(counts: list[int], mode: str = "auto") -> Cut:
    total = sum(counts)
    if mode != "auto" or total < LEAST_SCORES:
        return Cut(None, None, total)
    raw = otsu(counts)
    cut = min(HIGHEST, max(LOWEST, raw))
    return Cut(cut, raw, total, cut != raw)


def score_bin(score: Column) -> Column:
    clamped = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return F.least(F.floor(clamped * BINS).cast("int"), F.lit(BINS - 1))


def histogram(df: DataFrame, score: Column) -> list[int]:
    """Counts by bin; whole numbers, so that no partitioning changes them. BINS rows at most come to the driver."""
    found = df.where(score.isNotNull()).groupBy(score_bin(score).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = [0] * BINS
    for r in found:
        counts[r["bin"]] = r["n"]
    return counts


def decided(score: Column, cut: float) -> tuple[Column, Column]:
    """(value, near) of a score under a cut."""
    return score >= cut, F.abs(score - cut) <= MARGIN + SAME


def calibrate_boolean(answers: DataFrame, question: str, mode: str = "auto") -> tuple[DataFrame, Cut]:
    """Answers with value, near and status rewritten by the cut; rows without a score stay as they are."""
    value, score, near, status = (F.col(f"`{question}.{n}`") for n in ("value", "score", "near", "status"))
    counted = status.isin("ok", "uncertain") & score.isNotNull()
    cut = find_cut(histogram(answers.where(counted), score), mode)
    if cut.cut is None:
        return answers, cut
    is_true, is_near = decided(score, cut.cut)
    new = {f"{question}.value": F.when(counted, is_true).otherwise(value), f"{question}.near": F.when(counted, is_near).otherwise(near), f"{question}.status": F.when(counted, F.lit("ok")).otherwise(status)}
    return answers.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in answers.columns)), cut


def calibrate_match(answers: DataFrame, match: str, mode: str = "auto") -> tuple[DataFrame, Cut]:
    """Match answers rewritten by the cut over the best candidates' probabilities; unscored counts candidates that no judge answered."""
    score, near, status, right = (F.col(f"`{match}.{n}`") for n in ("score", "near", "status", "right_row_id"))
    counted = status.isin("matched", "uncertain", "unmatched") & score.isNotNull()
    cut = find_cut(histogram(answers.where(counted), score), mode)
    if cut.cut is None:
        return answers, cut
    is_match, is_near = decided(score, cut.cut)
    decision = F.when(is_match, "matched").when(F.col(f"`{match}.unscored`") > 0, "uncertain").otherwise("unmatched")
    best = F.coalesce(F.col(f"`{match}.best_row_id`"), right)
    new = {f"{match}.status": F.when(counted, decision).otherwise(status), f"{match}.near": F.when(counted, is_near).otherwise(near), f"{match}.right_row_id": F.when(counted, F.when(decision == "unmatched", F.lit(None)).otherwise(best)).otherwise(right)}
    return answers.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in answers.columns)), cut
