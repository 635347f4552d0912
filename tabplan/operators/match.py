"""semantic_match: candidates by words within a block, verified pair by pair, and one decision for each left row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import TokenSets
from ..plans.errors import PlanError
from ..plans.relation import ROW_ID, name
from ..plans.spec import Step
from ..sources.tables import materialize
from .annotate import clean_cell
from .judge import ITEM_TOKENS, Judge, estimated_tokens, tokens_of

#: Fixed values of the step: rows of the right table that go to every task at a time; pairs of a job.
SLICE_ROWS, MAX_PAIRS = 100_000, 100_000


def _joined(df: DataFrame, columns) -> object:
    return F.concat_ws(" | ", *(F.coalesce(clean_cell(df, c), F.lit("")) for c in columns))


class Block:
    """The right rows of a block, those of equal tokens together, as they are equally like any text."""

    def __init__(self, rows: list[tuple[int, str]], best: int):
        self.best, held = best, {}
        for place, (rid, text) in enumerate(rows):
            same = held.setdefault(frozenset(text.split()), [])
            if len(same) < best:  # more of them are never among the best
                same.append((place, rid, text))
        self.tokens, self.rows = TokenSets(list(held)), list(held.values())

    def nearest(self, text: str) -> list[tuple[int, str, float]]:
        """(right id, text, similarity) of the best rows; among equally similar ones the first."""
        scores, first = self.tokens.ratios(frozenset(text.split())), None
        if len(scores) > self.best:
            least = np.partition(scores, -self.best)[-self.best]
            first = [*np.flatnonzero(scores > least), *np.flatnonzero(scores == least)[: self.best]]
        found = nsmallest(self.best, ((-float(scores[i]), *row) for i in (range(len(scores)) if first is None else first) for row in self.rows[i]))
        return [(rid, other, -score) for score, _, rid, other in found]


def _slices(r: DataFrame, rows: int) -> Iterator[list[Row]]:
    """The right table's rows by their ids, so many at a time."""
    last = None
    while held := (r if last is None else r.where(F.col("rid") > last)).orderBy("rid").limit(rows).collect():
        yield held
        if len(held) < rows:
            return
        last = held[-1]["rid"]


def candidates(left: DataFrame, right: DataFrame, step: Step, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(_row_id, left_text, right_row_id, right_text, retrieval_score, rank): the best right rows of each left row.

    The right table goes to every task by block, so that no row is shuffled and no pair is
    made but those kept; a table of more than slice_rows rows goes there in slices, whose
    best rows are compared once more. Blocks are equal cleaned cells, and null meets null.
    Among equal scores the order of the right rows decides.
    """
    block = step.blocking
    r = right.select(name(ROW_ID).alias("rid"), _joined(right, step.right_columns).alias("text"), (clean_cell(right, block[1]) if block else F.lit("")).alias("block"))
    rows = left.select(name(ROW_ID).alias("rid"), _joined(left, step.left_columns).alias("text"), (clean_cell(left, block[0]) if block else F.lit("")).alias("block"))
    # the rows are small and comparing them is not: they are dealt to all cores, equal ones to the same
    rows = rows.repartition(left.sparkSession.sparkContext.defaultParallelism, "block", "text")
    found = [_nearest(rows, held, step.candidates_per_row) for held in _slices(r, slice_rows)]
    if not found:
        return _nearest(rows, [], step.candidates_per_row)
    if len(found) == 1:
        return found[0]
    kept = reduce(DataFrame.unionByName, found).groupBy(ROW_ID, "left_text").agg(F.sort_array(F.collect_list(F.struct((-F.col("retrieval_score")).alias("s"), "right_row_id", "right_text"))).alias("best"))
    each = kept.select(ROW_ID, "left_text", F.posexplode(F.slice("best", 1, step.candidates_per_row)).alias("rank", "c"))
    return each.select(ROW_ID, "left_text", "c.right_row_id", "c.right_text", (-F.col("c.s")).alias("retrieval_score"), "rank")


def _nearest(rows: DataFrame, held: list[Row], best: int) -> DataFrame:
    """candidates() among the right rows held, of rows (rid, text, block)."""
    by_block: dict[str | None, list[tuple[int, str]]] = {}
    for row in held:
        by_block.setdefault(row["block"], []).append((row["rid"], row["text"]))
    schema = pa.schema([("_row_id", pa.int64()), ("left_text", pa.string()), ("right_row_id", pa.int64()), ("right_text", pa.string()), ("retrieval_score", pa.float64()), ("rank", pa.int32())])
    sent = rows.sparkSession.sparkContext.broadcast(by_block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_block, blocks = sent.value, {}
        seen: dict[tuple[str | None, str], list[tuple]] = {}
        for batch in batches:
            out = []
            for rid, text, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, text) not in seen:
                    if len(seen) > 50_000:
                        seen.clear()
                    if block not in blocks:
                        blocks[block] = Block(by_block.get(block, []), best)
                    seen[block, text] = [(*c, k) for k, c in enumerate(blocks[block].nearest(text))]
                out += [(rid, text, *found) for found in seen[block, text]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(schema), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "_row_id long, left_text string, right_row_id long, right_text string, retrieval_score double, rank int")


def match(left: DataFrame, right: DataFrame, step: Step, judge: Judge, max_pairs: int | None = None, allow: Callable[[int, int], None] | None = None) -> DataFrame:
    """Answers by _row_id: right_row_id, score, near, status, candidates (JSON), best_row_id and unscored.

    The best candidate is that of the highest probability, the first retrieved on a tie. It
    is matched from accept_min on and unmatched up to reject_max, but uncertain between, or
    if unmatched while a pair had no answer. Rows without candidates are no_candidates, and
    those of which no pair had an answer failed. `allow` hears, before the judge is asked,
    about how many pairs and tokens, and may raise.
    """
    found = candidates(left, right, step)
    if max_pairs is not None or allow is not None:
        found = materialize(found)
        n, tokens = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(estimated_tokens(F.col("left_text")) + estimated_tokens(F.col("right_text"))), F.lit(0))).first()
        if max_pairs is not None and n > max_pairs:
            raise PlanError(step.id, "pair_budget", f"more than {max_pairs} pairs", "use a blocking key or fewer candidates")
        if allow is not None:
            allow(n, tokens + n * (tokens_of(step.instruction) + ITEM_TOKENS))
    scored = judge.pairs(found, step.instruction, step.criteria)
    shown = F.struct(F.col("rank"), F.struct("right_row_id", F.col("p").alias("p_same"), F.round("retrieval_score", 3).alias("retrieval_score")).alias("c"))
    by_row = scored.groupBy(ROW_ID).agg(
        F.max(F.when(F.col("p").isNotNull(), F.struct("p", (-F.col("rank")).alias("r"), F.col("right_row_id").alias("id")))).alias("best"),
        F.count_if(F.col("p").isNull()).alias("unscored"),
        F.to_json(F.transform(F.sort_array(F.collect_list(shown)), lambda s: s["c"])).alias("candidates"),  # candidates_per_row at most
    )
    met = left.select(name(ROW_ID)).join(by_row, ROW_ID, "left")
    p, n = F.col("best.p"), step.name
    low = F.when(F.col("unscored") > 0, "uncertain").otherwise("unmatched")
    status = F.when(F.col("candidates").isNull(), "no_candidates").when(p.isNull(), "failed").when(p >= step.accept_min, "matched").when(p <= step.reject_max, low).otherwise("uncertain")
    return met.select(
        ROW_ID,
        F.when(~status.isin("unmatched"), F.col("best.id")).alias(f"{n}.right_row_id"),
        p.alias(f"{n}.score"),
        F.lit(None).cast("boolean").alias(f"{n}.near"),
        status.alias(f"{n}.status"),
        F.coalesce("candidates", F.lit("[]")).alias(f"{n}.candidates"),
        F.col("best.id").alias(f"{n}.best_row_id"),
        F.coalesce("unscored", F.lit(0)).alias(f"{n}.unscored"),
    )
