"""Judges answer a semantic step's questions; a deterministic one of plain expressions ships, others plug in."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from math import ceil
from typing import Any, ClassVar, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import Question

# Fixed values of the request format: characters per token, tokens of an item and a request, limits of a request.
CHARS_PER_TOKEN, ITEM_TOKENS, REQUEST_TOKENS = 3.6, 8, 40
STATE_TOKENS, TOTAL_TOKENS = 31_000, 62_000
ROWS_PER_REQUEST = 10


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("bigint") + 1


def lower(text: Column) -> Column:
    """Lower case, character by character: Java makes two of the dotted capital I, of which no rule would see an i."""
    return F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))


def tokens_of(text: str) -> int:
    return ceil(len(text) / CHARS_PER_TOKEN) + 1


class RequestFailed(Exception):
    """A request has no answer and won't get one; its rows stay without."""


class Judge(Protocol):
    """ask() adds, to rows with a payload, a text column of JSON per question; null where no answer came.

    A judge with a true attribute `expressions` answers by columns alone, so that asking costs nothing.
    """

    def ask(self, payloads: DataFrame, questions: list[Question]) -> DataFrame: ...

    def pairs(self, pairs: DataFrame, instruction: str, criteria: dict | None) -> DataFrame:
        """pairs (left_text, right_text, ...) with p, the probability that both are the same."""
        ...


def raw_name(q: Question) -> str:
    return f"{q.name}.raw"


@dataclass(frozen=True)
class RuleJudge:
    """Answers by simple rules over the payload's text, all of them plain expressions.

    boolean: 0.92 with the word `yes`, 0.5 with `doubt`, else 0.04, or the number after
    `p=` if there is one; category: the first label whose first part (up to _) occurs, else
    the last; score: the number of !, up to the top level; pairs: 0.95 if equal but for case
    and hyphens, else 0.05, or again the number after `p=` on the left. Without `given` a
    number after `p=` is text as any other.
    """

    yes: str = "refund"
    doubt: str = "unsure"
    given: bool = True
    expressions: ClassVar[bool] = True

    def _given(self, text: Column) -> Column:
        if not self.given:
            return F.lit(None).cast("double")
        return F.regexp_extract(text, r"p=([0-9]*\.?[0-9]+)", 1).try_cast("double")

    def _answer(self, text: Column, q: Question) -> Column:
        if q.kind == "boolean":
            rule = F.when(F.contains(text, F.lit(self.yes)), 0.92).when(F.contains(text, F.lit(self.doubt)), 0.5).otherwise(0.04)
            return F.to_json(F.struct(F.coalesce(self._given(text), rule).alias("p")))
        if q.kind == "category":
            labels = list(q.options or {})
            label = F.coalesce(*(F.when(F.contains(text, F.lit(x.split("_")[0])), F.lit(x)) for x in labels), F.lit(labels[-1]))
            return F.to_json(F.struct(label.alias("choice"), F.lit(0.9).alias("confidence"), F.lit(0.9).alias("score")))
        top = len(q.levels or ()) - 1
        level = F.least(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))), F.lit(top))
        return F.to_json(F.struct(level.cast("double").alias("score"), level.cast("int").alias("level"), F.lit(0.8).alias("confidence")))

    def ask(self, payloads: DataFrame, questions: list[Question]) -> DataFrame:
        text = F.col("__lower")
        lowered = payloads.select("*", lower(F.col("payload")).alias("__lower"))
        return lowered.select("*", *(self._answer(text, q).alias(raw_name(q)) for q in questions)).drop("__lower")

    def pairs(self, pairs: DataFrame, instruction: str, criteria: dict | None) -> DataFrame:
        plain = lambda c: F.lower(F.replace(F.col(c), F.lit("-"), F.lit(" ")))
        rule = F.when(plain("left_text") == plain("right_text"), 0.95).otherwise(0.05)
        return pairs.withColumn("p", F.coalesce(self._given(F.col("left_text")), rule))


def pack(sizes: list[int], question_tokens: list[int], rows_per_request: int = ROWS_PER_REQUEST) -> Iterator[list[int]]:
    """Positions of the rows of each request: as many as the limits of rows and tokens allow; too long ones are in none."""
    held: list[int] = []
    total = REQUEST_TOKENS
    each, longest = sum(t + ITEM_TOKENS for t in question_tokens), max(question_tokens, default=0)
    for i, size in enumerate(sizes):
        if size + longest > STATE_TOKENS:
            continue
        if held and (len(held) >= rows_per_request or total + size + each > TOTAL_TOKENS):
            yield held
            held, total = [], REQUEST_TOKENS
        held.append(i)
        total += size + each
    if held:
        yield held


@dataclass(frozen=True)
class BatchJudge:
    """Asks a function that answers requests of several rows, in tasks, `in_flight` requests of each at once.

    answer(texts, questions) gives, for each text, a dict by question name: {"p"} for a
    boolean, {"choice", "confidence", "score"} for a category, {"score", "level",
    "confidence"} for a score, or None. same(lefts, rights, instruction) gives probabilities.
    Rows of a request that raises RequestFailed have no answer, as those without one.
    """

    answer: Callable[[list[str], list[dict[str, Any]]], list[dict[str, Any] | None]]
    same: Callable[[list[str], list[str], str], list[float | None]] | None = None
    rows_per_request: int = ROWS_PER_REQUEST
    extra: dict = field(default_factory=dict)
    in_flight: int = 8

    def ask(self, payloads: DataFrame, questions: list[Question]) -> DataFrame:
        asked = [q.signature() | {"name": q.name} for q in questions]
        tokens = [tokens_of(json.dumps(a)) for a in asked]
        names, answer, rows, at_once = [raw_name(q) for q in questions], self.answer, self.rows_per_request, self.in_flight

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                texts = pdf["payload"].tolist()
                out: list[list[str | None]] = [[None] * len(texts) for _ in names]

                def send(request: list[int], texts: list[str] = texts) -> list[dict[str, Any] | None]:
                    try:
                        return answer([texts[i] for i in request], asked)
                    except RequestFailed:
                        return [None] * len(request)

                requests = list(pack([tokens_of(t) for t in texts], tokens, rows))
                with ThreadPoolExecutor(at_once) as pool:
                    for request, answers in zip(requests, pool.map(send, requests), strict=True):
                        for i, found in zip(request, answers, strict=True):
                            for column, a in zip(out, asked, strict=True):
                                got = (found or {}).get(a["name"])
                                column[i] = None if got is None else json.dumps(got)
                yield pdf.assign(**dict(zip(names, out, strict=True)))

        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in payloads.schema] + [f"`{n}` string" for n in names])
        return payloads.mapInPandas(run, schema)

    def pairs(self, pairs: DataFrame, instruction: str, criteria: dict | None) -> DataFrame:
        if self.same is None:
            raise ValueError("this judge answers no pairs")
        same, rows, at_once = self.same, self.rows_per_request, self.in_flight

        @F.pandas_udf("double")
        def p(left: pd.Series, right: pd.Series) -> pd.Series:
            def send(at: int) -> list[float | None]:
                some = slice(at, at + rows)
                try:
                    return same(left[some].tolist(), right[some].tolist(), instruction)
                except RequestFailed:
                    return [None] * len(left[some])

            with ThreadPoolExecutor(at_once) as pool:
                return pd.Series([x for found in pool.map(send, range(0, len(left), rows)) for x in found], dtype="float64")

        return pairs.withColumn("p", p("left_text", "right_text"))
