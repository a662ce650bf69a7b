"""Where models plug in, and the offline stand-ins that need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.text import numbers, tokens


class Completer(Protocol):
    """Answers prompts, a batch at a time."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    """Vectors of texts, a row each."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    """Scores of passages for a question each; higher is better."""

    def __call__(self, questions: list[str], passages: list[str]) -> list[float]: ...


def largest_number(context: Column) -> Column:
    """Stand-in answer: the largest figure of the context, as text; null without one."""
    return F.array_max(numbers(context)).cast("string")


def overlap_verdict(reference: Column, candidate: Column, least: float = 0.5) -> Column:
    """Stand-in judge: whether the candidate holds at least this share of the reference's tokens."""
    r, c = F.array_distinct(tokens(reference)), F.array_distinct(tokens(candidate))
    return F.when(F.size(r) == 0, F.lit(False)).otherwise(F.size(F.array_intersect(r, c)) / F.size(r) >= least)


def completed(prompts: DataFrame, complete: Callable[[list[str]], list[str]], prompt: str = "prompt", out: str = "answer", batch: int = 64) -> DataFrame:
    """prompts with a model's answers: ``complete`` gets a batch of prompts at a time, in the executors."""
    from pyspark.sql.types import StringType, StructField, StructType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said: list[str] = []
            texts = frame[prompt].fillna("").tolist()
            for a in range(0, len(texts), batch):
                said += complete(texts[a : a + batch])
            yield frame.assign(**{out: said})

    return prompts.mapInPandas(run, StructType([*prompts.schema.fields, StructField(out, StringType())]))


@dataclass(frozen=True)
class Tool:
    """A named function of typed arguments that returns a DataFrame."""

    name: str
    arguments: dict[str, type]
    run: Callable[..., DataFrame]


class Tools:
    """Registry of tools; calls with arguments that do not fit come back as an error, not as an exception."""

    def __init__(self):
        self.by_name: dict[str, Tool] = {}

    def add(self, name: str, **arguments: type):
        def put(run):
            self.by_name[name] = Tool(name, arguments, run)
            return run

        return put

    def catalogue(self) -> list[tuple[str, dict[str, str]]]:
        return [(t.name, {a: k.__name__ for a, k in t.arguments.items()}) for t in self.by_name.values()]

    def call(self, name: str, arguments: dict) -> tuple[bool, DataFrame | str]:
        tool = self.by_name.get(name)
        if tool is None:
            return False, f"no tool {name!r}"
        wrong = sorted(set(arguments) ^ set(tool.arguments)) or [a for a, k in tool.arguments.items() if not isinstance(arguments[a], k)]
        return (False, f"arguments do not fit: {', '.join(wrong)}") if wrong else (True, tool.run(**arguments))


def reranked(hits: DataFrame, score: Scorer, question: str = "query_text", passage: str = "text") -> DataFrame:
    """hits (query_id, id, rank, question, passage) with new_rank by a scorer's scores, ties by rank."""

    @F.pandas_udf("double")
    def run(q: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(score(q.fillna("").tolist(), p.fillna("").tolist()), dtype=float)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return hits.withColumn("score", run(question, passage)).withColumn("new_rank", F.row_number().over(order))


@dataclass
class Trace:
    """What an agent did: its steps, the answer, how it ended and what it cost."""

    steps: list[dict] = field(default_factory=list)
    answer: str | None = None
    outcome: str = "steps"
    cost: float = 0.0


def agent(question: str, tools: Tools, decide: Callable[[str, list[dict]], dict], most_steps: int = 8, most_cost: float = 0.05, most_repeats: int = 2, most_rows: int = 50) -> Trace:
    """Asks ``decide`` for the next move, {"answer": ...} or {"tool": ..., "arguments": ...} with its "cost", until it answers.

    It ends early on the cost ceiling, on a call made more than most_repeats times, and after most_steps; a tool shows most_rows rows.
    """
    trace, made = Trace(), {}
    for _ in range(most_steps):
        move = decide(question, trace.steps)
        trace.cost += move.get("cost", 0.0)
        if "answer" in move:
            trace.answer, trace.outcome = move["answer"], "answered"
            return trace
        if trace.cost > most_cost:
            trace.outcome = "cost"
            return trace
        call = (move["tool"], repr(sorted(move["arguments"].items())))
        made[call] = made.get(call, 0) + 1
        if made[call] > most_repeats:
            trace.outcome = "loop"
            return trace
        ok, got = tools.call(move["tool"], move["arguments"])
        shown = [r.asDict() for r in got.limit(most_rows).collect()] if ok and isinstance(got, DataFrame) else got
        trace.steps.append({"tool": move["tool"], "arguments": move["arguments"], "ok": ok, "result": shown})
    return trace
