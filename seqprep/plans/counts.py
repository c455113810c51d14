"""Rows in and out of each operator of a pipeline, counted by the jobs that run anyway."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .core import Operator, Pipeline
from .storage import table


class Count(NamedTuple):
    operator: str
    rows_in: int
    rows_out: int


class Counts:
    """The counts of one run. They are there after the first job that reads the whole result; asking earlier waits for one."""

    def __init__(self, operators: tuple[Operator, ...]):
        self._operators = operators
        self._seen: dict[int, Observation] = {}

    def watch(self, at: int, df: DataFrame) -> DataFrame:
        self._seen[at] = Observation()
        seen = df.observe(self._seen[at], F.count(F.lit(1)).alias("rows"))
        # the sort of an operator that depends on order reads its input twice, to sample it, and metrics count both
        return table(seen) if at + 1 < len(self._operators) and self._operators[at + 1].kind in "BS" else seen

    def get(self) -> list[Count]:
        """One entry an operator, in order; a kept segment has one entry, as its operators run only where no table is kept."""
        out, before = [], self._seen[-1].get["rows"]
        for at in sorted(self._seen.keys() - {-1}):
            rows = self._seen[at].get["rows"]
            out.append(Count(self._operators[at].name, before, rows))
            before = rows
        return out


def counted(pipeline: Pipeline | Operator, df: DataFrame, **options: Any) -> tuple[DataFrame, Counts]:
    """(the pipeline's result, counts of its operators): counts are metrics of the result's own plan, so there is no second job; the input of an operator that
    depends on order is written to the shared folder before its sort, which would count it twice (as a sort of the result does: sort what is written of it).

    Filters and columns aren't pushed through a counted step, so use it to look at a pipeline. A job that reads part of the result (limit, take) counts what it read.
    """
    if df.isStreaming:
        raise ValueError("counts of streams come from their progress")
    pipeline = Pipeline(pipeline)
    counts = Counts(pipeline.operators)
    return pipeline.map(df, watch=counts.watch, **options), counts
