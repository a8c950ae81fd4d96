"""Groupings of a dataflow as partitionings, and a small builder of named steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import url as U
from strandline.session import arrow_map


def shuffle_grouping(df: DataFrame, n: int) -> DataFrame:
    """Rows dealt out evenly."""
    return df.repartition(n)


def fields_grouping(df: DataFrame, n: int, *names: str) -> DataFrame:
    """Rows with equal fields together; a URL counts by its host. An unknown field is an error."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no such field: {missing}")
    kinds = dict(df.dtypes)
    keys = [F.coalesce(U.host(F.col(c)), F.col(c)) if kinds[c] == "string" else F.col(c) for c in names]
    return df.repartition(n, *keys)


def first_grouping(df: DataFrame) -> DataFrame:
    """All rows to one task; for small results only."""
    return df.coalesce(1)


class Bolt(Protocol):
    """A user's operator. One instance works on one partition: ``prepare`` before its rows, ``execute`` on each batch of
    them (rows in, rows out), ``cleanup`` at the end, also after an error; rows it returns are written too."""

    def prepare(self, part: int) -> None: ...
    def execute(self, rows: list[dict]) -> list[dict]: ...
    def cleanup(self) -> list[dict] | None: ...


def run_bolt(df: DataFrame, make: Callable[[], Bolt], schema: str) -> DataFrame:
    """The rows that instances of a bolt write, one instance for each partition of ``df``, which a grouping decides.

    A partition is streamed in Arrow batches and never held; state is the bolt's own. The end of a
    partition is the end of its stream. An empty partition is prepared and cleaned up as well.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bolt = make()
        bolt.prepare(TaskContext.get().partitionId())
        ended = False
        try:
            for batch in batches:
                yield pa.RecordBatch.from_pylist(bolt.execute(batch.to_pylist()), schema=target)
            ended = True
        finally:
            last = bolt.cleanup()
        if ended and last:
            yield pa.RecordBatch.from_pylist(last, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return arrow_map(df, run, schema)


@dataclass
class Flow:
    """Named steps: sources, and operators over the results of earlier steps. Nothing runs before an action."""

    spark: SparkSession
    steps: dict[str, DataFrame] = field(default_factory=dict)

    def source(self, name: str, make: Callable[[SparkSession], DataFrame]) -> Flow:
        self.steps[name] = make(self.spark)
        return self

    def operator(self, name: str, run: Callable[..., DataFrame], *inputs: str, grouping: Callable[[DataFrame], DataFrame] | None = None) -> Flow:
        frames = [self.steps[i] for i in inputs]
        self.steps[name] = run(*[grouping(f) if grouping else f for f in frames])
        return self

    def __getitem__(self, name: str) -> DataFrame:
        return self.steps[name]
