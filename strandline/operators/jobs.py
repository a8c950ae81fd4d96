"""Map/reduce jobs: user functions on batches, and the built-in jobs as native aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.skew import salted_lookup
from strandline.session import ship


class Job(Protocol):
    """A user's job. ``map`` turns batches of ``key, value`` into batches of the same; ``combine``, if there is
    one, folds the values of a key within a batch to fewer rows and may run any number of times; ``reduce`` folds
    all rows of a key and writes none or more."""

    def map(self, batch: pd.DataFrame) -> pd.DataFrame: ...
    def reduce(self, key: str, values: pd.Series) -> pd.DataFrame: ...


_PAIR = "key string, value string"


def run_job(pairs: DataFrame, job: Job) -> DataFrame:
    """``key, value`` rows of ``job``. Without ``combine`` a key's rows meet in one task, as the protocol asks."""

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        combine: Callable | None = getattr(job, "combine", None)
        for batch in batches:
            out = job.map(batch)
            if combine is not None and len(out):
                out = pd.concat([combine(k, g["value"]) for k, g in out.groupby("key", dropna=False, sort=False)], ignore_index=True)
            yield out[["key", "value"]]

    ship(pairs.sparkSession)
    rows = pairs.select(F.col("key").cast("string"), F.col("value").cast("string")).mapInPandas(mapped, _PAIR)

    def reduced(group: pd.DataFrame) -> pd.DataFrame:
        out = job.reduce(group["key"].iloc[0], group["value"])
        return out[["key", "value"]]

    return rows.groupBy("key").applyInPandas(reduced, _PAIR)


class WordCountJob:
    """The word count as a user's job, with a combiner."""

    def map(self, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": batch["value"], "value": "1"}).dropna(subset=["key"])

    def combine(self, key: str, values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"key": [key], "value": [str(values.astype("int64").sum())]})

    reduce = combine


def word_count(words: DataFrame, word: str = "word") -> DataFrame:
    """``word, n``; nulls aren't counted."""
    return words.where(F.col(word).isNotNull()).groupBy(word).agg(F.count(F.lit(1)).alias("n"))


def group_values(pairs: DataFrame, key: str, value: str, block: int = 10_000) -> DataFrame:
    """``key, block, values``: the sorted distinct values of each key, those of a large key in several blocks."""
    rows = pairs.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value).distinct()
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    placed = salted_lookup(rows, sizes.withColumn("_blocks", F.ceil(F.col("n_rows") / block).cast("int")), key, [value])
    return placed.groupBy(key, F.pmod(F.xxhash64(value), F.col("_blocks")).cast("int").alias("block")).agg(F.array_sort(F.collect_set(value)).alias("values"))


def sum_values(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """``key, total`` (6 digits)."""
    return pairs.where(F.col(key).isNotNull()).groupBy(key).agg(F.round(F.sum(value), 6).alias("total"))


def rekey_documents(lines: DataFrame) -> DataFrame:
    """``doc, word, weight, lemmas`` of text rows ``word->doc:weight->[lemma, lemma]``."""
    parts = F.split("value", "->", 3)
    middle = parts[1]
    return lines.select(
        F.regexp_extract(middle, "^(.*):[^:]*$", 1).alias("doc"),
        parts[0].alias("word"),
        F.regexp_extract(middle, ":([^:]*)$", 1).try_cast("double").alias("weight"),
        F.split(F.regexp_replace(parts[2], r"^\[|\]$", ""), ", ").alias("lemmas"),
    )
