"""References whose target does not exist at the time of the reference."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import arrow_map, parallelism

FOREVER = np.iinfo(np.int64).max


class Lifetimes:
    """The parents of one range as arrays sorted by (hash, start)."""

    def __init__(self, tables: list[pa.Table]):
        rows = pa.concat_tables(tables) if tables else None
        self.empty = rows is None or rows.num_rows == 0
        if self.empty:
            return
        start, end = rows["t1"].to_numpy(), rows["t2"].to_numpy()
        hashes = rows["h"].to_numpy()
        order = np.lexsort((start, hashes))
        self.hashes, self.starts = hashes[order], start[order]
        self.keys = rows["key"].combine_chunks().take(pa.array(order))
        self.owner = np.flatnonzero(np.r_[True, self.hashes[1:] != self.hashes[:-1]])
        run = np.cumsum(np.r_[False, self.hashes[1:] != self.hashes[:-1]])
        self.ends = pd.Series(end[order]).groupby(run).cummax().to_numpy()
        same_hash = self.hashes[1:] == self.hashes[:-1]
        other_key = pc.not_equal(self.keys[1:], self.keys[:-1]).to_numpy(zero_copy_only=False)
        self.collided: dict[str, list[tuple[int, int]]] = {}
        if (clash := np.unique(self.hashes[1:][same_hash & other_key])).size:
            for i in np.flatnonzero(np.isin(self.hashes, clash)):
                self.collided.setdefault(self.keys[int(i)].as_py(), []).append((int(self.starts[i]), int(end[order][i])))
        self.clash = clash

    def alive(self, hashes: np.ndarray, keys: pa.Array, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Whether each key has a lifetime holding its time; ``known`` is False for a null time."""
        if self.empty:
            return np.zeros(len(hashes), bool)
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        first, there = low.copy(), low < high
        while (open_ := low < high).any():  # last start at or before the time, for all rows at once
            mid = (low + high) >> 1
            right = open_ & (self.starts[np.minimum(mid, len(self.starts) - 1)] <= at)
            low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
        last = np.maximum(low - 1, 0)
        held = there & known & (low > first) & (self.ends[last] > at)
        held &= pc.equal(self.keys.take(pa.array(last)), keys).to_numpy(zero_copy_only=False)
        if self.clash.size:  # different keys of one hash: look their lifetimes up by name
            for i in np.flatnonzero(np.isin(hashes, self.clash)):
                spans = self.collided.get(keys[int(i)].as_py(), [])
                held[i] = bool(known[i]) and any(a <= at[i] < b for a, b in spans)
        return held


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, waiting, parents = None, [], None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        part = rows["part"].to_numpy()
        kind = rows["kind"].to_numpy()
        edges = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])])
        for a, b in zip(edges, np.r_[edges[1:], len(part)]):
            piece = rows.slice(a, b - a)
            if part[a] != group:
                group, waiting, parents = part[a], [], None
            if kind[a] == 0:
                waiting.append(piece)
                continue
            if parents is None:
                parents, waiting = Lifetimes(waiting), []
            known = ~piece["t1"].is_null().to_numpy(zero_copy_only=False)
            at = pc.fill_null(piece["t1"], 0).to_numpy()
            missing = ~parents.alive(piece["h"].to_numpy(), piece["key"].combine_chunks(), at, known)
            yield from piece.filter(pa.array(missing)).select(["table_name", "record_id", "t1"]).combine_chunks().to_batches()


def orphans(references: DataFrame, parents: DataFrame, *, rows_per_range: int = 200_000) -> DataFrame:
    """``table_name, record_id, seen_at`` of references whose ``key`` has no lifetime holding ``seen_at``.

    references: ``table_name, record_id, key, seen_at``; parents: ``key, added_at, removed_at``.
    A lifetime holds a time when ``added_at <= time`` and ``removed_at`` is null or later.

    Keys are range-partitioned on their 64-bit hash (equal ranges of it hold equally many keys).
    A range's parents become sorted arrays, which batches of references probe by binary search;
    an equal hash counts only with an equal string. A range with more than its share of the
    references - a hub's - is cut into several groups, each with its own copy of the arrays.

    Nulls: a null ``key`` is no reference; a reference with null ``seen_at`` is an orphan; a parent
    with null ``key`` or ``added_at`` holds nothing. Repeated rows come out once. Either side may be
    empty. Other columns are ignored, whatever their names.
    """
    spark = references.sparkSession
    sure = references.select("table_name", F.col("record_id").cast("long").alias("record_id"), "key", F.unix_micros("seen_at").alias("t1")).where("key is not null")
    partitions = parallelism(spark)
    bits = max(2, math.ceil(math.log2(max(16 * partitions, parents.count() / rows_per_range))))
    ranged: Column = F.shiftrightunsigned(F.col("h"), 64 - bits)
    refs = sure.withColumn("h", F.xxhash64("key")).withColumn("range", ranged)
    total = references.count()
    fair = max(total / 2**bits * 4, total / 512, 50_000)  # so at most 512 ranges are hot, and only those are collected
    salts = {r["range"]: math.ceil(r["n"] / fair) for r in refs.groupBy("range").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fair).collect()}
    # the extra groups follow the 2**bits usual ones; a sparse literal map holds only the hot ranges
    base, offsets = 2**bits, {}
    for k, n in sorted(salts.items()):
        offsets[k], base = base, base + n - 1
    extra = F.create_map(*[x for k, n in salts.items() for x in (F.lit(k), F.struct(F.lit(offsets[k]).alias("at"), F.lit(n).alias("n")))]) if salts else None

    def part(which: Column) -> Column:
        if extra is None:
            return F.col("range")
        hot = extra[F.col("range")]
        return F.when(hot.isNull() | (which == 0), F.col("range")).otherwise(hot["at"] + which - 1)

    copies = F.sequence(F.lit(0), (F.coalesce(extra[F.col("range")]["n"], F.lit(1)) if salts else F.lit(1)) - 1)
    salt = F.pmod(F.xxhash64("record_id"), F.coalesce(extra[F.col("range")]["n"], F.lit(1))).cast("int") if salts else F.lit(0)
    held = (
        parents.where("key is not null and added_at is not null")
        .select("key", F.unix_micros("added_at").alias("t1"), F.coalesce(F.unix_micros("removed_at"), F.lit(int(FOREVER))).alias("t2"))
        .withColumn("h", F.xxhash64("key"))
        .withColumn("range", ranged)
        .withColumn("copy", F.explode(copies))
        .select(part(F.col("copy")).cast("long").alias("part"), F.lit(0).cast("byte").alias("kind"), "h", "key", "t1", "t2", F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("long").alias("record_id"))
    )
    asked = refs.select(part(salt).cast("long").alias("part"), F.lit(1).cast("byte").alias("kind"), "h", "key", "t1", F.lit(None).cast("long").alias("t2"), "table_name", "record_id")
    both = held.unionByName(asked).repartition(partitions, "part").sortWithinPartitions("part", "kind")
    missing = arrow_map(both, _probe, "table_name string, record_id long, t1 long")
    return missing.distinct().select("table_name", "record_id", F.timestamp_micros("t1").alias("seen_at"))


def orphan_report(missing: DataFrame) -> DataFrame:
    """Orphans per table and month of ``seen_at`` (null month for a null time)."""
    return missing.groupBy("table_name", F.date_format("seen_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))
