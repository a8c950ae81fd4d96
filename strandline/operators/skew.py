"""Per-key results where a few keys own most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import parallelism


def keyed_totals(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """``key, n_rows`` and ``aggregates`` per key, evenly spread whatever the keys' sizes.

    Each task folds its rows into a hash table of partial states (sorted and spilled when it
    outgrows its memory) and only those states are shuffled, so a key sends at most one row per
    map task. ``aggregates`` have to be algebraic (sum, count, min, max, avg, sketches); a distinct
    count runs as two such steps. Null is a group of its own; an empty table gives no row.
    """
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), *aggregates)


def hot_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """``key, n_rows`` of the non-null keys that own at least ``share`` of all rows.

    Repeated rows and null keys count in the total. At most 1/share keys can qualify.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    return keyed_totals(df.select(key), key).where(F.col(key).isNotNull() & (F.col("n_rows") >= F.lit(share) * total))


def salted_lookup(rows: DataFrame, facts: DataFrame, key: str, spread: list[str], n: str = "n_rows", share: float | None = None, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (one row per ``key``, of which ``n`` rows exist).

    Keys owning ``share`` of the rows or more are split by a hash of ``spread`` into parts of that
    size, with their one fact row repeated for each. ``share`` is 0.002, or half of a shuffle
    partition's fair share if that is less, so a hot key keeps every task of a large cluster busy. There are at
    most 1/share hot keys with 2/share salts in all, which bounds the broadcast list of hot keys. Null keys find nothing. ``total`` saves counting the rows
    where their number is known, say from a file's footer; it only steers the salting.
    """
    left, right = salted(rows, facts, key, spread, n, share, total)
    return left.join(right.drop(n), [key, "_salt"]).drop("_salt")


#: Facts are broadcast only while their measured size is at most this many bytes.
BROADCAST_BYTES = 32 << 20


def bounded_lookup(rows: DataFrame, facts: DataFrame, key: str, spread: list[str], n: str = "n_rows", total: int | None = None) -> DataFrame:
    """``salted_lookup``, but facts whose measured size is within ``BROADCAST_BYTES`` are broadcast, so that ``rows`` stay where they are.

    ``facts`` should be a written table (``cut``), as it is read to be measured.
    """
    size = facts.agg(F.sum(F.length(F.col(key).cast("string")) + 16 * len(facts.columns) + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(facts.drop(n)), key)
    return salted_lookup(rows, facts, key, spread, n, total=total)


def hot_salts(rows: DataFrame, key: str, total: int, share: float | None = None) -> DataFrame:
    """``key, _salts`` of the non-null keys that own ``share`` of ``rows`` or more, each to be split into parts of that size."""
    share = share or min(0.002, 0.5 / parallelism(rows.sparkSession))
    fair = max(share * total, 10_000)
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") >= fair).select(key, F.ceil(F.col("_n") / fair).cast("int").alias("_salts"))


def salted(rows: DataFrame, facts: DataFrame, key: str, spread: list[str], n: str = "n_rows", share: float | None = None, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``facts``, each with the ``_salt`` on which, and ``key``, to join them; see ``salted_lookup``."""
    share = share or min(0.002, 0.5 / parallelism(rows.sparkSession))
    total = F.lit(total) if total is not None else facts.agg(F.coalesce(F.sum(n), F.lit(0))).scalar()
    hot = facts.where(F.col(n) >= F.greatest(F.lit(share) * total, F.lit(10_000))).select(
        key, F.ceil(F.col(n) / F.greatest(F.lit(share) * total, F.lit(10_000))).cast("int").alias("_salts")
    )
    few = F.broadcast(hot)
    left = rows.join(few, key, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_salts"))).cast("int")).drop("_salts")
    right = facts.join(few, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return left, right
