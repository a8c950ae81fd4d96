"""Hot keys, salted look-ups and orphan references against brute force."""

import datetime as dt
import random

import pyarrow as pa
from pyspark.sql import functions as F

from strandline.operators.orphans import Lifetimes, orphan_report, orphans
from strandline.operators.skew import hot_keys, keyed_totals, salted_lookup

T0 = dt.datetime(2022, 1, 1, tzinfo=dt.timezone.utc)
REFS = "table_name string, record_id long, key string, seen_at timestamp"
PARENTS = "key string, added_at timestamp, removed_at timestamp"


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def test_hot_keys_count_nulls_and_repeats_in_the_total(spark):
    rows = [("a",)] * 30 + [("b",)] * 10 + [(None,)] * 50 + [("c",)] * 10
    df = spark.createDataFrame(rows, "k string")
    assert {r["k"]: r["n_rows"] for r in hot_keys(df, "k", 0.10).collect()} == {"a": 30, "b": 10, "c": 10}
    assert [r["k"] for r in hot_keys(df, "k", 0.11).collect()] == ["a"]
    assert hot_keys(df.limit(0), "k", 0.02).count() == 0


def test_keyed_totals_keep_the_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 4.0)], "k string, v double")
    got = {r["k"]: (r["n_rows"], r["s"]) for r in keyed_totals(df, "k", F.sum("v").alias("s")).collect()}
    assert got == {"a": (2, 3.0), None: (1, 4.0)}


def test_salted_lookup_equals_a_join(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first"))
    got = salted_lookup(rows, facts, "k", ["id"])
    want = rows.join(facts.drop("n_rows"), "k")
    assert got.count() == 60_000
    assert got.select("k", "id", "first").exceptAll(want.select("k", "id", "first")).count() == 0


def brute(refs, parents):
    out = set()
    for t, i, k, s in refs:
        if k is None:
            continue
        if not any(p == k and a is not None and s is not None and a <= s and (r is None or r > s) for p, a, r in parents):
            out.add((t, i, s))
    return out


def run(spark, refs, parents, **options):
    got = orphans(spark.createDataFrame([(t, i, k, day(s)) for t, i, k, s in refs], REFS), spark.createDataFrame([(k, day(a), day(r)) for k, a, r in parents], PARENTS), **options)
    return {(r["table_name"], r["record_id"], None if r["seen_at"] is None else (r["seen_at"].astimezone(dt.timezone.utc) - T0).days if r["seen_at"].tzinfo else (r["seen_at"] - T0.replace(tzinfo=None)).days) for r in got.collect()}


def test_orphans_match_brute_force_with_nulls_and_returns(spark):
    rng = random.Random(5)
    keys = [f"k{i}" for i in range(30)]
    parents = [(rng.choice([*keys[:20], None]), rng.choice([None, *range(20)]), rng.choice([None, *range(10, 40)])) for _ in range(60)]
    refs = [(rng.choice("ab"), i, rng.choice([*keys, None]), rng.choice([None, *range(45)])) for i in range(500)]
    refs += refs[:50]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_hub_is_split_and_still_right(spark):
    refs = spark.range(150_000).select(F.lit("a").alias("table_name"), F.col("id").alias("record_id"), F.when(F.col("id") % 2 == 0, "hub").otherwise(F.concat(F.lit("x"), "id")).alias("key"), F.lit(T0).alias("seen_at"))
    parents = spark.createDataFrame([("hub", day(-1), None)], PARENTS)
    assert orphans(refs, parents).count() == 75_000


def test_empty_tables_and_report(spark):
    refs = [("a", 1, "k", 3), ("a", 2, "k", 40), ("a", 3, "k", None)]
    assert run(spark, [], [("k", 0, None)]) == set()
    assert run(spark, refs, []) == {("a", 1, 3), ("a", 2, 40), ("a", 3, None)}
    df = orphans(spark.createDataFrame([(t, i, k, day(s)) for t, i, k, s in refs], REFS), spark.createDataFrame([], PARENTS))
    assert {(r["month"], r["n_orphans"]) for r in orphan_report(df).collect()} == {("2022-01", 1), ("2022-02", 1), (None, 1)}


def test_equal_hashes_of_different_keys_are_told_apart():
    rows = pa.table({"h": [7, 7, 7], "key": ["a", "b", "a"], "t1": [0, 10, 20], "t2": [5, 20, 30]})
    lives = Lifetimes([rows])
    import numpy as np

    keys, at = ["a", "a", "b", "b", "c", "a"], [3, 12, 12, 3, 12, 25]
    got = lives.alive(np.full(6, 7), pa.array(keys), np.array(at), np.ones(6, bool))
    assert got.tolist() == [True, False, True, False, False, True]
