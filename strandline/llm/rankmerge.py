"""One ranking from several differently scaled scores (median rank aggregation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.skew import salted_lookup
from strandline.session import cut


def _weighted_median(ranks: list[Column], weights: list[float]) -> Column:
    """Median of a few ranks by weight; at exactly half the weight, the mean of the two next to it."""
    pairs = F.array_sort(F.array(*[F.struct(r.cast("double").alias("r"), F.lit(float(w)).alias("w")) for r, w in zip(ranks, weights)]))
    half = sum(weights) / 2

    def first(least: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("r"))
        done = F.aggregate(
            pairs,
            start,
            lambda s, x: F.struct((s["seen"] + x["w"]).alias("seen"), F.when(s["r"].isNull() & least(s["seen"] + x["w"]), x["r"]).otherwise(s["r"]).alias("r")),
        )
        return done["r"]

    low, high = first(lambda seen: seen >= half - 1e-9), first(lambda seen: seen > half + 1e-9)
    return (low + F.coalesce(high, low)) / 2


def _ranks_of_large(rows: DataFrame, group: str, item: str, scores: list[str], rows_per_bucket: int) -> DataFrame:
    """``rows`` with ``rank_<score>`` columns, for groups too large to sort in one task.

    Works on counts of distinct scores, cut into buckets at approximate quantiles: ranks are counted
    inside buckets, the counts of the buckets above are added. The bucket depends on the score alone,
    so every cut gives the same ranks.
    """
    n = rows.count()
    for c in scores:
        counts = cut(rows.groupBy(group, c).agg(F.count(F.lit(1)).alias("_n")))
        # at most 1000 cuts per group, as many as its size asks for
        shape = counts.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.percentile_approx(F.col(c), [i / 1000 for i in range(1, 1000)], 10_000).alias("_q"))
        step = F.greatest(F.lit(1), F.floor(F.lit(1000.0) / F.ceil(F.col("n_rows") / F.lit(rows_per_bucket)))).cast("int")
        cuts = F.filter(F.coalesce(F.col("_q"), F.array().cast("array<double>")), lambda x, i: (i + 1) % step == 0)
        placed = salted_lookup(counts, shape.select(group, "n_rows", cuts.alias("_cuts")), group, [c], total=n)
        bucket = F.when(F.col(c).isNull(), F.lit(-1)).otherwise(F.size(F.filter("_cuts", lambda x: x <= F.col(c))))
        placed = cut(placed.withColumn("_bucket", bucket).drop("_cuts"))
        above = Window.partitionBy(group).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
        buckets = placed.groupBy(group, "_bucket").agg(F.sum("_n").alias("_m")).withColumn("_above", F.coalesce(F.sum("_m").over(above), F.lit(0)))
        inside = Window.partitionBy(group, "_bucket").orderBy(F.desc_nulls_last(c)).rowsBetween(Window.unboundedPreceding, -1)
        ranked = placed.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(buckets.drop("_m"), [group, "_bucket"])
        key = F.struct(F.col(group).alias("g"), F.col(c).alias("s"))  # nulls inside a struct are equal
        facts = cut(ranked.select(key.alias("_k"), (F.col("_above") + F.col("_before") + 1).alias(f"rank_{c}"), F.col("_n").alias("n_rows")))
        rows = salted_lookup(rows.withColumn("_k", key), facts, "_k", [item], total=n).drop("_k")
    return rows


def merge_ranks(items: DataFrame, group: str, item: str, scores: dict[str, float], *, rows_per_bucket: int = 200_000) -> DataFrame:
    """``group, item``, one rank column per score, ``median_rank, mean_rank``.

    ``scores`` maps score columns (higher is better) to their say. Every item is ranked by each score
    on its own (equal scores share a rank), so neither scale nor spread matters; a null or NaN score
    ranks after all known ones. The order of the result is median rank, mean rank, item. Of repeated
    rows of an item the highest score counts; rows with null ``group`` or ``item`` are ignored; an
    empty table gives an empty result. Groups of more than ``rows_per_bucket`` items, of which there
    can be only so many, are ranked by several tasks.
    """
    known = [F.max(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(c) for c in scores]
    rows = cut(items.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(*known))
    large = cut(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_bucket).select(group))

    def windowed(some: DataFrame) -> DataFrame:
        for c in scores:
            some = some.withColumn(f"rank_{c}", F.rank().over(Window.partitionBy(group).orderBy(F.desc_nulls_last(c))).cast("long"))
        return some

    if large.isEmpty():
        out = windowed(rows)
    else:
        few = F.broadcast(large)  # at most rows / rows_per_bucket names
        out = windowed(rows.join(few, group, "left_anti")).unionByName(_ranks_of_large(rows.join(few, group, "left_semi"), group, item, list(scores), rows_per_bucket))
    ranks = [F.col(f"rank_{c}") for c in scores]
    mean = sum((r * F.lit(float(w)) for r, w in zip(ranks, scores.values())), F.lit(0.0)) / sum(scores.values())
    return out.select(group, item, *ranks, F.round(_weighted_median(ranks, list(scores.values())), 6).alias("median_rank"), F.round(mean, 6).alias("mean_rank"))


def first_items(merged: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """The first ``n`` items of each group with their position; tasks keep only ``n`` rows a group before the shuffle."""
    order = Window.partitionBy(group).orderBy("median_rank", "mean_rank", item)
    return merged.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n)
