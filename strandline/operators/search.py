"""Ranked, tiered and all-terms search over postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import url as U
from strandline.operators.index import shard


def matching(postings: DataFrame, terms: DataFrame, word: str = "word") -> DataFrame:
    """Postings of the stated ``terms`` (a query's few words)."""
    return postings.join(F.broadcast(terms.select(word).distinct()), word, "left_semi")


def lookup(index: DataFrame, words: list[str], word: str = "word") -> DataFrame:
    """The index rows of a query's few ``words``; both filters reach the scan: other shards aren't opened, other row groups are skipped."""
    known = sorted({w for w in words if w})
    rows = index.where(F.col(word).isin(known))
    if "shard" not in index.columns:
        return rows
    spark = index.sparkSession
    if not known:
        return rows
    shards = sorted({r[0] for r in spark.createDataFrame([(w,) for w in known], "w string").select(shard(F.col("w"))).collect()})
    return rows.where(F.col("shard").isin(shards))


def all_terms(postings: DataFrame, n_terms: int, doc: str = "url_hash", weight: str = "weight") -> DataFrame:
    """``doc, score`` of documents that hold all ``n_terms`` terms, the score being the sum of their weights."""
    one = postings.groupBy(doc, "word").agg(F.max(weight).alias("w"))
    return one.groupBy(doc).agg(F.round(F.sum("w"), 6).alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == n_terms).drop("n")


def tiered(postings: DataFrame, n_terms: int, *, min_full: int = 50, doc: str = "url_hash", weight: str = "weight") -> DataFrame:
    """``doc, tier, rank``: documents with all terms (tier 1), and if they are fewer than ``min_full`` also the others (tier 2)."""
    one = postings.groupBy(doc, "word").agg(F.max(weight).alias("w"))
    ranked = one.groupBy(doc).agg(F.round(F.sum("w"), 6).alias("rank"), F.when(F.count(F.lit(1)) == n_terms, 1).otherwise(2).alias("tier"))
    full = ranked.where("tier = 1").agg(F.count(F.lit(1))).scalar()
    return ranked.where((F.col("tier") == 1) | (full < min_full)).select(doc, "tier", "rank")


def invert(postings: DataFrame, doc: str = "url_hash", weight: str = "weight") -> DataFrame:
    """``doc, weights``: a map from each word of a document to its weight (the largest of repeated ones)."""
    one = postings.where(F.col("word").isNotNull()).groupBy(doc, "word").agg(F.max(weight).alias("w"))
    return one.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "w")))).alias("weights"))


def boosted(word: Column, url: Column, weight: Column, is_title: Column) -> Column:
    """Weight times 1.5 for the title, 1.5 for the word in the URL's path, 10 to 30 (by length of the term) in an encyclopedia's URL."""
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    n = F.size(F.split(word, " "))
    reference = F.contains(url, F.lit("wikipedia")) & F.contains(F.lower(url), word)
    factor = F.when(n == 3, 30.0).when(n == 2, 20.0).otherwise(10.0)
    return weight * F.when(is_title, 1.5).otherwise(1.0) * F.when(F.contains(path, word), 1.5).otherwise(1.0) * F.when(reference, factor).otherwise(1.0)


def merge_variants(rows: DataFrame, keys: list[str], url: str = "url") -> DataFrame:
    """``rows`` with ``url_key`` and ``representative``, the smallest of a page's URL variants within ``keys``."""
    keyed = rows.withColumn("url_key", U.canonical(F.col(url)))
    names = keyed.groupBy(*keys, "url_key").agg(F.min(url).alias("representative"))
    return keyed.join(names, [*keys, "url_key"])


def bonus(url: Column, words: Column, size: float = 60.0) -> Column:
    """``size`` times, for each word that is a part of the URL, one by the number of parts."""
    parts = U.parts(url)
    hits = F.size(F.filter(words, lambda w: F.array_contains(parts, w)))
    return F.lit(size) * hits / F.greatest(F.size(parts), F.lit(1))


def counted_words(words: Column) -> Column:
    """Words as the bonus counts them, in sorted order: the first once, each further one by its parts and as a whole."""
    return F.aggregate(
        F.slice(words, 2, 2**31 - 2),
        F.slice(words, 1, 1),
        lambda a, w: F.concat(a, F.split(w, " "), F.array(w)),
    )


def ranked(hits: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, url, words, score`` of hits (``keys, word, url, weight, is_title``).

    Boosted weights of a page's URL variants are summed, the URL bonus added. ``keys`` identify the
    query (none for a single one). Rows with null word or URL are ignored, repeated rows count once,
    a null weight is 0.
    """
    rows = hits.where("word is not null and url is not null").select(*keys, "word", "url", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("is_title", F.lit(False)).alias("is_title")).distinct()
    rows = rows.withColumn("b", boosted(F.col("word"), F.col("url"), F.col("weight"), F.col("is_title"))).withColumn("url_key", U.canonical(F.col("url")))
    pages = rows.groupBy(*keys, "url_key").agg(F.min("url").alias("url"), F.array_sort(F.collect_list("word")).alias("words"), F.sum("b").alias("w"))
    return pages.select(*keys, "url", "words", F.round(F.col("w") + bonus(F.col("url"), counted_words(F.col("words"))), 11).alias("score"))


def page(results: DataFrame, order: list, start: int = 0, size: int = 10) -> DataFrame:
    """Rows ``start`` to ``start + size`` of the ordered results, with their 1-based ``pos``."""
    top = results.orderBy(*order).limit(start + size)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order))).where(F.col("pos") > start)


def complete(words: DataFrame, prefix: str, word: str = "word") -> DataFrame:
    """Distinct words that begin with ``prefix``, whatever the case."""
    return words.where(F.startswith(F.upper(word), F.lit(prefix.upper()))).select(word).distinct()


def with_pagerank(postings: DataFrame, ranks: DataFrame, key: str, default: float = 0.15) -> DataFrame:
    """``postings`` with ``weight_pg = weight * pagerank`` (12 digits), ``default`` for pages without a rank."""
    joined = postings.join(ranks.select(key, "pagerank"), key, "left")
    return joined.withColumn("weight_pg", F.round(F.col("weight") * F.coalesce("pagerank", F.lit(default)), 12)).drop("pagerank")


def union_last(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Both answers together; rows of ``second`` replace those of ``first`` with the same keys."""
    return first.join(second.select(*keys).distinct(), keys, "left_anti").unionByName(second)
