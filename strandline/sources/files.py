"""Text and table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import url as U
from strandline.operators.graph import contributions
from strandline.operators.index import shard


def links_of_lines(lines: DataFrame) -> DataFrame:
    """``src, dsts`` of lines ``src -> a, b, c``; a malformed line raises an error, an empty one is passed over."""
    parts = F.split("value", " -> ")
    checked = F.when(F.size(parts) == 2, parts[0]).otherwise(F.raise_error(F.concat(F.lit("malformed link line: "), F.col("value"))).cast("string"))
    return lines.where("value <> ''").select(checked.alias("src"), F.split(parts[1], ", ").alias("dsts"))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Adjacency files; ``path`` may be a glob over the parts of several workers."""
    return links_of_lines(spark.read.text(path))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    r"""``key, value``: words between single characters of ``[ \t,.]``, empty ones kept, keyed by a rising number."""
    words = spark.read.text(path).select(F.explode(F.split("value", r"[ \t,.]", -1)).alias("value"))
    return words.select(F.monotonically_increasing_id().alias("key"), "value")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lit("").alias("key"), "value")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """``word, url, weight`` of lines ``word:url:weight``; the URL may hold colons."""
    line = F.col("value")
    return spark.read.text(path).where("value <> ''").select(F.regexp_extract(line, "^([^:]*):", 1).alias("word"), F.regexp_extract(line, "^[^:]*:(.*):[^:]*$", 1).alias("url"), F.regexp_extract(line, ":([^:]*)$", 1).cast("double").alias("weight"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    r"""``word, url_hash, tf, is_title, seq`` of index lines ``word \t hash tf[:T] seq``."""
    halves = F.split("value", "\t")
    right = F.split(halves[1], " ")
    return spark.read.text(path).select(halves[0].alias("word"), right[0].alias("url_hash"), F.regexp_replace(right[1], ":T$", "").cast("double").alias("tf"), F.endswith(right[1], F.lit(":T")).alias("is_title"), right[2].cast("int").alias("seq"))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """``word, url, weight, is_title`` of lines ``word#url#weight#T``."""
    parts = F.split("value", "#")
    return spark.read.text(path).select(parts[0].alias("word"), parts[1].alias("url"), parts[2].cast("double").alias("weight"), (parts[3] == "T").alias("is_title"))


def hit_lines(hits: DataFrame) -> DataFrame:
    return hits.select(F.concat_ws("#", "word", "url", F.col("weight").cast("string"), F.when(F.col("is_title"), "T").otherwise("F")).alias("value"))


def read_pairs(spark: SparkSession, path: str, first: str, second: str, kind: str = "string") -> DataFrame:
    """Two space-separated columns: ``hash url`` or ``url_hash pagerank``."""
    return spark.read.csv(path, sep=" ", schema=f"{first} string, {second} {kind}")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``path, content`` (object store)."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def pages_by_url(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """Stored pages (``url_hash, html``) of the given URLs, found by their SHA-1."""
    return urls.select("url", U.url_hash(F.col("url")).alias("url_hash")).join(pages, "url_hash")


def rank_edges(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """``id, value``: for every link of a vertex ``neighbor:rank/outdegree``."""
    return contributions(edges, ranks).select(F.col("src").alias("id"), F.concat_ws(":", "dst", F.col("contrib").cast("string")).alias("value"))


def rank_lines(ranks: DataFrame) -> DataFrame:
    return ranks.select(F.concat_ws(" -> ", "id", F.col("rank").cast("string")).alias("value"))


def export_urls(outlinks: DataFrame) -> DataFrame:
    return outlinks.select(F.col("url").alias("value"))


def export_adjacency(outlinks: DataFrame) -> DataFrame:
    """Lines ``url -> l1 l2 `` with a space after every link."""
    links = F.array_join(F.transform("links", lambda x: F.concat(x, F.lit(" "))), "")
    return outlinks.select(F.concat(F.col("url"), F.lit(" -> "), links).alias("value"))


def export_hashes(outlinks: DataFrame) -> DataFrame:
    return outlinks.select(U.url_hash(F.col("url")).alias("value"))


def export_hash_map(outlinks: DataFrame) -> DataFrame:
    return outlinks.select(F.concat_ws(" ", U.url_hash(F.col("url")), "url").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages by their URL's SHA-1, partitioned so that a look-up reads one part."""
    keyed = pages.withColumn("url_hash", U.url_hash(F.col("url")))
    keyed.withColumn("part", F.substr("url_hash", F.lit(1), F.lit(2))).write.mode("overwrite").partitionBy("part").parquet(path)


def write_index(postings: DataFrame, path: str) -> None:
    """Postings by shard and sorted by word, so that a word's look-up skips other shards and row groups."""
    sharded = postings.withColumn("shard", shard(F.col("word")))
    spread = F.pmod(F.xxhash64("word", "url_hash"), F.lit(4))  # a hot prefix is several files
    sharded.repartition("shard", F.substr("word", F.lit(1), F.lit(2)), spread).sortWithinPartitions("shard", "word").write.mode("overwrite").partitionBy("shard").parquet(path)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stored rows and new ones, of each key the one with the largest ``order``."""
    both = stored.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n`` of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
