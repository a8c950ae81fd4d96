"""Queries of the two general problems: hot keys and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.orphans import orphan_report, orphans
from strandline.operators.skew import hot_keys, keyed_totals
from strandline.session import table

HOT_SHARE = 0.02


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = None
    for name, key in (("postings", "word"), ("link_edges", "src")):
        one = hot_keys(table(spark, folder, name), key, HOT_SHARE).select(F.lit(name).alias("table_name"), F.col(key).alias("hot_key"))
        found = one if found is None else found.unionByName(one)
    return found


def p3_words(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "postings").select("word", "url_hash", "weight", "posting_id").distinct()
    return keyed_totals(rows.where("word is not null"), "word", F.round(F.sum("weight"), 6).alias("total_weight"), F.max("weight").alias("max_weight"), F.count("weight").alias("n_weights"))


def p3_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "link_edges").where("src is not null").select("src", "edge_id", "dst", "seen_at").distinct()
    return keyed_totals(rows, "src", F.count("dst").alias("n_links"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


def _missing(spark: SparkSession, folder: str) -> DataFrame:
    edges = None
    for name in ("link_edges", "back_edges"):
        one = table(spark, folder, name).select(F.lit(name).alias("table_name"), F.col("edge_id").alias("record_id"), F.col("dst").alias("key"), "seen_at")
        edges = one if edges is None else edges.unionByName(one)
    nodes = table(spark, folder, "graph_nodes").select(F.col("node_id").alias("key"), "added_at", "removed_at")
    return orphans(edges, nodes)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _missing(spark, folder).select("table_name", F.col("record_id").alias("edge_id")).distinct()


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_missing(spark, folder).select("table_name", "record_id", "seen_at"))


QUERIES = {f.__name__: f for f in (p3_found, p3_words, p3_sources, p5_found, p5_report)}

_EDGES = """
edges AS (SELECT DISTINCT 'link_edges' AS table_name, edge_id, dst, seen_at FROM link_edges WHERE dst IS NOT NULL
  UNION ALL SELECT DISTINCT 'back_edges', edge_id, dst, seen_at FROM back_edges WHERE dst IS NOT NULL),
missing AS (SELECT * FROM edges e WHERE NOT EXISTS (SELECT 1 FROM graph_nodes g WHERE g.node_id = e.dst
  AND g.added_at <= e.seen_at AND (g.removed_at IS NULL OR g.removed_at > e.seen_at)))"""

ORACLES = {
    "p3_found": """
SELECT 'postings' AS table_name, word AS hot_key FROM postings WHERE word IS NOT NULL GROUP BY word
HAVING count(*) >= 0.02 * (SELECT count(*) FROM postings)
UNION ALL SELECT 'link_edges', src FROM link_edges WHERE src IS NOT NULL GROUP BY src
HAVING count(*) >= 0.02 * (SELECT count(*) FROM link_edges)""",
    "p3_words": """
SELECT word, count(*) AS n_rows, round(sum(weight), 6) AS total_weight, max(weight) AS max_weight, count(weight) AS n_weights
FROM (SELECT DISTINCT word, url_hash, weight, posting_id FROM postings WHERE word IS NOT NULL) GROUP BY word""",
    "p3_sources": """
SELECT src, count(*) AS n_rows, count(dst) AS n_links, min(seen_at) AS first_seen, max(seen_at) AS last_seen
FROM (SELECT DISTINCT src, edge_id, dst, seen_at FROM link_edges WHERE src IS NOT NULL) GROUP BY src""",
    "p5_found": f"WITH {_EDGES} SELECT DISTINCT table_name, edge_id FROM missing",
    "p5_report": f"WITH {_EDGES} SELECT table_name, strftime(seen_at, '%Y-%m') AS month, count(*) AS n_orphans FROM missing GROUP BY 1, 2",
}
