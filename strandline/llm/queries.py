"""Queries of the problems solved in this package, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import distinctive, encoding, leaks, lines, maincontent, mixing, rankmerge, seen
from strandline.session import cut, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive.best_terms(table(spark, folder, "postings"))


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive.term_scores(table(spark, folder, "postings"))


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "search_hits").select("query_id", "url", "weight").distinct()
    ranks = table(spark, folder, "graph_nodes").where("node_id is not null").groupBy(F.col("node_id").alias("url")).agg(F.max("pagerank").alias("pagerank"))
    return rankmerge.merge_ranks(hits.join(ranks, "url", "left"), "query_id", "url", {"weight": 1.0, "pagerank": 1.0})


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return rankmerge.first_items(_merged(spark, folder), "query_id", "url", 3).select("query_id", "url")


def p2_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return maincontent.main_elements(table(spark, folder, "page_elements"))


def p4_texts(spark: SparkSession, folder: str) -> DataFrame:
    elements = table(spark, folder, "page_elements")
    return maincontent.main_text(elements, maincontent.main_elements(elements))


def _arrivals(spark: SparkSession, folder: str) -> DataFrame:
    frontier = table(spark, folder, "frontier_urls").select(F.lit("frontier_urls").alias("table_name"), F.col("frontier_seq").alias("record_id"), seen.url_key(F.col("url")).alias("key"))
    links = table(spark, folder, "out_links").select(F.lit("out_links").alias("table_name"), F.col("outlink_id").alias("record_id"), seen.url_key(F.col("url")).alias("key"))
    return frontier.unionByName(links)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return seen.seen_before(_arrivals(spark, folder))


def p6_errors(spark: SparkSession, folder: str) -> DataFrame:
    return seen.error_report(_arrivals(spark, folder))


def p6_bound(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of the chains' report that don't depend on hashes."""
    report = seen.error_report(_arrivals(spark, folder))
    return report.select("table_name", "n_rows", (F.col("n_seen") - F.col("n_wrong")).alias("n_repeats"), (F.col("wrong_share") <= F.col("bound")).alias("within_bound"))


def p6_chain(spark: SparkSession, folder: str) -> DataFrame:
    """The chains' own answers, false ones included."""
    return seen.seen_before(_arrivals(spark, folder), exact=False)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return lines.repeated_lines(table(spark, folder, "page_texts")).select("text_id", "line_no")


def p7_texts(spark: SparkSession, folder: str) -> DataFrame:
    return lines.without_repeated(table(spark, folder, "page_texts")).select("text_id", "text", "n_removed")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark_items"))).select("item_id", "n_docs")


def p8_near(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark_items"), edits=2, recall=0.999)


def p8_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Items that leaked whole, or nearly so, with up to three words edited."""
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark_items"), whole=True, edits=3, recall=0.99)


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    return mixing.mix(documents, targets), targets


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(*_mix(spark, folder))


def p9_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the mix whatever is drawn: caps kept; each source at its share but for one document, or without documents, or drawn up to its cap."""
    drawn, targets = _mix(spark, folder)
    drawn = cut(drawn)
    total = drawn.agg(F.sum(F.col("n_tokens") * F.col("copies"))).scalar()
    one = drawn.agg(F.max("n_tokens")).scalar()
    got = mixing.shares(drawn, targets).join(targets.select("source", "max_repeats"), "source")
    near = F.col("actual_share") * total >= F.col("target_share") / targets.agg(F.sum("target_share")).scalar() * total - one - 1
    return got.select("source", "target_share", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), (near | F.col("capped") | (F.col("n_docs") == 0)).alias("reached"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.garbled(table(spark, folder, "documents")).select("doc_id")


def p10_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.repaired(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_scores, p2_found, p2_ranks, p4_found, p4_texts, p6_found, p6_chain, p6_errors, p6_bound, p7_found, p7_texts, p8_found, p8_items, p8_near, p8_whole, p9_mix, p9_shares, p9_bounds, p10_found, p10_repaired)
}

_SCORES = """
cells AS (SELECT url_hash, word, max(coalesce(weight, 0.0)) AS w FROM postings
  WHERE url_hash IS NOT NULL AND word IS NOT NULL GROUP BY 1, 2),
marg AS (SELECT *, sum(w) OVER (PARTITION BY url_hash) AS r, sum(w) OVER (PARTITION BY word) AS c, sum(w) OVER () AS t,
  count(*) OVER (PARTITION BY url_hash) AS n_terms FROM cells),
four AS (SELECT *, greatest(r - w, 0.0) AS b, greatest(c - w, 0.0) AS d, greatest(t - r - c + w, 0.0) AS e FROM marg),
g AS (SELECT *, 2 * (CASE WHEN w > 0 THEN w * ln(w / (r * c / t)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / (r * (t - c) / t)) ELSE 0 END
  + CASE WHEN d > 0 THEN d * ln(d / ((t - r) * c / t)) ELSE 0 END + CASE WHEN e > 0 THEN e * ln(e / ((t - r) * (t - c) / t)) ELSE 0 END) AS g2 FROM four),
scores AS (SELECT url_hash, word, w AS weight, n_terms, round(CASE WHEN t > 0 THEN CASE WHEN w * t >= r * c THEN g2 ELSE -g2 END ELSE 0 END, 6) + 0.0 AS score FROM g)"""

_RANKS = """
items AS (SELECT query_id, url, max(weight) AS weight FROM search_hits WHERE query_id IS NOT NULL AND url IS NOT NULL GROUP BY 1, 2),
pr AS (SELECT node_id, max(pagerank) AS pagerank FROM graph_nodes GROUP BY 1),
r AS (SELECT query_id, url, rank() OVER (PARTITION BY query_id ORDER BY weight DESC NULLS LAST) AS rank_weight,
  rank() OVER (PARTITION BY query_id ORDER BY pagerank DESC NULLS LAST) AS rank_pagerank FROM items LEFT JOIN pr ON node_id = url),
m AS (SELECT *, (rank_weight + rank_pagerank) / 2.0 AS mid FROM r)"""

_KEY = "split_part(split_part(trim(url, ' '), '#', 1), '?', 1)"
_LINE = r"trim(regexp_replace(regexp_replace(lower(line), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), '[0-9]+', '0', 'g'))"
_REPEATED = rf"""
l AS (SELECT DISTINCT text_id, url, site, i AS line_no, string_split(text, chr(10))[i] AS line
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM page_texts WHERE text IS NOT NULL AND site IS NOT NULL)),
k AS (SELECT *, {_LINE} AS key FROM l),
hot AS (SELECT site, key FROM k WHERE key <> '' GROUP BY 1, 2 HAVING count(DISTINCT url) >= 5),
found AS (SELECT DISTINCT text_id, line_no FROM k JOIN hot USING (site, key))"""

_SHARED = r"""
toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
itoks AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM benchmark_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM toks)),
iw AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM itoks)),
pairs AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g))"""

# 12 words with two edits hold one of their three parts of four words untouched. Words become single characters, and those of a window letters, so that
# levenshtein counts words; a word of no item is like no other.
_NEAR = r"""
toks AS (SELECT doc_id, [x for x in regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+') if x <> ''] AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
itoks AS (SELECT item_id, [x for x in regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+') if x <> ''] AS w FROM benchmark_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
names AS (SELECT x, 19968 + row_number() OVER (ORDER BY x) AS code FROM (SELECT DISTINCT unnest(w) AS x FROM itoks)),
dc AS (SELECT doc_id, string_agg(chr(coalesce(code, 33)::INT), '' ORDER BY i) AS s FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM toks) LEFT JOIN names USING (x) GROUP BY doc_id),
ic AS (SELECT item_id, string_agg(chr(code::INT), '' ORDER BY i) AS s FROM (SELECT item_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM itoks) JOIN names USING (x) GROUP BY item_id),
dp AS (SELECT doc_id, i AS p, s[i:i + 3] AS g FROM (SELECT doc_id, s, unnest(range(1, len(s) - 2)) AS i FROM dc) WHERE NOT contains(s[i:i + 3], '!')),
ip AS (SELECT item_id, i AS q, s[i:i + 3] AS g FROM (SELECT item_id, s, unnest(range(1, len(s) - 2)) AS i FROM ic)),
met AS (SELECT DISTINCT doc_id, item_id, q - o AS q0, p - o + shift AS p0 FROM dp JOIN ip USING (g), unnest([0, 4, 8]) AS offs(o), unnest([-2, -1, 0, 1, 2]) AS shifts(shift)),
cand AS (SELECT DISTINCT doc_id, item_id, dc.s[p0:p0 + n - 1] AS a, ic.s[q0:q0 + 11] AS b FROM met JOIN dc USING (doc_id) JOIN ic USING (item_id), unnest([10, 11, 12, 13, 14]) AS lens(n)
  WHERE q0 >= 1 AND q0 + 11 <= len(ic.s) AND p0 >= 1 AND p0 + n - 1 <= len(dc.s)),
near AS (SELECT doc_id, item_id, min(levenshtein(regexp_replace(translate(a, b, 'ABCDEFGHIJKL'), '[^A-L]', '#', 'g'), translate(b, b, 'ABCDEFGHIJKL')))::INT AS edits FROM cand GROUP BY 1, 2)"""

_ARRIVALS = f"""
a AS (SELECT DISTINCT 'frontier_urls' AS table_name, frontier_seq AS record_id, {_KEY} AS key FROM frontier_urls WHERE url IS NOT NULL
  UNION ALL SELECT DISTINCT 'out_links', outlink_id, {_KEY} FROM out_links WHERE url IS NOT NULL),
f AS (SELECT *, min(record_id) OVER (PARTITION BY table_name, key) AS first FROM a)"""

ORACLES = {
    "p1_found": f"WITH {_SCORES} SELECT url_hash, word FROM scores WHERE n_terms >= 8 QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY score DESC, word) = 1",
    "p1_scores": f"WITH {_SCORES} SELECT * FROM scores",
    "p2_found": f"WITH {_RANKS} SELECT query_id, url FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY mid, url) <= 3",
    "p2_ranks": f"WITH {_RANKS} SELECT query_id, url, rank_weight, rank_pagerank, round(mid, 6) AS median_rank, round(mid, 6) AS mean_rank FROM m",
    "p6_found": f"WITH {_ARRIVALS} SELECT DISTINCT table_name, record_id FROM f WHERE record_id > first",
    "p6_bound": f"WITH {_ARRIVALS} SELECT table_name, count(*) AS n_rows, count(*) FILTER (WHERE record_id > first) AS n_repeats, true AS within_bound FROM f GROUP BY 1",
    "p7_found": f"WITH {_REPEATED} SELECT text_id, line_no FROM found",
    "p7_texts": f"""
WITH {_REPEATED}, gone AS (SELECT text_id, list(line_no) AS nos FROM found GROUP BY 1)
SELECT p.text_id, array_to_string([x for x, i in string_split(text, chr(10)) if NOT list_contains(coalesce(nos, []), i)], chr(10)) AS text,
  coalesce(len(nos), 0)::INT AS n_removed FROM page_texts p LEFT JOIN gone USING (text_id)""",
    "p8_found": f"WITH {_SHARED} SELECT doc_id, item_id FROM pairs",
    "p8_near": f"WITH {_NEAR} SELECT doc_id, item_id, edits FROM near WHERE edits <= 2",
    "p9_bounds": "SELECT source, target_share, true AS within_cap, true AS reached FROM mix_targets WHERE source IS NOT NULL",
    "p8_items": f"WITH {_SHARED} SELECT item_id, count(*) AS n_docs FROM pairs GROUP BY 1",
}
