"""Queries of the search engine's own operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import html as H
from strandline.functions import text as T
from strandline.functions import url as U
from strandline.operators import crawl, graph, index, jobs, search
from strandline.plans import engine
from strandline.session import cut, scratch_path, table
from strandline.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


# --- shared pieces ---------------------------------------------------------------------------------
def _elements(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "page_elements").select("page_id", "url", "elem_no", "tag", "text").distinct()


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "postings").where("word is not null and url_hash is not null")
    return rows.select("posting_id", "word", "url_hash", "weight", "is_title").distinct()


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edges_of(table(spark, folder, "link_edges"))


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_hits").select("query_id", "word", "url", "weight", "is_title").distinct()


def _urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "frontier_urls").where("url is not null").select(F.trim("url").alias("url")).distinct()


def _dictionary(elements: DataFrame, n: int) -> DataFrame:
    """N-grams of three titles or more, of elements as ``index.tokenised`` has them."""
    titles = T.ngram_rows(elements.where("tag = 'title'"), ["page_id"], "words", n)
    return titles.select("page_id", "ngram").distinct().groupBy("ngram").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("ngram")


def _first_links(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.first_outlinks(table(spark, folder, "out_links"), "outlink_id")


def _robots(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").where("text like 'Crawl rules of %'")
    return crawl.parse_robots(texts.select(F.regexp_extract("text", r"^Crawl rules of (\S+)", 1).alias("host"), "text"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS)
_CLEAN = r"CASE WHEN regexp_matches(x, '^-[lr][rsc]b-$') THEN '' ELSE regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') END"
_IS_TOKEN = r"regexp_matches(w, '^[a-z0-9]+[.@&-]*[a-z0-9]+$') AND regexp_matches(w, '[a-z]')"
_STARTS = r"regexp_matches({0}, '^[a-z0-9]+[.@&-]*[a-z0-9]+')"


def _words_sql(source: str, keep: str) -> str:
    return rf"""
raw AS (SELECT {keep}, regexp_split_to_array(lower(text), '[ \t\r\n]+') AS a FROM {source} WHERE text IS NOT NULL),
one AS (SELECT {keep}, i - 1 AS pos, a[i] AS x FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM raw)),
words AS (SELECT {keep}, pos::INT AS pos, {_CLEAN} AS w FROM one)"""


_ELEMENTS_SQL = "elements AS (SELECT DISTINCT page_id, url, elem_no, tag, text FROM page_elements)"
_ELEMENT_WORDS = f"{_ELEMENTS_SQL}, {_words_sql('elements', 'page_id, elem_no, tag')}"
_DOCUMENT_WORDS = _words_sql("documents", "doc_id")
_GRAMS = f"""
lead AS (SELECT *, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY page_id, elem_no, tag ORDER BY pos)),
g2 AS (SELECT page_id, elem_no, tag, pos, w || ' ' || w2 AS ngram FROM lead WHERE {_STARTS.format('w')} AND {_STARTS.format('w2')}),
g3 AS (SELECT page_id, elem_no, tag, pos, w || ' ' || w2 || ' ' || w3 AS ngram FROM lead WHERE {_STARTS.format('w')} AND {_STARTS.format('w2')} AND {_STARTS.format('w3')}),
d2 AS (SELECT ngram FROM g2 WHERE tag = 'title' GROUP BY 1 HAVING count(DISTINCT page_id) >= 3),
d3 AS (SELECT ngram FROM g3 WHERE tag = 'title' GROUP BY 1 HAVING count(DISTINCT page_id) >= 3)"""
_TERMS = f"""
{_ELEMENT_WORDS}, {_GRAMS},
grams AS (SELECT g2.* FROM g2 SEMI JOIN d2 USING (ngram) UNION ALL SELECT g3.* FROM g3 SEMI JOIN d3 USING (ngram)),
terms AS (
  SELECT page_id, w AS term, count(*) AS n, coalesce(bool_or(tag = 'title'), false) AS is_title FROM words WHERE {_IS_TOKEN} AND w NOT IN ({_STOP}) GROUP BY 1, 2
  UNION ALL SELECT page_id, ngram, count(*), coalesce(arg_min(tag, elem_no * 1000000 + pos), '') = 'title' FROM grams GROUP BY 1, 2)"""
_POSTINGS_SQL = "p AS (SELECT DISTINCT posting_id, word, url_hash, weight, is_title FROM postings WHERE word IS NOT NULL AND url_hash IS NOT NULL)"
_IDF_SQL = f"""{_POSTINGS_SQL},
df AS (SELECT word, count(DISTINCT url_hash) AS df FROM p GROUP BY 1),
idf AS (SELECT *, round(log10((SELECT count(DISTINCT url_hash) FROM p)::DOUBLE / df), 6) AS idf FROM df)"""
_EDGES_SQL = "e AS (SELECT DISTINCT src, dst FROM link_edges WHERE src IS NOT NULL AND dst IS NOT NULL)"
_HITS_SQL = "h AS (SELECT DISTINCT query_id, word, url, weight, is_title FROM search_hits)"
_URLS_SQL = "u AS (SELECT DISTINCT trim(url, ' ') AS url FROM frontier_urls WHERE url IS NOT NULL)"
_FIRST_SQL = "f AS (SELECT url, coalesce(arg_min(links, outlink_id), []) AS links FROM out_links WHERE url IS NOT NULL GROUP BY 1)"
_LINK_SQL = "split_part(split_part(trim(l, ' '), '#', 1), '?', 1)"


# --- text and index ----------------------------------------------------------------------------------
@_query(f"WITH {_ELEMENT_WORDS} SELECT page_id, elem_no, pos, w AS token FROM words WHERE {_IS_TOKEN} AND w NOT IN ({_STOP})")
def tokenize_filter(spark, folder):
    return T.token_rows(_elements(spark, folder), ["page_id", "elem_no"], "text")


@_query(f"WITH {_DOCUMENT_WORDS} SELECT w AS token, count(*) AS n FROM words WHERE {_IS_TOKEN} AND w NOT IN ({_STOP}) GROUP BY 1")
def stopword_anti(spark, folder):
    return jobs.word_count(T.token_rows(table(spark, folder, "documents"), ["doc_id"], "text"), "token")


@_query(rf"WITH {_DOCUMENT_WORDS} SELECT w AS token, count(*) AS n FROM words WHERE regexp_matches(w, '^[a-z0-9.@-]+$') AND regexp_matches(w, '[a-z]') AND w NOT IN ({_STOP}) GROUP BY 1")
def tokens_first_version(spark, folder):
    return jobs.word_count(T.token_rows(table(spark, folder, "documents"), ["doc_id"], "text", T.TOKEN_V1), "token")


@_query(f"WITH {_DOCUMENT_WORDS} SELECT w AS word, count(*) AS n FROM words WHERE w <> '' GROUP BY 1")
def word_count(spark, folder):
    words = table(spark, folder, "documents").select(F.explode(T.raw_tokens(F.col("text"))).alias("word")).where("word <> ''")
    return jobs.word_count(words)


@_query("SELECT lang AS key, count(*)::VARCHAR AS value FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def job_word_count(spark, folder):
    pairs = table(spark, folder, "documents").where("lang is not null").select(F.col("doc_id").alias("key"), F.col("lang").alias("value"))
    return jobs.run_job(pairs, jobs.WordCountJob())


@_query("SELECT word, 0 AS block, string_agg(DISTINCT query_id::VARCHAR, ',' ORDER BY query_id::VARCHAR) AS vals FROM search_hits WHERE word IS NOT NULL GROUP BY 1")
def group_words(spark, folder):
    pairs = table(spark, folder, "search_hits").select("word", F.col("query_id").cast("string").alias("q"))
    return jobs.group_values(pairs, "word", "q").select("word", "block", F.array_join("values", ",").alias("vals"))


@_query("SELECT url, round(sum(weight), 6) AS total FROM (SELECT DISTINCT query_id, word, url, weight, is_title FROM search_hits) WHERE url IS NOT NULL GROUP BY 1")
def sum_weights(spark, folder):
    return jobs.sum_values(_hits(spark, folder), "url", "weight")


def _terms(spark, folder):
    elements = index.tokenised(_elements(spark, folder))
    return index.page_terms(elements, {n: _dictionary(elements, n) for n in (2, 3)})


@_query(f"WITH {_TERMS}, m AS (SELECT page_id, greatest(max(n), 1) AS max_n FROM terms GROUP BY 1) SELECT page_id, term, n, max_n, round(n / max_n, 5) AS tf FROM terms JOIN m USING (page_id)")
def term_freq(spark, folder):
    return index.term_frequency(_terms(spark, folder)).select("page_id", "term", "n", "max_n", "tf")


@_query(f"WITH {_TERMS} SELECT page_id, term, is_title FROM terms")
def title_flag(spark, folder):
    return _terms(spark, folder).select("page_id", "term", "is_title")


@_query(f"WITH {_ELEMENT_WORDS}, {_GRAMS} SELECT page_id, elem_no, pos, ngram FROM g2 SEMI JOIN d2 USING (ngram)")
def ngrams2(spark, folder):
    elements = index.tokenised(_elements(spark, folder))
    return T.dictionary_ngrams(elements, ["page_id", "elem_no"], "words", _dictionary(elements, 2), 2)


@_query(f"WITH {_ELEMENT_WORDS}, {_GRAMS} SELECT page_id, elem_no, pos, ngram FROM g3 SEMI JOIN d3 USING (ngram)")
def ngrams3(spark, folder):
    elements = index.tokenised(_elements(spark, folder))
    return T.dictionary_ngrams(elements, ["page_id", "elem_no"], "words", _dictionary(elements, 3), 3)


@_query(r"SELECT doc_id, len(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', E'\\1\n', 'g'), '\n+'))::INT AS n_sentences FROM documents WHERE text IS NOT NULL")
def sentence_count(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@_query(f"WITH {_DOCUMENT_WORDS}, l AS (SELECT {T.lemma_sql('w')} AS lemma FROM words WHERE {_IS_TOKEN} AND w NOT IN ({_STOP})) SELECT lemma, count(*) AS n FROM l GROUP BY 1")
def lemma_count(spark, folder):
    tokens = T.token_rows(table(spark, folder, "documents"), ["doc_id"], "text")
    return jobs.word_count(tokens.select(T.lemma(F.col("token")).alias("lemma")), "lemma")


@_query(f"WITH {_POSTINGS_SQL} SELECT word, url_hash, posting_id, row_number() OVER (PARTITION BY word ORDER BY url_hash, posting_id) AS seq FROM p")
def posting_seq(spark, folder):
    rows = _postings(spark, folder).select("word", "url_hash", "posting_id")
    return index.positions(rows, "word", ["url_hash", "posting_id"], F.substr("url_hash", F.lit(1), F.lit(2)))


@_query(f"WITH {_IDF_SQL} SELECT word, df FROM df")
def doc_freq(spark, folder):
    return index.document_frequency(_postings(spark, folder))


@_query(f"WITH {_IDF_SQL} SELECT 'keyword: ' || word || ', DOC countS: ' || df AS value FROM df")
def doc_count_lines(spark, folder):
    return index.document_count_lines(index.document_frequency(_postings(spark, folder)))


def _idf(spark, folder):
    postings = _postings(spark, folder)
    n_docs = postings.select("url_hash").distinct().agg(F.count(F.lit(1))).scalar()
    return index.inverse_frequency(index.document_frequency(postings), n_docs)


@_query(f"WITH {_IDF_SQL} SELECT word, df, idf FROM idf")
def idf(spark, folder):
    return _idf(spark, folder)


@_query(f"WITH {_IDF_SQL} SELECT posting_id, word, url_hash, round(weight * idf, 9) AS tfidf FROM p JOIN idf USING (word)")
def tfidf(spark, folder):
    rows = _postings(spark, folder).select("posting_id", "word", "url_hash", "weight")
    return index.tfidf(rows, _idf(spark, folder), "weight").select("posting_id", "word", "url_hash", "tfidf")


@_query(f"WITH {_POSTINGS_SQL} SELECT word, url_hash, weight, pos FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY weight DESC NULLS LAST, url_hash) AS pos FROM p) WHERE pos <= 10")
def word_topk(spark, folder):
    return index.top_per_word(_postings(spark, folder).select("word", "url_hash", "weight"), "weight")


@_query(
    rf"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', E'\\1\n', 'g'), '\n+')) AS s, generate_subscripts(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', E'\\1\n', 'g'), '\n+'), 1) AS no FROM documents),
x AS (SELECT doc_id, no, unnest(regexp_split_to_array(lower(s), '[ \t\r\n]+')) AS x FROM s), w AS (SELECT doc_id, no, {_CLEAN} AS w FROM x),
d AS (SELECT doc_id, no, sum((NOT regexp_matches(w, '^[a-z0-9]+[.@&-]*[a-z0-9]+$'))::INT) > 0.5 * count(*) AS dirty FROM w GROUP BY 1, 2)
SELECT doc_id, sum(dirty::INT)::INT AS n_dirty, sum(dirty::INT) < 4 AS kept FROM d GROUP BY 1"""
)
def dirty_docs(spark, folder):
    return index.clean_documents(table(spark, folder, "documents"))


_SHARD_SQL = """
w AS (SELECT DISTINCT word, CASE WHEN ascii(word) < 97 THEN 0 ELSE ascii(word) - 96 END AS bucket FROM postings WHERE word <> ''),
s AS (SELECT *, CASE WHEN bucket <= 3 THEN 0 WHEN bucket <= 9 THEN 1 WHEN bucket <= 15 THEN 2 WHEN bucket <= 20 THEN 3 WHEN bucket <= 26 THEN 4 ELSE -1 END AS shard FROM w)"""


@_query(f"WITH {_SHARD_SQL} SELECT word, bucket, shard FROM s")
def shard_assign(spark, folder):
    words = table(spark, folder, "postings").where("word <> ''").select("word").distinct()
    return words.select("word", index.bucket(F.col("word")).alias("bucket"), index.shard(F.col("word")).alias("shard"))


@_query(f"""WITH {_SHARD_SQL}, o AS (SELECT shard, count(*) AS n_words FROM s GROUP BY 1), last AS (SELECT user_id, max(ts) AS t FROM events GROUP BY 1),
live AS (SELECT DISTINCT user_id % 5 AS w FROM last WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(t) <= 600000000)
SELECT shard, CASE WHEN shard IN (SELECT w FROM live) THEN shard WHEN (shard + 6) % 5 IN (SELECT w FROM live) THEN (shard + 6) % 5 ELSE -1 END::INT AS owner, n_words FROM o""")
def failover_owner(spark, folder):
    """Five workers, those alive of whom a check-in came within the last ten minutes of the events; -1 for a shard whose worker and stand-in are both gone."""
    words = shard_assign(spark, folder).groupBy("shard").agg(F.count(F.lit(1)).alias("n_words"))
    events = table(spark, folder, "events").select((F.col("user_id") % 5).alias("worker"), F.col("ts").cast("timestamp").alias("ts"))
    alive = crawl.live_workers(events, events.agg(F.max("ts")).scalar(), 600)
    return words.join(index.shard_owner(words, alive, 5), "shard").withColumn("owner", F.coalesce("owner", F.lit(-1)))


# --- URLs and links -----------------------------------------------------------------------------------
@_query(f"WITH {_URLS_SQL} SELECT url, sha1(url) AS url_hash FROM u")
def url_hash(spark, folder):
    return _urls(spark, folder).withColumn("url_hash", U.url_hash(F.col("url")))


@_query(
    rf"""WITH {_URLS_SQL}, g AS (SELECT *, length(url) >= 8 AND regexp_matches(url, '^https?://[^/]') AS ok, regexp_extract(url, '^https?://([^/]*)', 1) AS adr, regexp_extract(url, '^https?://[^/]*(/.*)$', 1) AS rest FROM u)
SELECT url, CASE WHEN ok THEN regexp_extract(url, '^(https?)://', 1) END AS protocol, CASE WHEN ok THEN trim(split_part(adr, ':', 1)) END AS host,
  CASE WHEN ok THEN coalesce(TRY_CAST(trim(regexp_extract(adr, '^[^:]*:(.*)$', 1)) AS INT), 80) END AS port, CASE WHEN ok THEN CASE WHEN rest = '' THEN '/' ELSE rest END END AS path FROM g"""
)
def url_parse(spark, folder):
    return _urls(spark, folder).select("url", U.parse(F.col("url")).alias("p")).select("url", "p.*")


_KEY_SQL = "regexp_replace(regexp_replace(url, '^https?', ''), '/$', '')"


@_query(f"WITH {_URLS_SQL}, k AS (SELECT url, {_KEY_SQL} AS url_key FROM u) SELECT url, url_key, min(url) OVER (PARTITION BY url_key) AS representative FROM k")
def url_canon(spark, folder):
    return search.merge_variants(_urls(spark, folder), [])


@_query(f"WITH x AS (SELECT outlink_id, unnest(links) AS l FROM out_links) SELECT outlink_id, {_LINK_SQL} AS link, count(*) AS n FROM x WHERE l IS NOT NULL AND NOT starts_with(trim(l, ' '), 'mailto') GROUP BY 1, 2")
def outlinks(spark, folder):
    rows = table(spark, folder, "out_links").select("outlink_id", F.explode(U.clean_links(F.col("links"))).alias("link"))
    return rows.groupBy("outlink_id", "link").agg(F.count(F.lit(1)).alias("n"))


_ALLOWED_SQL = """CASE WHEN host IS NULL THEN false WHEN contains(host, 'wiki') AND host NOT IN ('en.wikipedia.org', 'www.amazon.com') THEN false
  WHEN coalesce(visits, 0) > 100 AND host NOT IN ('en.wikipedia.org', 'www.amazon.com') THEN false
  WHEN len([x for x in coalesce(allow, []) if CASE WHEN x LIKE '%/' THEN contains(path, x) AND path <> x ELSE path = x END]) > 0 THEN true
  WHEN len([x for x in coalesce(disallow, []) if CASE WHEN x LIKE '%/' THEN contains(path, x) AND path <> x ELSE path = x END]) > 0 THEN false ELSE true END"""
_ROBOTS_SQL = r"""
docs AS (SELECT regexp_extract(text, '^Crawl rules of (\S+)', 1) AS host, max(text) AS text FROM documents WHERE text LIKE 'Crawl rules of %' GROUP BY 1),
l AS (SELECT host, i, lower(string_split(text, chr(10))[i]) AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs)),
s AS (SELECT host, min(i) AS a FROM l WHERE line IN ('user-agent: *', 'user-agent: crawler') GROUP BY 1),
z AS (SELECT l.host, min(i) AS b FROM l JOIN s USING (host) WHERE i > a AND starts_with(line, 'user-agent') GROUP BY 1),
r AS (SELECT l.* FROM l JOIN s USING (host) LEFT JOIN z USING (host) WHERE i > a AND (b IS NULL OR i < b)),
robots AS (SELECT docs.host, coalesce(list(line[8:] ORDER BY i) FILTER (WHERE starts_with(line, 'allow: ')), []) AS allow, coalesce(list(line[11:] ORDER BY i) FILTER (WHERE starts_with(line, 'disallow: ')), []) AS disallow,
  coalesce(arg_max(TRY_CAST(trim(line[14:]) AS INT), i) FILTER (WHERE starts_with(line, 'crawl-delay')), 0)::INT AS crawl_delay FROM docs LEFT JOIN r USING (host) GROUP BY 1),
visited AS (SELECT host, count(DISTINCT trim(url, ' ')) AS visits FROM frontier_urls WHERE host IS NOT NULL GROUP BY 1)"""
_CHECKED_SQL = rf"""
adr AS (SELECT url, trim(url, ' ') AS u FROM asked),
parsed AS (SELECT url, CASE WHEN length(u) >= 8 AND regexp_matches(u, '^https?://[^/]') THEN trim(split_part(regexp_extract(u, '^https?://([^/]*)', 1), ':', 1)) END AS host,
  coalesce(nullif(regexp_extract(u, '^https?://[^/]*(/.*)$', 1), ''), '/') AS path FROM adr),
checked AS (SELECT url, {_ALLOWED_SQL} AS allowed FROM parsed LEFT JOIN robots USING (host) LEFT JOIN visited USING (host))"""


def _visits(spark, folder):
    return table(spark, folder, "frontier_urls").where("host is not null").groupBy("host").agg(F.count_distinct(F.trim("url")).alias("n"))


@_query(
    f"""WITH {_ROBOTS_SQL}, x AS (SELECT unnest(links) AS l FROM out_links), asked AS (SELECT DISTINCT {_LINK_SQL} AS url FROM x WHERE l IS NOT NULL AND NOT starts_with(trim(l, ' '), 'mailto')), {_CHECKED_SQL}
SELECT url FROM checked WHERE allowed AND url NOT IN (SELECT url FROM frontier_urls WHERE url IS NOT NULL)"""
)
def record_links(spark, folder):
    links = table(spark, folder, "out_links").select(F.explode(U.clean_links(F.col("links"))).alias("link"))
    return crawl.record(links, _robots(spark, folder), table(spark, folder, "frontier_urls").where("url is not null"), _visits(spark, folder))


@_query(f"WITH {_FIRST_SQL} SELECT url, array_to_string(links, ' ') AS links FROM f")
def first_outlinks(spark, folder):
    return _first_links(spark, folder).select("url", F.array_join("links", " ").alias("links"))


@_query(f"WITH {_FIRST_SQL} SELECT url || ' -> ' || array_to_string([l || ' ' for l in links], '') AS value FROM f")
def export_adjacency(spark, folder):
    return files.export_adjacency(_first_links(spark, folder))


@_query(f"WITH {_FIRST_SQL} SELECT sha1(url) || ' ' || url AS value FROM f")
def export_hash_map(spark, folder):
    return files.export_hash_map(_first_links(spark, folder))


@_query("SELECT DISTINCT url AS value FROM out_links WHERE url IS NOT NULL")
def export_urls(spark, folder):
    return files.export_urls(_first_links(spark, folder))


@_query("SELECT DISTINCT sha1(url) AS value FROM out_links WHERE url IS NOT NULL")
def export_hashes(spark, folder):
    return files.export_hashes(_first_links(spark, folder))


# --- files: written as text and read back ---------------------------------------------------------------
@_query(f"WITH {_EDGES_SQL} SELECT src, dst FROM e")
def links_file(spark, folder):
    path = scratch_path(spark)
    lines = graph.adjacency(_edges(spark, folder)).select(F.concat_ws(" -> ", "src", F.array_join("neighbors", ", ")).alias("value"))
    files.write_lines(lines, path)
    return files.read_links(spark, path).select("src", F.explode("dsts").alias("dst"))


@_query(r"""WITH l AS (SELECT unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line FROM page_texts WHERE text IS NOT NULL), w AS (SELECT unnest(regexp_split_to_array(line, '[ \t,.]')) AS value FROM l)
SELECT value, count(*) AS n FROM w GROUP BY 1""")
def words_file(spark, folder):
    path = scratch_path(spark)
    files.write_lines(table(spark, folder, "page_texts").where("text is not null").select(F.col("text").alias("value")), path)
    return files.read_words(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT sha1(node_id) AS url_hash, max(pagerank) AS pagerank FROM graph_nodes WHERE node_id IS NOT NULL GROUP BY 1 HAVING max(pagerank) IS NOT NULL")
def pairs_file(spark, folder):
    path = scratch_path(spark)
    ranks = _page_ranks(spark, folder).where("pagerank is not null")
    files.write_lines(ranks.select(F.concat_ws(" ", U.url_hash(F.col("url")), F.col("pagerank").cast("string")).alias("value")), path)
    return files.read_pairs(spark, path, "url_hash", "pagerank", "double")


@_query("SELECT DISTINCT word, url, weight, is_title FROM search_hits WHERE word IS NOT NULL AND url IS NOT NULL AND weight IS NOT NULL AND is_title IS NOT NULL")
def hits_file(spark, folder):
    path = scratch_path(spark)
    files.write_lines(files.hit_lines(_hits(spark, folder).select("word", "url", "weight", "is_title").na.drop().distinct()), path)
    return files.read_hits(spark, path)


# --- pages: written as HTML and parsed back ------------------------------------------------------------------
_SPACES = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_HTML_SQL = rf"""marked AS (SELECT DISTINCT page_id, url, elem_no, tag, css_class, text FROM page_elements),
placed AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY elem_no) AS no FROM marked),
own AS (SELECT page_id, url, no::INT AS elem_no, coalesce(tag, 'div') AS tag, css_class, trim(regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g'), ' ') AS text FROM placed WHERE NOT contains(coalesce(text, ''), chr(160)))"""


def _parsed(spark, folder):
    elements = table(spark, folder, "page_elements").select("page_id", "url", "elem_no", "tag", "css_class", "text").distinct()
    link = F.when(F.col("tag") == "a", F.concat(F.lit("/to/"), F.col("css_class"), F.lit("?q=1#top")))
    return H.own_text(H.render(elements.withColumn("href", link)))


@_query(f"WITH {_HTML_SQL} SELECT page_id, elem_no, tag, css_class, text FROM own")
def html_elements(spark, folder):
    return _parsed(spark, folder).select("page_id", "elem_no", "tag", "css_class", "text")


@_query(f"WITH {_HTML_SQL} SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/to/' || css_class AS link, count(*) AS n FROM own WHERE tag = 'a' AND css_class IS NOT NULL GROUP BY 1, 2")
def html_links(spark, folder):
    return H.page_links(_parsed(spark, folder)).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT DISTINCT url, sha1(url) AS url_hash FROM page_elements WHERE url IS NOT NULL")
def stored_pages(spark, folder):
    """Pages stored by the hash of their URL and looked up again."""
    path = scratch_path(spark)
    pages = H.render(_elements(spark, folder).withColumns({"css_class": F.lit(None).cast("string"), "href": F.lit(None).cast("string")}))
    files.write_pages(pages.where("url is not null").groupBy("url").agg(F.max("html").alias("html")), path)
    asked = _elements(spark, folder).where("url is not null").select("url").distinct()
    return files.pages_by_url(spark.read.parquet(path).select("url_hash", "html"), asked).where("html <> ''").select("url", "url_hash")


# --- graph ----------------------------------------------------------------------------------------------
@_query(f"WITH {_EDGES_SQL} SELECT src, 0 AS block, string_agg(dst, ',' ORDER BY dst) AS neighbors FROM e GROUP BY 1")
def adjacency(spark, folder):
    return graph.adjacency(_edges(spark, folder)).select("src", "block", F.array_join("neighbors", ",").alias("neighbors"))


_LOOSE_SQL = f"{_EDGES_SQL}, loose AS (SELECT dst, count(*) AS n_rows FROM e WHERE dst NOT IN (SELECT src FROM e) GROUP BY 1)"
_REPAIRED_SQL = f"{_LOOSE_SQL}, r AS (SELECT * FROM e UNION SELECT dst, src FROM e SEMI JOIN loose USING (dst) UNION SELECT dst, dst FROM loose)"


@_query(f"WITH {_LOOSE_SQL} SELECT dst, n_rows FROM loose")
def dangling(spark, folder):
    return graph.dangling(_edges(spark, folder))


@_query(f"WITH {_REPAIRED_SQL} SELECT src, dst FROM r")
def dangling_repair(spark, folder):
    return graph.repair(_edges(spark, folder))


@_query("SELECT dst, count(DISTINCT src) AS n_sources, min(seen_at) AS first_seen FROM back_edges WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1")
def back_edge_sources(spark, folder):
    rows = table(spark, folder, "back_edges").where("src is not null and dst is not null").groupBy("dst", "src").agg(F.min("seen_at").alias("t"))
    return rows.groupBy("dst").agg(F.count(F.lit(1)).alias("n_sources"), F.min("t").alias("first_seen"))


def _rank_sql(steps: int, power: int = 1) -> str:
    out = f"WITH {_REPAIRED_SQL}, deg AS (SELECT src, count(*)::DOUBLE AS k FROM r GROUP BY 1), r0 AS (SELECT id, 100.0::DOUBLE AS rank FROM (SELECT src AS id FROM r UNION SELECT dst FROM r))"
    for i in range(1, steps + 1):
        out += f""", s{i} AS (SELECT r.dst AS id, sum(floor(rank / k / 1e-9::DOUBLE + 0.5::DOUBLE)::BIGINT)::DOUBLE * 1e-9::DOUBLE AS s FROM r JOIN deg USING (src) JOIN r{i - 1} q ON q.id = r.src GROUP BY 1),
r{i} AS (SELECT q.id, coalesce((1 - 0.85)::DOUBLE + pow(0.85, {power}) * s, rank) AS rank FROM r{i - 1} q LEFT JOIN s{i} USING (id))"""
    return f"{out} SELECT id, round(rank, 4) AS rank FROM r{steps}"


def _ranked(spark, folder, steps, power=1):
    return graph.pagerank(graph.repair(_edges(spark, folder)), iterations=steps, damping_power=power).select("id", F.round("rank", 4).alias("rank"))


@_query(_rank_sql(1))
def pagerank_step(spark, folder):
    return _ranked(spark, folder, 1)


@_query(_rank_sql(1, 3))
def pagerank_step_as_written(spark, folder):
    return _ranked(spark, folder, 1, 3)


@_query(_rank_sql(3))
def pagerank_k3(spark, folder):
    return _ranked(spark, folder, 3)


@_query("SELECT node_id AS id, printf('%.2f', max(pagerank)) AS rank_text FROM graph_nodes WHERE node_id IN (SELECT url FROM search_hits) GROUP BY 1 HAVING max(pagerank) IS NOT NULL")
def rank_lookup(spark, folder):
    asked = _hits(spark, folder).select(F.col("url").alias("id")).distinct()
    return graph.lookup(_page_ranks(spark, folder).select(F.col("url").alias("id"), F.col("pagerank").alias("rank")), asked)


@_query(f"WITH {_REPAIRED_SQL}, deg AS (SELECT src, count(*) AS k FROM r GROUP BY 1) SELECT src AS id, dst, round(100.0 / k, 6) AS contrib FROM r JOIN deg USING (src)")
def rank_edges(spark, folder):
    edges = cut(graph.repair(_edges(spark, folder)))
    lines = files.rank_edges(edges, graph.start_ranks(edges))
    return lines.select("id", F.regexp_extract("value", "^(.*):[^:]*$", 1).alias("dst"), F.round(F.regexp_extract("value", ":([^:]*)$", 1).cast("double"), 6).alias("contrib"))


@_query(_rank_sql(1))
def rank_file(spark, folder):
    """Ranks written as lines and read back."""
    path = scratch_path(spark)
    files.write_lines(files.rank_lines(graph.pagerank(graph.repair(_edges(spark, folder)), iterations=1)), path)
    parts = F.split("value", " -> ")
    return spark.read.text(path).select(parts[0].alias("id"), F.round(parts[1].cast("double"), 4).alias("rank"))


# --- search ------------------------------------------------------------------------------------------------
def _page_ranks(spark, folder):
    return table(spark, folder, "graph_nodes").where("node_id is not null").groupBy(F.col("node_id").alias("url")).agg(F.max("pagerank").alias("pagerank"))


_PR_SQL = "pr AS (SELECT node_id AS url, max(pagerank) AS pagerank FROM graph_nodes WHERE node_id IS NOT NULL GROUP BY 1)"


@_query(f"WITH {_HITS_SQL}, {_PR_SQL} SELECT query_id, word, url, round(weight * coalesce(pagerank, 0.15), 12) AS weight_pg FROM h LEFT JOIN pr USING (url)")
def weight_pg(spark, folder):
    return search.with_pagerank(_hits(spark, folder), _page_ranks(spark, folder), "url").select("query_id", "word", "url", "weight_pg")


@_query(f"WITH {_HITS_SQL}, {_PR_SQL} SELECT query_id, word, sha1(h.url) AS url_hash, pr.url AS url FROM h JOIN pr ON sha1(pr.url) = sha1(h.url)")
def hash_url(spark, folder):
    hashed = _hits(spark, folder).select("query_id", "word", U.url_hash(F.col("url")).alias("url_hash"))
    return hashed.join(_page_ranks(spark, folder).select(U.url_hash(F.col("url")).alias("url_hash"), "url"), "url_hash").select("query_id", "word", "url_hash", "url")


_AND_WORDS, _TIER_WORDS = ("search", "site", "contact"), ("apple", "travel", "company")
_SCORE_SQL = _POSTINGS_SQL + ", o AS (SELECT url_hash, word, max(weight) AS w FROM p WHERE word IN {0} GROUP BY 1, 2), d AS (SELECT url_hash, round(sum(w), 6) AS s, count(*) AS n FROM o GROUP BY 1)"


def _matching(spark, folder, words):
    return search.matching(_postings(spark, folder), spark.createDataFrame([(w,) for w in words], "word string"))


@_query(f"WITH {_SCORE_SQL.format(_AND_WORDS)} SELECT url_hash, s AS score FROM d WHERE n = 3")
def search_and(spark, folder):
    return search.all_terms(search.lookup(_postings(spark, folder), list(_AND_WORDS)), 3)


@_query(f"WITH {_SCORE_SQL.format(_TIER_WORDS)} SELECT url_hash, CASE WHEN n = 3 THEN 1 ELSE 2 END AS tier, s AS rank FROM d WHERE n = 3 OR (SELECT count(*) FROM d WHERE n = 3) < 50")
def search_tiered(spark, folder):
    return search.tiered(_matching(spark, folder, _TIER_WORDS), 3)


@_query(f"WITH {_POSTINGS_SQL}, o AS (SELECT url_hash, word, max(weight) AS w FROM p GROUP BY 1, 2) SELECT url_hash, string_agg(word || '=' || coalesce(printf('%.5f', w), 'null'), ',' ORDER BY word) AS weights FROM o GROUP BY 1")
def doc_invert(spark, folder):
    inverted = search.invert(_postings(spark, folder))
    entries = F.transform(F.map_entries("weights"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.format_string("%.5f", e["value"]), F.lit("null"))))
    return inverted.select("url_hash", F.array_join(entries, ",").alias("weights"))


#: The boosts an SQL twin has to state again.
_BOOST_BODY = rf"""b AS (SELECT *, coalesce(weight, 0) * CASE WHEN is_title THEN 1.5 ELSE 1 END * CASE WHEN contains(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), word) THEN 1.5 ELSE 1 END
  * CASE WHEN contains(url, 'wikipedia') AND contains(lower(url), word) THEN CASE len(string_split(word, ' ')) WHEN 3 THEN 30 WHEN 2 THEN 20 ELSE 10 END ELSE 1 END AS boosted
  FROM h WHERE word IS NOT NULL AND url IS NOT NULL)"""
_BOOST_SQL = f"{_HITS_SQL}, {_BOOST_BODY}"
_IGNORED = ", ".join(f"'{x}'" for x in U.IGNORED_PARTS)
_PARTS_SQL = rf"[x for x in regexp_split_to_array(regexp_replace(url, '[/.]+$', ''), '(//)|(/)|(\.)') if x NOT IN ({_IGNORED})]"
_COUNTED_SQL = "list_concat(ws[1:1], flatten([list_append(string_split(x, ' '), x) for x in ws[2:]]))"
_RANKED_BODY = rf"""{_BOOST_BODY},
g AS (SELECT query_id, {_KEY_SQL} AS url_key, min(url) AS url, list(word ORDER BY word) AS ws, sum(boosted) AS w FROM b GROUP BY 1, 2),
c AS (SELECT *, {_PARTS_SQL} AS parts FROM g),
scored AS (SELECT query_id, url, array_to_string(ws, ',') AS words, round(w + 60.0 * len([y for y in {_COUNTED_SQL} if list_contains(parts, y)]) / greatest(len(parts), 1), 11) AS score FROM c)"""
_RANKED_SQL = f"{_HITS_SQL}, {_RANKED_BODY}"


@_query(f"WITH {_BOOST_SQL} SELECT query_id, word, url, round(boosted, 12) AS boosted FROM b")
def search_boost(spark, folder):
    rows = _hits(spark, folder).where("word is not null and url is not null")
    value = search.boosted(F.col("word"), F.col("url"), F.coalesce("weight", F.lit(0.0)), F.coalesce("is_title", F.lit(False)))
    return rows.select("query_id", "word", "url", F.round(value, 12).alias("boosted"))


@_query(f"WITH {_HITS_SQL}, c AS (SELECT DISTINCT word, url, {_PARTS_SQL} AS parts FROM h WHERE url IS NOT NULL AND word IS NOT NULL) SELECT word, url, round(60.0 * list_contains(parts, word)::INT / greatest(len(parts), 1), 6) AS bonus FROM c")
def url_scale(spark, folder):
    rows = _hits(spark, folder).where("word is not null and url is not null").select("word", "url").distinct()
    return rows.select("word", "url", F.round(search.bonus(F.col("url"), F.array("word")), 6).alias("bonus"))


def _all_ranked(spark, folder):
    return search.ranked(_hits(spark, folder), ["query_id"])


@_query(f"WITH {_RANKED_SQL} SELECT * FROM scored")
def search_ranked(spark, folder):
    return _all_ranked(spark, folder).withColumn("words", F.array_join("words", ","))


@_query(f"WITH {_RANKED_SQL}, o AS (SELECT url, score, row_number() OVER (ORDER BY score DESC, url) AS pos FROM scored WHERE query_id = 3) SELECT url, score, pos FROM o WHERE pos > 10 AND pos <= 20")
def search_page2(spark, folder):
    results = _all_ranked(spark, folder).where("query_id = 3").select("url", "score")
    return search.page(results, [F.desc("score"), F.asc("url")], start=10)


@_query(f"WITH {_HITS_SQL}, {_PR_SQL}, a AS (SELECT DISTINCT word, url FROM h WHERE is_title), b AS (SELECT DISTINCT word, url FROM h WHERE NOT is_title) SELECT word, url, 'second' AS src FROM b UNION ALL SELECT word, url, 'first' FROM a ANTI JOIN b USING (word, url)")
def union_answers(spark, folder):
    hits = _hits(spark, folder)
    first = hits.where("is_title").select("word", "url").distinct().withColumn("src", F.lit("first"))
    second = hits.where("not is_title").select("word", "url").distinct().withColumn("src", F.lit("second"))
    return search.union_last(first, second, ["word", "url"])


@_query(f"""WITH {_HITS_SQL}, {_PR_SQL}, w AS (SELECT DISTINCT word, url, round(weight * coalesce(pagerank, 0.15), 12) AS weight_pg FROM h LEFT JOIN pr USING (url) WHERE word IS NOT NULL AND url IS NOT NULL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY weight_pg DESC NULLS LAST, url) AS pos FROM w) WHERE pos <= 10""")
def word_topk_pg(spark, folder):
    hits = _hits(spark, folder).where("word is not null and url is not null")
    rows = search.with_pagerank(hits, _page_ranks(spark, folder), "url").select("word", "url", "weight_pg").distinct()
    return index.top_per_word(rows, "weight_pg", doc="url")


#: Two searches over the pages of ``page_elements``: words, stop words, punctuation, and a title's n-gram.
_SEARCHES = ("Which library near the remote museum asked about a crowded lagoon?", "the generous compass of the shallow bridge")
_INDEX_SQL = f"""{_TERMS}, {_PR_SQL},
pages AS (SELECT page_id, max(url) AS url FROM elements WHERE url IS NOT NULL GROUP BY 1),
tf AS (SELECT page_id, term AS word, is_title, round(n / greatest(max(n) OVER (PARTITION BY page_id), 1), 5) AS tf FROM terms),
idf AS (SELECT word, round(log10((SELECT count(DISTINCT page_id) FROM tf)::DOUBLE / count(DISTINCT page_id)), 6) AS idf FROM tf GROUP BY 1),
postings_pg AS (SELECT word, pages.url, is_title, round(round(tf * idf, 9) * coalesce(pagerank, 0.15), 12) AS weight FROM tf JOIN idf USING (word) JOIN pages USING (page_id) LEFT JOIN pr USING (url))"""


def _search_sql(query: str) -> str:
    """The results of a search: its n-grams that the dictionary holds and its words, ranked."""
    words = T.query_terms(query, lambda grams: set(grams))  # candidates; the semi join with the index leaves the known ones
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""{_INDEX_SQL}, h AS (SELECT 0 AS query_id, * FROM postings_pg WHERE word IN ({listed})), {_RANKED_BODY},
results AS (SELECT url, words, score, row_number() OVER (ORDER BY score DESC, url) AS pos FROM scored)"""


def _engine(spark, folder) -> engine.SearchIndex:
    elements = cut(_elements(spark, folder))
    words = index.tokenised(elements)
    return engine.build_index(elements, _page_ranks(spark, folder), {n: _dictionary(words, n) for n in (2, 3)}, words=words)


@_query(f"WITH {_INDEX_SQL} SELECT sha1(url) AS url_hash, word, is_title, weight AS weight_pg FROM postings_pg")
def index_build(spark, folder):
    return _engine(spark, folder).postings.select("url_hash", "word", "is_title", "weight_pg")


@_query(f"WITH {_search_sql(_SEARCHES[0])} SELECT * FROM results WHERE pos <= 25")
def search_string(spark, folder):
    """Through an index written to and read back from a folder."""
    path = scratch_path(spark)
    _engine(spark, folder).save(path)
    return engine.search(engine.SearchIndex.load(spark, path), _SEARCHES[0], size=25, snippets=False)


_TITLE_SQL = """t AS (SELECT page_id, max(url) AS url, string_agg(' ' || trim(text, ' '), '' ORDER BY elem_no) FILTER (WHERE tag = 'title') AS t FROM elements GROUP BY 1),
f AS (SELECT page_id, coalesce(t, regexp_replace(url, 'https://', '')) AS t FROM t), titles AS (SELECT page_id, CASE WHEN length(t) > 80 THEN t[:80] || '...' ELSE t END AS title FROM f)"""
_DESCRIPTION_SQL = """x AS (SELECT page_id, elem_no, trim(coalesce(text, ''), ' ') AS t FROM elements),
cum AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY page_id ORDER BY elem_no, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
d AS (SELECT page_id, string_agg(' ' || t, '' ORDER BY elem_no, t) FILTER (WHERE before <= 300) AS s, bool_or(before > 300) AS over FROM cum GROUP BY 1),
described AS (SELECT page_id, CASE WHEN over THEN s[:300] || '...' ELSE s END AS description FROM d)"""


@_query(f"WITH {_search_sql(_SEARCHES[1])}, {_TITLE_SQL}, {_DESCRIPTION_SQL} SELECT pos, url, words, score, title, description FROM results JOIN pages USING (url) JOIN titles USING (page_id) JOIN described USING (page_id) WHERE pos > 5 AND pos <= 15")
def results_with_snippets(spark, folder):
    return engine.search(_engine(spark, folder), _SEARCHES[1], start=5, size=10)


@_query("SELECT DISTINCT word FROM postings WHERE upper(word) LIKE 'SE%'")
def autocomplete(spark, folder):
    return search.complete(table(spark, folder, "postings"), "Se")


@_query(f"WITH {_ELEMENTS_SQL}, {_TITLE_SQL} SELECT page_id, title FROM titles")
def snippet_title(spark, folder):
    return H.snippet_title(_elements(spark, folder))


@_query(f"WITH {_ELEMENTS_SQL}, {_DESCRIPTION_SQL} SELECT page_id, description FROM described")
def snippet_desc(spark, folder):
    return H.snippet_description(_elements(spark, folder))


# --- crawl --------------------------------------------------------------------------------------------------
@_query(f"WITH {_ROBOTS_SQL} SELECT host, array_to_string(allow, ',') AS allow, array_to_string(disallow, ',') AS disallow, crawl_delay FROM robots")
def robots_rules(spark, folder):
    return _robots(spark, folder).select("host", F.array_join("allow", ",").alias("allow"), F.array_join("disallow", ",").alias("disallow"), "crawl_delay")


@_query(
    rf"""WITH {_ROBOTS_SQL}, asked AS (SELECT DISTINCT 'http://' || host || unnest([rule, rule || 'x', '/a' || rule || 'b']) AS url FROM (SELECT host, unnest(list_concat(allow, disallow)) AS rule FROM robots)
  UNION SELECT trim(url, ' ') FROM frontier_urls WHERE url IS NOT NULL), {_CHECKED_SQL} SELECT url, allowed FROM checked"""
)
def robots_check(spark, folder):
    """All queued URLs, and three made from each rule, under rules and host caps."""
    robots = _robots(spark, folder)
    rules = robots.select("host", F.explode(F.concat("allow", "disallow")).alias("rule"))
    paths = rules.select("host", F.explode(F.array(F.col("rule"), F.concat("rule", F.lit("x")), F.concat(F.lit("/a"), "rule", F.lit("b")))).alias("path"))
    asked = paths.select(F.concat(F.lit("http://"), "host", "path").alias("url")).unionByName(_urls(spark, folder))
    return crawl.check_robots(asked, robots, _visits(spark, folder))


@_query(
    """WITH RECURSIVE d AS (SELECT host, max(depth)::BIGINT * 600000000 AS delay FROM frontier_urls WHERE host IS NOT NULL GROUP BY 1),
a AS (SELECT host, epoch_us(enqueued_at) AS t, count(*) AS n, coalesce(delay, 0) AS delay FROM frontier_urls LEFT JOIN d USING (host) WHERE enqueued_at IS NOT NULL GROUP BY 1, 2, 4),
acc AS (SELECT host, min(t) AS t FROM a WHERE delay > 0 AND host IS NOT NULL GROUP BY 1
  UNION ALL SELECT a.host, min(a.t) AS t FROM acc JOIN a ON a.host = acc.host AND a.t >= acc.t + a.delay GROUP BY a.host)
SELECT host, make_timestamp(a.t) AS ts, n, host IS NULL OR delay = 0 OR acc.t IS NOT NULL AS accepted FROM a LEFT JOIN acc USING (host, t)"""
)
def crawl_delay(spark, folder):
    attempts = table(spark, folder, "frontier_urls").select("host", F.col("enqueued_at").alias("ts"))
    delays = table(spark, folder, "frontier_urls").where("host is not null").groupBy("host").agg((F.max("depth") * 600).alias("crawl_delay"))
    return crawl.crawl_delay(attempts, delays).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@_query("SELECT host, frontier_seq, visit FROM (SELECT host, frontier_seq, row_number() OVER (PARTITION BY host ORDER BY frontier_seq) AS visit FROM frontier_urls) WHERE visit <= 101")
def host_cap(spark, folder):
    return crawl.within_host_cap(table(spark, folder, "frontier_urls").select("host", "frontier_seq"), "frontier_seq")


@_query("SELECT text_id, length(text)::INT AS length FROM page_texts WHERE length(text) <= 0.001 * 1024 * 1024 AND regexp_matches(url, '^https?://')")
def content_filter(spark, folder):
    kind = F.when(F.regexp_like("url", F.lit("^https?://")), "text/html; charset=utf-8")
    pages = table(spark, folder, "page_texts").where("text is not null").select("text_id", F.length("text").alias("length"), kind.alias("type"))
    return crawl.content_filter(pages, 0.001).select("text_id", "length")


@_query(
    """WITH n AS (SELECT trim(url, ' ') AS url, max(enqueued_at) AS last_modified FROM frontier_urls WHERE url IS NOT NULL GROUP BY 1),
v AS (SELECT trim(url, ' ') AS url, max(recorded_at) AS t FROM out_links WHERE url IS NOT NULL GROUP BY 1)
SELECT url, last_modified FROM n LEFT JOIN v USING (url) WHERE t IS NULL OR last_modified > t"""
)
def modified_filter(spark, folder):
    seen = table(spark, folder, "frontier_urls").select(F.trim("url").alias("url"), F.col("enqueued_at").alias("last_modified"))
    visited = table(spark, folder, "out_links").select(F.trim("url").alias("url"), F.col("recorded_at").alias("last_visited"))
    return crawl.modified(seen, visited)


@_query("SELECT frontier_seq, url FROM frontier_urls ORDER BY frontier_seq LIMIT 1000")
def frontier_poll(spark, folder):
    return crawl.poll(table(spark, folder, "frontier_urls").select("frontier_seq", "url"), order="frontier_seq")[0]


@_query(
    """WITH h AS (SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, max(recorded_at) AS t FROM out_links WHERE regexp_matches(url, '^https?://[^/ ]') GROUP BY 1),
d AS (SELECT host, max(depth) * 36000 AS s FROM frontier_urls WHERE host IS NOT NULL GROUP BY 1),
k AS (SELECT host, t, coalesce(s, 0) AS s FROM h LEFT JOIN d USING (host))
SELECT frontier_seq, NOT coalesce(s > 0 AND t + to_seconds(s) > TIMESTAMPTZ '2022-01-01 00:00:00+00', false) AS ready FROM frontier_urls LEFT JOIN k USING (host)"""
)
def frontier_ready(spark, folder):
    urls = table(spark, folder, "out_links").where(F.regexp_like("url", F.lit("^https?://[^/ ]")))
    last = urls.groupBy(F.substring_index(F.substring_index("url", "/", 3), "/", -1).alias("host")).agg(F.max("recorded_at").alias("last_visited"))
    delays = table(spark, folder, "frontier_urls").where("host is not null").groupBy("host").agg((F.max("depth") * 36000).alias("crawl_delay"))
    hosts = last.join(delays, "host", "left").na.fill(0, ["crawl_delay"])
    return crawl.ready(table(spark, folder, "frontier_urls"), hosts, F.to_timestamp(F.lit("2022-01-01 00:00:00"))).select("frontier_seq", "ready")


@_query("WITH l AS (SELECT user_id AS worker, max(ts) AS last_checkin FROM events GROUP BY 1) SELECT * FROM l WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_checkin) <= 3600000000")
def live_workers(spark, folder):
    events = table(spark, folder, "events").select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("ts"))
    now = events.agg(F.max("ts")).scalar()
    live = crawl.live_workers(events, now, 3600)
    return live.select("worker", F.col("last_checkin").cast("timestamp_ntz").alias("last_checkin"))


_TABLES = ("postings", "graph_nodes", "link_edges", "back_edges", "frontier_urls", "out_links", "page_elements", "page_texts", "documents", "search_hits")


@_query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES))
def table_sizes(spark, folder):
    return files.table_sizes({t: table(spark, folder, t) for t in _TABLES})
