"""The search engine end to end: pages to a sharded index, and a search string to a page of ranked results with snippets."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import html as H
from strandline.functions import text as T
from strandline.functions import url as U
from strandline.operators import index as I
from strandline.operators import search as S
from strandline.session import cut
from strandline.sources.files import write_index


@dataclass
class SearchIndex:
    """What the index job leaves and a search reads."""

    postings: DataFrame  # word, url_hash, tf, weight, weight_pg, is_title, shard
    urls: DataFrame  # url_hash, url
    dictionary: DataFrame  # ngram
    elements: DataFrame  # page_id, url, elem_no, tag, text

    def save(self, path: str) -> None:
        """To a folder: postings by shard and sorted by word, so that a search opens few row groups."""
        write_index(self.postings, f"{path}/postings")
        for name in ("urls", "dictionary", "elements"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SearchIndex:
        return cls(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)})


def build_index(elements: DataFrame, ranks: DataFrame, dictionaries: dict[int, DataFrame] | None = None, *, words: DataFrame | None = None, n_docs: int | None = None) -> SearchIndex:
    """Index pages given as ``page_id, url, elem_no, tag, text``, with ``ranks`` (``url, pagerank``) and n-gram ``dictionaries``.

    ``words`` may hold the elements as ``index.tokenised`` made them. Runs the heavy steps at once.
    """
    elements = elements.select("page_id", "url", "elem_no", "tag", "text").distinct()
    terms = I.page_terms(words if words is not None else elements, dictionaries)
    pages = elements.where("url is not null").groupBy("page_id").agg(F.max("url").alias("url")).withColumn("url_hash", U.url_hash(F.col("url")))
    postings = I.weighted(terms.join(pages.select("page_id", "url_hash"), "page_id").drop("page_id"), ranks.select(U.url_hash(F.col("url")).alias("url_hash"), "pagerank"), n_docs=n_docs)
    known = None
    for one in (dictionaries or {}).values():
        known = one.select("ngram") if known is None else known.unionByName(one.select("ngram"))
    spark = elements.sparkSession
    return SearchIndex(cut(postings), cut(pages.select("url_hash", "url").distinct()), cut(known) if known is not None else spark.createDataFrame([], "ngram string"), elements)


def search(index: SearchIndex, query: str, *, start: int = 0, size: int = 10, snippets: bool = True) -> DataFrame:
    """``pos, url, words, score`` and, with ``snippets``, ``title, description`` of the results ``start`` to ``start + size``.

    The query's words and its dictionary n-grams are looked up in the shards that own them; weights
    with page rank are boosted, URL variants merged, the URL bonus added; the page asked for is cut out
    and only its pages' elements are read for the snippets. A query without a known word gives no rows.
    """
    def known(candidates: list[str]) -> set[str]:
        return {r["ngram"] for r in index.dictionary.where(F.col("ngram").isin(candidates)).distinct().collect()} if candidates else set()

    terms = T.query_terms(query, known)
    hits = S.lookup(index.postings, terms).join(index.urls, "url_hash").select("word", "url", F.col("weight_pg").alias("weight"), "is_title")
    results = S.ranked(hits, []).withColumn("words", F.array_join("words", ","))
    page = S.page(results, [F.desc("score"), F.asc("url")], start, size).select("pos", "url", "words", "score")
    if not snippets:
        return page
    page = cut(page)  # at most ``size`` rows
    shown = index.elements.join(F.broadcast(page.select("url")), "url", "left_semi")
    named = shown.select("page_id", "url").groupBy("url").agg(F.max("page_id").alias("page_id"))
    told = named.join(H.snippet_title(shown), "page_id").join(H.snippet_description(shown), "page_id")
    return page.join(told.select("url", "title", "description"), "url", "left")
