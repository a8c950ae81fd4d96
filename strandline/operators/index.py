"""Postings and their weights: term frequencies, title flags, document frequencies, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators.skew import salted_lookup
from strandline.session import cut


def tokenised(elements: DataFrame, doc: str = "page_id") -> DataFrame:
    """``doc, elem_no, tag, words``, written once: dictionaries, single words and n-grams all start from it."""
    return cut(elements.select(doc, "elem_no", "tag", T.raw_tokens(F.col("text")).alias("words")))


def page_terms(elements: DataFrame, dictionaries: dict[int, DataFrame] | None = None, doc: str = "page_id") -> DataFrame:
    """``doc, term, n, is_title`` of each page: its tokens and the dictionary n-grams of its elements.

    ``elements``: ``doc, elem_no, tag`` and ``text``, or ``words`` as ``tokenised`` has them. A token has the
    title flag if it occurs in a ``title`` element, an n-gram only if its first occurrence does.
    """
    elements = elements if "words" in elements.columns else tokenised(elements, doc)
    words = elements.select(doc, (F.col("tag") == "title").alias("t"), F.explode("words").alias("term")).where(T.keeps(F.col("term")))
    single = words.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("t"), F.lit(False)).alias("is_title"))
    for n, dictionary in (dictionaries or {}).items():
        grams = T.dictionary_ngrams(elements, [doc, "elem_no", "tag"], "words", dictionary, n)
        first = F.min(F.struct("elem_no", "pos", (F.coalesce(F.col("tag"), F.lit("")) != "title").alias("other")))
        one = grams.groupBy(doc, F.col("ngram").alias("term")).agg(F.count(F.lit(1)).alias("n"), first.alias("f"))
        single = single.unionByName(one.select(doc, "term", "n", (~F.col("f.other")).alias("is_title")))
    return single


def term_frequency(terms: DataFrame, doc: str = "page_id") -> DataFrame:
    """``terms`` with ``max_n`` and ``tf = n / max_n`` (5 digits), ``max_n`` being the page's largest count, 1 at least.

    A page's different terms meet in one task, as a window over them; they are one page's vocabulary.
    """
    most = F.greatest(F.max("n").over(Window.partitionBy(doc)), F.lit(1))
    return terms.withColumn("max_n", most).withColumn("tf", F.round(F.col("n") / F.col("max_n"), 5))


def positions(rows: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    """``rows`` with ``seq``, their 1-based place within ``key`` by ``order``.

    ``bucket`` has to rise with ``order``: rows are numbered within (key, bucket) and the counts of
    lower buckets added, so a key with a third of all rows is numbered by many tasks.
    """
    marked = rows.withColumn("_bucket", bucket)
    sizes = marked.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.struct(key, "_bucket").alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    numbered = marked.withColumn("_row", F.row_number().over(inside)).withColumn("_k", F.struct(key, "_bucket"))
    return numbered.join(sizes, "_k").withColumn("seq", F.col("_before") + F.col("_row")).drop("_k", "_bucket", "_row", "_before")


def document_frequency(postings: DataFrame, word: str = "word", doc: str = "url_hash") -> DataFrame:
    """``word, df``: the number of different documents of each word."""
    return postings.where(F.col(word).isNotNull()).select(word, doc).distinct().groupBy(word).agg(F.count(doc).alias("df"))


def document_count_lines(df: DataFrame, word: str = "word") -> DataFrame:
    """Text lines ``keyword: w, DOC countS: n`` of the first index version."""
    return df.select(F.format_string("keyword: %s, DOC countS: %s", F.col(word), F.col("df")).alias("value"))


def inverse_frequency(df: DataFrame, n_docs: Column | int) -> DataFrame:
    """``df`` with ``idf = log10(n_docs / df)`` (6 digits)."""
    return df.withColumn("idf", F.round(F.log10((n_docs if isinstance(n_docs, Column) else F.lit(n_docs)) / F.col("df")), 6))


def tfidf(postings: DataFrame, idf: DataFrame, tf: str, word: str = "word") -> DataFrame:
    """``postings`` with ``tfidf = tf * idf`` (9 digits); hot words are salted."""
    facts = idf.select(word, "idf", F.col("df").alias("n_rows"))
    spread = [c for c in postings.columns if c != word][:2]
    return salted_lookup(postings, facts, word, spread).withColumn("tfidf", F.round(F.col(tf) * F.col("idf"), 9))


def weighted(terms: DataFrame, ranks: DataFrame, *, doc: str = "url_hash", n_docs: int | None = None, default_rank: float = 0.15) -> DataFrame:
    """``word, doc, tf, weight, weight_pg, is_title, shard``: what the index holds of page terms ``doc, term, n, is_title``.

    ``weight`` is tf times idf, ``weight_pg`` that times the page's ``pagerank`` in ``ranks`` (``default_rank`` without
    one). ``n_docs`` is the collection's size for idf, by default the number of different pages.
    """
    tf = cut(term_frequency(terms, doc).select(F.col("term").alias("word"), doc, "tf", "is_title"))
    n_docs = n_docs or tf.select(doc).distinct().count()
    rows = tfidf(tf, inverse_frequency(document_frequency(tf, "word", doc), n_docs), "tf").withColumnRenamed("tfidf", "weight")
    rank = ranks.groupBy(doc).agg(F.max("pagerank").alias("pagerank"))
    joined = rows.join(rank, doc, "left").withColumn("weight_pg", F.round(F.col("weight") * F.coalesce("pagerank", F.lit(default_rank)), 12))
    return joined.select("word", doc, "tf", "weight", "weight_pg", "is_title", shard(F.col("word")).alias("shard"))


def top_per_word(postings: DataFrame, weight: str, n: int = 10, word: str = "word", doc: str = "url_hash") -> DataFrame:
    """The ``n`` heaviest documents of each word with their ``pos``; ties by document. Tasks keep ``n`` a word before the shuffle."""
    order = Window.partitionBy(word).orderBy(F.desc_nulls_last(weight), doc)
    return postings.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n)


def bucket(word: Column) -> Column:
    """0 for a first character before ``a``, 1 to 26 for ``a`` to ``z``, more beyond; null for an empty word."""
    first = F.when(F.length(word) > 0, F.ascii(word))
    return F.when(first < 97, 0).otherwise(first - 96).cast("int")


#: The last bucket of each worker's shard.
SHARD_BOUNDS = (3, 9, 15, 20, 26)


def shard(word: Column, bounds: tuple[int, ...] = SHARD_BOUNDS) -> Column:
    """The worker that owns a word, by the upper ``bounds`` of its bucket; -1 beyond the last."""
    b = bucket(word)
    out = F.lit(-1)
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(b <= bounds[i], i).otherwise(out)
    return F.when(b.isNull(), F.lit(-1)).otherwise(out).cast("int")


def shard_owner(shards: DataFrame, alive: DataFrame, n: int) -> DataFrame:
    """``shard, owner``: worker i serves shard i, or if absent worker i+1 (the last one's stand-in is 0); null without both."""
    live = alive.select(F.col("worker").cast("int").alias("w")).distinct()
    own = shards.select(F.col("shard").cast("int").alias("shard")).distinct()
    a = live.withColumnRenamed("w", "a")
    b = live.withColumnRenamed("w", "b")
    joined = own.join(F.broadcast(a), F.col("shard") == F.col("a"), "left").join(F.broadcast(b), F.pmod(F.col("shard") + 1, F.lit(n)) == F.col("b"), "left")
    return joined.select("shard", F.coalesce("a", "b").alias("owner"))


def clean_documents(documents: DataFrame, *, doc: str = "doc_id", ratio: float = 0.5, max_dirty: int = 4) -> DataFrame:
    """``doc, n_dirty, kept``: a sentence is dirty if more than ``ratio`` of its words are no tokens; a document goes at the ``max_dirty``-th."""
    sentences = F.transform(T.sentences(F.coalesce("text", F.lit(""))), T.raw_tokens)
    failing = F.filter(sentences, lambda s: F.size(F.filter(s, lambda w: ~F.regexp_like(w, F.lit(T.TOKEN)))) > ratio * F.size(s))
    return documents.select(doc, F.size(failing).alias("n_dirty")).withColumn("kept", F.col("n_dirty") < max_dirty)
