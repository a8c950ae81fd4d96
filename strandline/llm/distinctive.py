"""How distinctive a term is for a record (log-likelihood ratio)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.skew import bounded_lookup, hot_salts
from strandline.session import cut


def _part(k: Column, expected: Column) -> Column:
    return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)


def log_likelihood(k11: Column, row: Column, column: Column, total: Column) -> Column:
    """Signed G2 of a two-by-two table given one cell and its margins.

    Positive when the term is more frequent in the record than margins suggest, else negative.
    """
    k12, k21 = F.greatest(row - k11, F.lit(0.0)), F.greatest(column - k11, F.lit(0.0))
    k22 = F.greatest(total - row - column + k11, F.lit(0.0))
    rest_row, rest_column = total - row, total - column
    g2 = 2 * (_part(k11, row * column / total) + _part(k12, row * rest_column / total) + _part(k21, rest_row * column / total) + _part(k22, rest_row * rest_column / total))
    return F.when(k11 * total >= row * column, g2).otherwise(-g2)


def _packed(key: Column) -> Column:
    """A key as bytes: the digits of a lower-case hexadecimal digest two to a byte, anything else as it is, told apart by the first byte."""
    text = key.cast("string")
    return F.when(F.regexp_like(text, F.lit("^([0-9a-f]{2}){8,}$")), F.concat(F.unhex(F.lit("00")), F.unhex(text))).otherwise(F.concat(F.unhex(F.lit("01")), text.cast("binary")))


def _unpacked(key: Column) -> Column:
    rest = F.substr(key, F.lit(2), F.length(key))
    return F.when(F.startswith(F.hex(key), F.lit("00")), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def _scores(postings: DataFrame, record: str, term: str, weight: str) -> DataFrame:
    """One shuffle by record: repeated cells meet in it, and a record's sums are taken where its cells lie. A hot record is split by term."""
    rows = postings.select(_packed(F.col(record)).alias("_r"), F.col(term).alias("_t"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("_w")).where("_r is not null and _t is not null")
    n = postings.count()  # steers the salting only
    hot = cut(hot_salts(rows, "_r", n))
    few = F.broadcast(hot)  # at most 1/share records
    salt = F.coalesce(F.pmod(F.xxhash64("_t"), F.col("_salts")), F.lit(0)).cast("int")
    spread = rows.join(few, "_r", "left").select("_r", salt.alias("_salt"), "_t", "_w").repartition("_r", "_salt")
    own = Window.partitionBy("_r", "_salt")
    cells = spread.groupBy("_r", "_salt", "_t").agg(F.max("_w").alias("_w"))
    cells = cut(cells.select("_r", "_t", "_w", F.sum("_w").over(own).alias("_row"), F.count(F.lit(1)).over(own).alias("n_terms")))
    if not hot.isEmpty():
        whole = cells.join(few, "_r", "left_semi").groupBy("_r").agg(F.sum("_w").alias("_all"), F.count(F.lit(1)).alias("_n"))
        cells = cells.join(F.broadcast(whole), "_r", "left").select("_r", "_t", "_w", F.coalesce("_all", "_row").alias("_row"), F.coalesce("_n", "n_terms").alias("n_terms"))
    terms = cut(cells.groupBy("_t").agg(F.sum("_w").alias("_column"), F.count(F.lit(1)).alias("n_rows")))
    total = F.lit(terms.agg(F.sum("_column")).first()[0] or 0.0)
    known = bounded_lookup(cells, terms, "_t", ["_r"], total=n)
    score = F.round(F.coalesce(F.when(total > 0, log_likelihood(F.col("_w"), F.col("_row"), F.col("_column"), total)), F.lit(0.0)), 6) + 0.0  # no negative zero
    return known.select(F.col("_r").alias(record), F.col("_t").alias(term), F.col("_w").alias(weight), "n_terms", score.alias("score"))


def term_scores(postings: DataFrame, record: str = "url_hash", term: str = "word", weight: str = "weight") -> DataFrame:
    """``record, term, weight, n_terms, score``: how strongly each term marks out its record.

    The contingency table compares the term's weight in the record with its weight in all other
    records. Postings hold weights relative to the record's most frequent term instead of counts, so the
    table's cells are sums of those: G2 is that of counts scaled per record. A null weight counts as 0; rows with null record or term are ignored; of repeated
    rows of a term in a record the heaviest counts. A collection without any weight gives score 0.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    Terms and records that own a large share of the rows are salted in both look-ups.
    """
    scored = _scores(postings, record, term, weight)
    return scored.withColumn(record, _unpacked(F.col(record)))


def best_terms(postings: DataFrame, record: str = "url_hash", term: str = "word", weight: str = "weight", least_terms: int = 8) -> DataFrame:
    """``record, term``: the highest score, then the smallest term, of records with at least ``least_terms`` terms."""
    scored = _scores(postings, record, term, weight).where(F.col("n_terms") >= least_terms)
    best = scored.groupBy(record).agg(F.min(F.struct((-F.col("score")).alias("s"), term)).alias("b"))
    return best.select(_unpacked(F.col(record)).alias(record), F.col(f"b.{term}").alias(term))
