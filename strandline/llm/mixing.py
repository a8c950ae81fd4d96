"""Mixing sources to target shares: raking, then sampling by calibrated probabilities."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import arrow_map, cut

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Splits text before the byte pairs merge, as the vocabulary's makers state it (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODINGS: dict[bytes, object] = {}
_SPLIT = 1024


def encoding(vocabulary: bytes):
    """The tokenizer of a ``.tiktoken`` file's content; made once per process."""
    known = hashlib.sha1(vocabulary).digest()
    if known not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODINGS[known] = tiktoken.Encoding(known.hex(), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[known]


def with_tokens(documents: DataFrame, path: str, groups: list[str]) -> DataFrame:
    """``doc_id, <groups>, n_tokens`` of ``documents`` (``doc_id, <groups>, text``). The driver reads the vocabulary and sends it to the workers."""
    with open(path, "rb") as file:
        vocabulary = documents.sparkSession.sparkContext.broadcast(file.read())
    names = ["doc_id", *groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(vocabulary.value)
        for batch in batches:
            n = [len(bpe.encode_ordinary(t)) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(n, pa.int64())], [*names, "n_tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *groups, "text")
    return arrow_map(rows, run, ", ".join(["doc_id long", *(f"{c} string" for c in groups), "n_tokens long"]))


def rake(cells: pd.DataFrame, marginals: dict[str, dict[str, float]], *, rounds: int = 100, tolerance: float = 1e-9) -> np.ndarray:
    """Iterative proportional fitting: a weight per cell so that ``tokens * weight`` meets each marginal's shares.

    ``marginals`` maps a column to the shares of its values; the last one is met exactly, those before
    as far as the cells allow (empty cells stay empty, so marginals may contradict each other).
    """
    mass = cells["tokens"].to_numpy(float)
    fitted = mass / max(mass.sum(), 1.0)
    for _ in range(rounds):
        before = fitted
        for column, shares in marginals.items():
            now = pd.Series(fitted).groupby(cells[column].to_numpy()).sum()
            factor = {k: shares.get(k, 0.0) / v for k, v in now.items() if v > 0}
            fitted = fitted * cells[column].map(factor).fillna(0.0).to_numpy()
        if np.abs(fitted - before).max(initial=0) < tolerance:
            break
    return np.divide(fitted, mass, out=np.zeros_like(mass), where=mass > 0)


def amounts(share: pd.Series, room: pd.Series, total: float) -> pd.Series:
    """Tokens of each source: its share of ``total`` or, if less, its room; what capped sources leave goes to the others by their shares."""
    got = pd.Series(0.0, share.index)
    open_ = share[share > 0].index
    left = total
    while len(open_) and left > 1e-9:
        offer = left * share[open_] / share[open_].sum()
        full = open_[(offer >= room[open_] - 1e-9).to_numpy()]
        if not len(full):
            got[open_] = offer
            break
        got[full] = room[full]
        left -= float(room[full].sum())
        open_ = open_.difference(full)
    return got


def plan(cells: pd.DataFrame, targets: pd.DataFrame, *, total_tokens: float | None = None, keep_shares: bool = False, marginals: dict[str, dict[str, float]] | None = None) -> pd.DataFrame:
    """``cells`` (``source, <groups>, tokens``) of listed sources with ``copies``, the expected copies of a document of the cell.

    ``total_tokens`` are to be drawn, by default as many as the listed sources have. Each source gets
    its share; one whose documents, repeated up to its cap, hold less gives all of that and the
    others take over the rest in proportion. With ``keep_shares`` the total shrinks instead, to the largest
    at which no cap binds. Sources without any token get nothing. ``marginals`` are target shares of the values
    of other columns (a value without one keeps its own share of what is left); columns without keep
    their own shares. They are raked before the sources, so they yield where they contradict, as they do to the caps.
    """
    groups = [c for c in cells.columns if c not in ("source", "tokens")]
    cells = cells.merge(targets, on="source").reset_index(drop=True)
    out = cells.assign(copies=0.0)
    live = cells[(cells.tokens > 0) & (cells.max_repeats > 0) & (cells.target_share > 0)].reset_index()
    if live.empty:
        return out
    share = live.groupby("source").target_share.first()
    share = share / share.sum()
    room = live.groupby("source")[["tokens", "max_repeats"]].apply(lambda g: float((g.tokens * g.max_repeats).sum()))
    total = float((room / share).min()) if keep_shares else float(live.tokens.sum()) if total_tokens is None else float(total_tokens)
    got = amounts(share, room, min(total, float(room.sum())))
    wanted = {}
    for c in groups:
        own = live.groupby(c).tokens.sum() / live.tokens.sum()
        stated = pd.Series((marginals or {}).get(c, {}), dtype=float)
        stated = stated[stated.index.isin(own.index)]
        rest = own[~own.index.isin(stated.index)]
        if len(stated) and not len(rest):
            stated = stated / stated.sum()
        wanted[c] = stated.to_dict() | (rest / max(rest.sum(), 1e-300) * max(0.0, 1 - stated.sum())).to_dict()
    weight = rake(live, wanted | {"source": (got / got.sum()).to_dict()})
    copies = weight * float(got.sum())
    cap = live.max_repeats.to_numpy(float)
    for source, place in live.groupby("source").indices.items():  # water filling under the cap
        tokens, want = live.tokens.to_numpy(float)[place], got[source]
        base = np.maximum(copies[place], 1e-12)
        low, high = 0.0, 1.0
        while (np.minimum(base * high, cap[place]) * tokens).sum() < want * (1 - 1e-12) and high < 1e18:
            high *= 2
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (np.minimum(base * mid, cap[place]) * tokens).sum() < want else (low, mid)
        copies[place] = np.minimum(base * high, cap[place])
    out.loc[live["index"], "copies"] = copies
    return out


def _cut_off(rows: DataFrame) -> DataFrame:
    """``doc_id`` of the rows (``doc_id, source, n_tokens, rank, want``) with the smallest ranks, as many of each source as hold its wanted tokens.

    The cut lies in one of 1024 buckets of a source's ranks and, inside it, in one of 1024 finer ones:
    both follow from sums of tokens per bucket, 1024 rows a source, and only the last bucket - a
    millionth of a source's rows - is walked in order.
    """
    at = F.col("rank") / (1 + F.col("rank"))  # the cut is near rank 1, in the middle
    placed = rows.withColumn("b1", F.floor(at * _SPLIT).cast("int")).withColumn("b2", F.floor(at * _SPLIT * _SPLIT).cast("int") % _SPLIT)
    first = placed.groupBy("source", "b1").agg(F.sum("n_tokens").alias("held"), F.sum("want").alias("want"))
    order = Window.partitionBy("source").orderBy("b1").rowsBetween(Window.unboundedPreceding, -1)
    first = cut(first.select("source", "b1", F.coalesce(F.sum("held").over(order), F.lit(0)).alias("before"), "held", F.sum("want").over(Window.partitionBy("source")).alias("want")))
    few = F.broadcast(first)  # 1024 rows for each source of the caller's list
    one = placed.drop("want").join(few, ["source", "b1"])
    whole = one.where("before + held <= want").select("doc_id")
    edge = cut(one.where("before < want and before + held > want").select("doc_id", "source", "n_tokens", "rank", "b2", "before", "want"))
    second = edge.groupBy("source", "b2").agg(F.sum("n_tokens").alias("held2"))
    order = Window.partitionBy("source").orderBy("b2").rowsBetween(Window.unboundedPreceding, -1)
    second = second.select("source", "b2", F.coalesce(F.sum("held2").over(order), F.lit(0)).alias("before2"), "held2")
    two = edge.join(F.broadcast(second), ["source", "b2"]).withColumn("before", F.col("before") + F.col("before2"))
    fine = two.where("before + held2 <= want").select("doc_id")
    last = two.where("before < want and before + held2 > want")
    walked = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source").orderBy("rank", "doc_id")) - F.col("n_tokens") / 2
    return whole.unionByName(fine).unionByName(last.withColumn("_at", walked).where("_at <= want").select("doc_id"))


def mix(documents: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, keep_shares: bool = False, marginals: dict[str, dict[str, float]] | None = None, groups: tuple[str, ...] = ("lang",), tokenizer: str | None = None, seed: int = 11) -> DataFrame:
    """``doc_id, source, n_tokens, copies`` of the drawn documents (``copies`` from 1 to the source's cap).

    How much each source gives: see ``plan``; ``groups`` are the columns raked besides the source, as
    far as ``documents`` has them, and ``marginals`` their target shares. Every document of a cell gets the
    whole part of its expected copies; the remainder goes to the documents whose hash is smallest,
    until the source's tokens are reached, so a source misses its amount by about one document, however large.

    Nulls: rows without listed source or id stay out; a null group is a value of its own, ``?``;
    null or empty texts have no tokens and aren't drawn. Repeated rows count once (of one id with
    different texts, the row with the most tokens). Extra columns are ignored; with no document or
    no target nothing is drawn. Cells are sources x groups of the listed sources, a few rows
    whatever the corpus; ``targets`` is the caller's list.
    """
    path = tokenizer or os.path.join(os.environ.get("TOKENIZERS_DIR", TOKENIZERS), VOCABULARY)
    wanted = _listed(targets).toPandas()  # the caller's list of sources
    groups = [c for c in groups if c in documents.columns]
    mine = documents.where(F.col("doc_id").isNotNull() & F.col("source").isin(wanted.source.tolist()))
    sized = with_tokens(mine.select("doc_id", "source", *[F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in groups], "text"), path, ["source", *groups])
    sized = cut(sized.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source", *groups)).alias("d")).select("doc_id", "d.*"))
    cells = sized.groupBy("source", *groups).agg(F.sum("n_tokens").alias("tokens")).toPandas()
    planned = plan(cells, wanted, total_tokens=total_tokens, keep_shares=keep_shares, marginals=marginals)[["source", *groups, "copies", "max_repeats"]]
    spark = documents.sparkSession
    schema = ", ".join(["source string", *(f"{c} string" for c in groups), "copies double", "cap int"])
    rates = spark.createDataFrame(planned.astype({"max_repeats": "int"}).values.tolist(), schema)
    drawn = sized.where("n_tokens > 0").join(F.broadcast(rates), ["source", *groups])
    whole = F.least(F.floor(F.col("copies") + 1e-9), F.col("cap")).cast("int")
    rest = F.greatest(F.col("copies") - whole, F.lit(0.0))
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**40)) / F.lit(float(2**40))
    # one order for all cells of a source: a document's hash relative to its cell's remaining chance
    drawn = drawn.select("doc_id", "source", "n_tokens", "cap", whole.alias("whole"), F.when(rest > 1e-9, u / rest).alias("rank"), (rest * F.col("n_tokens")).alias("want"))
    extra = _cut_off(drawn.where("rank is not null").select("doc_id", "source", "n_tokens", "rank", "want")).withColumn("extra", F.lit(1))
    copies = F.least(F.col("whole") + F.coalesce("extra", F.lit(0)), F.col("cap"))
    return drawn.join(extra, "doc_id", "left").select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def _listed(targets: DataFrame) -> DataFrame:
    rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return rows.na.fill(0, ["target_share", "max_repeats"])


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, n_docs, n_tokens, most_copies, capped`` for every listed source.

    ``capped``: all of the source that was drawn was drawn as often as its cap allows, so it may fall short of its target.
    """
    got = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.max("copies").alias("most_copies"), F.min("copies").alias("_least"))
    total = got.agg(F.sum("n_tokens")).scalar()
    out = _listed(targets).join(got, "source", "left").na.fill(0, ["n_docs", "n_tokens", "most_copies", "_least"])
    share = F.round(F.coalesce(F.col("n_tokens") / total, F.lit(0.0)), 6)
    return out.select("source", "target_share", share.alias("actual_share"), "n_docs", "n_tokens", "most_copies", (F.col("_least") >= F.col("max_repeats")).alias("capped"))
