"""Has a key been seen before? Scalable Bloom filter chains over hash shards."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import arrow_map, cut, parallelism

_STREAM = "table_name string, record_id long, h long, g long, known boolean"
_LAYERS = "shard int, layer int, bits binary, room int"
_ANSWERED = f"table_name string, record_id long, h long, g long, seen boolean, layers int, {_LAYERS}"
_ANSWER_SCHEMA = pa.schema(
    [("table_name", pa.string()), ("record_id", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("seen", pa.bool_()), ("layers", pa.int32())]
    + [("shard", pa.int32()), ("layer", pa.int32()), ("bits", pa.binary()), ("room", pa.int32())]
)


def url_key(url: Column) -> Column:
    """``url`` without outer spaces, cut at the first ``#``, then at the first ``?``."""
    return F.substring_index(F.substring_index(F.trim(url), "#", 1), "?", 1)


class BloomChain:
    """Layers of Bloom filters, each ``growth`` times larger and ``tighten`` times as wrong as the one before.

    A new layer opens when half of the newest one's bits are set, where its error reaches its share.
    The shares form a geometric series, so the compounded error stays under ``error`` however long
    the history grows.
    """

    def __init__(self, error: float = 1e-3, first: int = 1 << 12, growth: int = 2, tighten: float = 0.5):
        self.error, self.size, self.growth, self.tighten = error, first, growth, tighten
        self.share = error * (1 - tighten)
        self.layers: list[tuple[np.ndarray, int, int]] = []
        self.room = 0

    def _open(self, stored: np.ndarray | None = None) -> None:
        hashes = max(1, math.ceil(math.log2(1 / self.share)))
        bits = 1 << math.ceil(math.log2(self.size * hashes / math.log(2)))
        self.layers.append((np.zeros(bits >> 3, np.uint8) if stored is None else stored.copy(), bits - 1, hashes))
        self.room = int(bits * math.log(2) / hashes)  # keys that set half of the bits
        self.size, self.share = self.size * self.growth, self.share * self.tighten

    def restore(self, bits: np.ndarray, room: int) -> None:
        """Put the next stored layer in place; its size and number of hashes follow from the chain's settings."""
        self._open(bits)
        self.room = room

    def state(self) -> list[tuple[bytes, int]]:
        """Each layer's bits, with the keys that still fit (none but in the newest)."""
        return [(bits.tobytes(), self.room if i == len(self.layers) - 1 else 0) for i, (bits, _, _) in enumerate(self.layers)]

    @staticmethod
    def _places(keys: np.ndarray, mask: int, hashes: int) -> np.ndarray:
        other = keys ^ (keys >> np.uint64(33))
        other = (other * np.uint64(0xFF51AFD7ED558CCD)) ^ (keys >> np.uint64(17)) | np.uint64(1)
        return (keys[:, None] + np.arange(hashes, dtype=np.uint64) * other[:, None]) & np.uint64(mask)

    def seen(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        for bits, mask, hashes in self.layers:
            at = self._places(keys, mask, hashes)
            found |= ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)
        return found

    def add(self, keys: np.ndarray) -> None:
        while len(keys):
            if self.room <= 0:
                self._open()
            now, keys = keys[: self.room], keys[self.room :]
            bits, mask, hashes = self.layers[-1]
            at = self._places(now, mask, hashes).ravel()
            np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            self.room -= len(now)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark all but the earliest row of a key within a batch: those are certainly repeats."""
    for batch in batches:
        code = batch["key"].dictionary_encode().indices.to_numpy()
        table = pc.fill_null(batch["table_name"], "").dictionary_encode().indices.to_numpy()
        ids = batch["record_id"].to_numpy()
        code = code.astype(np.int64) * (int(table.max(initial=0)) + 1) + table
        first = np.full(int(code.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, code, ids)
        known = ids > first[code]
        yield pa.RecordBatch.from_arrays([batch["table_name"], batch["record_id"], batch["h"], batch["g"], pa.array(known)], ["table_name", "record_id", "h", "g", "known"])


def _chains(layers: list[dict], options: dict) -> BloomChain:
    """The chain of stored layers, in order; a fresh one of none."""
    chain = BloomChain(**options)
    for one in sorted(layers, key=lambda x: x["layer"]):
        chain.restore(np.frombuffer(one["bits"], np.uint8), one["room"])
    return chain


def _answer(options: dict, keep: bool):
    """Put each shard's rows, in order, to its chain. A shard's rows come after its stored layers; its new layers go last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def left() -> Iterator[pa.RecordBatch]:
            if now is None or not keep:
                return
            for i, (bits, room) in enumerate((chain or _chains(stored, options)).state()):
                yield pa.RecordBatch.from_pylist([{"shard": now, "layer": i, "bits": bits, "room": room}], schema=_ANSWER_SCHEMA)

        now, chain, stored = None, None, []
        for batch in batches:
            shard = batch["shard"].to_numpy()
            kind = batch["layer"].is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])]) if len(shard) else []
            for a, b in zip(edges, [*edges[1:], len(shard)]):
                if shard[a] != now:
                    yield from left()
                    now, chain, stored = int(shard[a]), None, []
                piece = batch.slice(a, b - a)
                if kind[a]:
                    stored += piece.select(["layer", "bits", "room"]).to_pylist()
                    continue
                if chain is None:
                    chain, stored = _chains(stored, options), []
                keys = piece["h"].to_numpy().view(np.uint64)
                fresh, at = np.unique(keys, return_index=True)
                repeat = np.ones(len(keys), bool)
                repeat[at] = chain.seen(fresh)
                chain.add(fresh[~repeat[at]])
                layers = pa.array(np.full(len(keys), len(chain.layers), np.int32))
                out = {"table_name": piece["table_name"], "record_id": piece["record_id"], "h": piece["h"], "g": piece["g"], "seen": pa.array(repeat), "layers": layers}
                yield pa.RecordBatch.from_arrays([out.get(f.name, pa.nulls(len(keys), f.type)) for f in _ANSWER_SCHEMA], schema=_ANSWER_SCHEMA)
        yield from left()

    return run


class History:
    """What is kept of all keys met so far: each shard's chain, about two bytes a key, as a table in a shared folder.

    ``path`` is a folder the executors share. A batch's answers are computed from the newest complete
    version and written as the next one; a version counts once its marker file is there, so a batch
    that was interrupted is simply run again. ``shards``, ``error`` and ``first_layer`` are fixed by
    the first batch: they are part of what is stored. ``audit`` also keeps two 64-bit hashes of each
    new key on disk (never in memory), by which wrong answers can be counted.
    """

    def __init__(self, spark: SparkSession, path: str, *, shards: int | None = None, error: float = 1e-3, first_layer: int = 1 << 12, audit: bool = False):
        self.spark, self.path, self.audit = spark, path.rstrip("/"), audit
        self.version = max((int(n) for n in self._names() if n.isdigit() and self._exists(f"{self.path}/{n}/facts/_SUCCESS")), default=-1)
        if self.version >= 0:
            facts = spark.read.parquet(f"{self.path}/{self.version}/facts").first()
            shards, error, first_layer, self.audit = facts["shards"], facts["error"], facts["first_layer"], facts["audit"]
        self.shards, self.error, self.first_layer = shards or 4 * parallelism(spark), error, first_layer

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        where, files = self._files(path)
        return files.exists(where)

    def _names(self) -> list[str]:
        where, files = self._files(self.path)
        return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []

    def layers(self) -> DataFrame:
        """``shard, layer, bits, room`` of the newest version."""
        if self.version < 0:
            return self.spark.createDataFrame([], _LAYERS)
        return self.spark.read.schema(_LAYERS).parquet(f"{self.path}/{self.version}/layers")

    def known(self) -> DataFrame:
        """``h, g`` of the keys stored as new so far (``audit`` only)."""
        parts = [f"{self.path}/{v}/new" for v in range(self.version + 1)] if self.audit else []
        return self.spark.read.schema("h long, g long").parquet(*parts) if parts else self.spark.createDataFrame([], "h long, g long")

    def ask(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``answers`` for one batch of ``rows``, which from then on belong to the history."""
        answered, certain = _answered(rows, self.layers(), self.shards, self.error, self.first_layer, keep=True)
        new = f"{self.path}/{self.version + 1}"
        answered.where("layer is not null").select("shard", "layer", "bits", "room").write.mode("overwrite").parquet(f"{new}/layers")
        asked = answered.where("layer is null").drop("shard", "layer", "bits", "room")
        if self.audit:
            missed = _wrong_keys(asked, self.known()).select("h", "g")  # new, though its chain said otherwise
            asked.where("not seen").select("h", "g").unionByName(missed).write.mode("overwrite").parquet(f"{new}/new")
        self.spark.createDataFrame([(self.shards, self.error, self.first_layer, self.audit)], "shards int, error double, first_layer int, audit boolean").coalesce(1).write.mode("overwrite").parquet(f"{new}/facts")
        self.version += 1
        return asked, certain


def _answered(rows: DataFrame, layers: DataFrame | None, shards: int, error: float, first_layer: int, keep: bool) -> tuple[DataFrame, DataFrame]:
    partitions = parallelism(rows.sparkSession)
    stream = rows.where("key is not null and record_id is not null").select("table_name", F.col("record_id").cast("long").alias("record_id"), "key", F.xxhash64("table_name", "key").alias("h"))
    stream = stream.withColumn("g", F.xxhash64(F.lit(1), "key", "table_name"))
    combined = cut(arrow_map(stream, _combine, _STREAM))
    asked = (
        combined.where("not known")
        .select("table_name", "record_id", "h", "g", F.pmod(F.col("h"), F.lit(shards)).cast("int").alias("shard"))
        .repartition(partitions, "shard")
        .groupBy("shard", "record_id", "table_name", "h", "g")  # repeated rows meet where they are
        .agg(F.lit(None).cast("int").alias("layer"))
    )
    if layers is not None:
        asked = asked.withColumns({"bits": F.lit(None).cast("binary"), "room": F.lit(None).cast("int")}).unionByName(layers.repartition(partitions, "shard"), allowMissingColumns=True).repartition(partitions, "shard")
    # stored layers first: their record_id is null
    ordered = asked.sortWithinPartitions("shard", "record_id")
    options = {"error": error, "first": first_layer}
    return cut(arrow_map(ordered, _answer(options, keep), _ANSWERED)), combined.where("known").select("table_name", "record_id").distinct()


def answers(rows: DataFrame, *, error: float = 1e-3, first_layer: int = 1 << 12, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What the chains answer for ``rows`` (``table_name, record_id, key``), in order of ``record_id``, without a history.

    Gives ``table_name, record_id, h, g, seen, layers`` for rows put to a chain (``h`` and ``g`` are hashes
    of the key), and the rows left out because an earlier row of their key stood in the same batch
    (``table_name, record_id``; certain repeats). Leaving those out keeps a key that owns a third of all
    rows from loading its shard. Each shard of the key hash has its own chain and keeps about two bytes
    per key, no keys. ``History.ask`` does the same with what earlier batches left.
    """
    asked, certain = _answered(rows, None, shards or 4 * parallelism(rows.sparkSession), error, first_layer, keep=False)
    return asked.drop("shard", "layer", "bits", "room"), certain


def _wrong_keys(answered: DataFrame, known: DataFrame | None) -> DataFrame:
    positive = answered.where("seen").groupBy("h", "g").agg(F.min(F.struct("record_id", "table_name")).alias("first"))
    new = answered.where("not seen").select("h", "g")
    new = new if known is None else new.unionByName(known)
    return positive.join(new, ["h", "g"], "left_anti")


def wrong_answers(answered: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``table_name, record_id`` of the false answers among ``answered``.

    Only the earliest positive row of a key can be wrong, and then no row of it was ever answered
    ``new``. So only keys with a positive answer are checked: one row each against the rows answered
    ``new`` (and those of earlier batches, ``known``), by two independent 64-bit hashes of the key.
    """
    return _wrong_keys(answered, known).select("first.table_name", "first.record_id")


def seen_before(rows: DataFrame, *, exact: bool = True, history: History | None = None, **options) -> DataFrame:
    """``table_name, record_id`` of rows whose ``key`` occurs in a row of their table with a smaller id.

    Without ``exact``: the chains' own answers, wrong with a probability of ``error`` at most for a new
    key. With it, the chains' false answers, found by a check of the keys answered ``seen``, are taken out
    (with a ``history`` that takes its ``audit``). Rows of a ``history``'s earlier batches count as earlier.
    Null keys or ids never count and aren't compared; repeated rows come out once and aren't
    repeats of themselves; other columns are ignored; an empty table gives an empty result.
    """
    if exact and history is not None and not history.audit:
        raise ValueError("an exact check of a history takes audit=True")
    known = history.known() if exact and history is not None else None
    answered, certain = history.ask(rows) if history is not None else answers(rows, **options)
    positive = answered.where("seen").select("table_name", "record_id")
    if exact:
        positive = positive.join(wrong_answers(answered, known), ["table_name", "record_id"], "left_anti")
    return positive.unionByName(certain).distinct()


def error_report(rows: DataFrame, *, history: History | None = None, error: float = 1e-3, **options) -> DataFrame:
    """Per table: different rows asked, answers ``seen``, wrong ones, their share among new keys, and the bound kept."""
    known = history.known() if history is not None else None
    answered, certain = history.ask(rows) if history is not None else answers(rows, error=error, **options)
    certain = certain.join(answered.select("table_name", "record_id"), ["table_name", "record_id"], "left_anti")
    asked = answered.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_asked"), F.sum(F.col("seen").cast("long")).alias("n_seen"))
    wrong = wrong_answers(answered, known).groupBy("table_name").agg(F.count(F.lit(1)).alias("n_wrong"))
    sure = certain.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_certain"))
    out = asked.join(wrong, "table_name", "left").join(sure, "table_name", "left").na.fill(0, ["n_wrong", "n_certain"])
    new = F.col("n_asked") - F.col("n_seen") + F.col("n_wrong")
    return out.select(
        "table_name",
        (F.col("n_asked") + F.col("n_certain")).alias("n_rows"),
        (F.col("n_seen") + F.col("n_certain")).alias("n_seen"),
        "n_wrong",
        F.coalesce(F.col("n_wrong") / F.when(new > 0, new), F.lit(0.0)).alias("wrong_share"),
        F.lit(float(history.error if history is not None else error)).alias("bound"),
    )
