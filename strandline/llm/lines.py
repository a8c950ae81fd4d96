"""Lines that one site repeats over many of its pages."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.skew import salted_lookup
from strandline.session import arrow_map, cut, parallelism

LEAST_PAGES = 5
#: Confirmed lines are broadcast only while their whole set is at most this many bytes.
BROADCAST_BYTES = 32 << 20
#: Lines a task gathers before it folds them into summaries (8 bytes each).
BUFFER = 2_000_000
_ASCII = r"\t\x0B\f\r"
_WIDE = _ASCII + r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space other than line breaks; a single space is left as it is. The look-ahead passes over ASCII letters fast.
_ASCII_SPACE = rf"[ {_ASCII}]{{2,}}|[{_ASCII}]"
_SPACE = rf"(?![!-~])(?:[ {_WIDE}]{{2,}}|[{_WIDE}])"


def normal(text: Column) -> Column:
    """Lower-cased text, each run of white space inside a line one space and each run of digits ``0``."""
    low = F.lower(text)
    spaced = F.when(F.octet_length(low) == F.length(low), F.regexp_replace(low, _ASCII_SPACE, " ")).otherwise(F.regexp_replace(low, _SPACE, " "))
    return F.regexp_replace(spaced, "[0-9]+", "0")


def _lines(texts: DataFrame) -> DataFrame:
    """``text_id, url, site, line_no, key``; whole texts are normalised at once, then cut."""
    split = texts.where("text is not null").select("text_id", "url", "site", F.posexplode(F.split(normal(F.col("text")), "\n", -1)).alias("at", "line"))
    return split.select("text_id", "url", "site", (F.col("at") + 1).alias("line_no"), F.trim("line").alias("key")).where("key <> ''")


class Summary:
    """Misra-Gries counters of one slice of (site, line) fingerprints; bounded, mergeable, never too high by a merge.

    Holds at most ``k`` counters. When more are needed, the (k+1)-th largest count is taken off all of
    them and ``error`` grows by it: a line's true count lies between its counter and counter + ``error``,
    and ``error * (k + 1)`` is at most the mass of the lines that aren't among the ``k`` largest.
    """

    def __init__(self, k: int):
        self.k, self.error = k, 0
        self.lines, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, lines: np.ndarray, counts: np.ndarray, error: int = 0) -> None:
        both = np.concatenate([self.lines, lines])
        self.lines, place = np.unique(both, return_inverse=True)
        self.counts = np.bincount(place, np.concatenate([self.counts, counts]), len(self.lines)).astype(np.int64)
        self.error += error
        if len(self.lines) > self.k:
            off = int(np.partition(self.counts, len(self.counts) - self.k - 1)[len(self.counts) - self.k - 1])
            kept = self.counts > off
            self.lines, self.counts, self.error = self.lines[kept], self.counts[kept] - off, self.error + off

    def candidates(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Lines that may have ``least`` occurrences, and how many at most. None is missed while ``error < least``."""
        most = self.counts + self.error
        return self.lines[most >= least], most[most >= least]


def _packed(lines: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted fingerprints as gaps, and their counts, byte plane by byte plane: mostly zeros, which compress."""
    gaps = np.diff(lines, prepend=np.uint32(0)).astype("<u4")
    planes = np.concatenate([gaps, counts.astype("<u4")]).view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T
    both = np.ascontiguousarray(planes).view("<u4").ravel()
    gaps, counts = np.split(both, 2)
    return np.cumsum(gaps, dtype=np.uint64).astype(np.uint32), counts.astype(np.int64)


def _summarise(bits: int, k: int):
    """Fold a task's fingerprints into one summary a slice; a full buffer is folded and handed on, so memory is bounded."""

    def fold(buffer: list[np.ndarray]) -> pa.RecordBatch:
        marks, counts = np.unique(np.concatenate(buffer), return_counts=True)
        slices = (marks >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1]]) if len(marks) else np.zeros(0, int)
        names, packed, errors = [], [], []
        for a, b in zip(edges, [*edges[1:], len(marks)]):
            one = Summary(k)
            one.merge((marks[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts[a:b])
            names.append(int(slices[a]))
            packed.append(_packed(one.lines, one.counts))
            errors.append(one.error)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packed, pa.binary()), pa.array(errors, pa.int64())], ["slice", "packed", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, held = [], 0
        for batch in batches:
            buffer.append(batch["h"].to_numpy().view(np.uint64) >> np.uint64(32 - bits))
            held += len(buffer[-1])
            if held >= BUFFER:
                yield fold(buffer)
                buffer, held = [], 0
        if held:
            yield fold(buffer)

    return run


def _merge(k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            fold(0)
            lines, most = one.candidates(least)
            marks = (np.uint64(now) << np.uint64(32)) | lines.astype(np.uint64)
            # the first row tells the slice's error
            return pa.RecordBatch.from_arrays([pa.array(np.r_[np.uint64(0), marks].view(np.int64)), pa.array(np.r_[one.error, most]), pa.array(np.r_[True, np.zeros(len(most), bool)])], ["mark", "n_texts", "told"])

        def fold(room: int) -> None:
            """Merge what waits once it is more than the summary holds, so that each counter is touched a few times only."""
            if waiting and sum(len(x[0]) for x in waiting) > room:
                one.merge(np.concatenate([x[0] for x in waiting]), np.concatenate([x[1] for x in waiting]), sum(x[2] for x in waiting))
                waiting.clear()

        now, one, waiting = None, None, []
        for batch in batches:
            for at, packed, error in zip(batch["slice"].to_pylist(), batch["packed"], batch["error"].to_pylist()):
                if at != now:
                    if one is not None:
                        yield done()
                    now, one = at, Summary(k)
                waiting.append((*_unpacked(packed.as_py()), error))
                fold(max(len(one.lines), 100_000))
        if one is not None:
            yield done()

    return run


def _fingerprint(bits: int) -> Column:
    """The ``32 + bits`` first bits of the hash of a site's line."""
    return F.shiftrightunsigned(F.xxhash64("site", "key"), 32 - bits)


def summaries(texts: DataFrame, least: int, *, k: int = 1 << 20, bits: int | None = None) -> tuple[DataFrame, int]:
    """Candidates ``mark, n_texts`` from mergeable heavy-hitter summaries, and the bits that number the slices.

    A site's lines are dealt over slices by their hash, all slices being equally full whatever the
    sites' sizes. Each task folds its lines into one Misra-Gries summary a slice; the summaries - a few
    bytes a line - are shuffled and merged. With ``k`` counters no line of ``least`` occurrences is
    missed while the lines of a slice that aren't among its ``k`` largest have less than
    ``least * (k + 1)`` occurrences. The number of slices follows the table's size; should a merged
    summary report an error of ``least`` or more all the same, the pass is repeated with more slices,
    so nothing is missed for certain. Counts are never too low, only too high (a collision, a
    page fetched twice): the second pass is exact.
    """
    spark = texts.sparkSession
    # steers the number of slices only; a plan without statistics counts as 64 kB a text
    size = min(int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), texts.count() << 16)
    if bits is None:
        bits = min(31, max(2, math.ceil(math.log2(max(2 * parallelism(spark), size / (8 * k))))))
    hashed = _lines(texts).select(F.xxhash64("site", "key").alias("h"))
    parts = arrow_map(hashed, _summarise(bits, k), "slice long, packed binary, error long")
    ordered = parts.repartition(parallelism(spark), "slice").sortWithinPartitions("slice")
    merged = cut(arrow_map(ordered, _merge(k, least), "mark long, n_texts long, told boolean"))
    worst = merged.where("told").agg(F.max("n_texts")).first()[0] or 0
    if worst >= least and bits < 31:
        return summaries(texts, least, k=k, bits=min(31, bits + 2))
    return merged.where("not told").select("mark", "n_texts"), bits


def repeated_lines(texts: DataFrame, least_pages: int = LEAST_PAGES, *, k: int = 1 << 20) -> DataFrame:
    """``text_id, line_no, site, key`` of lines found in at least ``least_pages`` different pages of their site.

    Candidates come from the merged summaries of ``k`` counters; a second pass counts their pages
    exactly. Nulls: a text without ``text`` or ``site`` has no lines, one without ``url`` counts for no
    page but loses its repeated lines too. Empty lines never count. Repeated rows come out once; other
    columns are ignored; an empty table gives an empty result.
    """
    known = texts.where("site is not null")
    candidates, bits = summaries(known, least_pages, k=k)
    lines = _lines(known).withColumn("_k", _fingerprint(bits))
    kept = cut(_members(lines, candidates.select(F.col("mark").alias("_k"), "n_texts"), "n_texts").drop("_k"))
    pages = kept.where("url is not null").select("site", "key", "url").distinct().groupBy("site", "key").agg(F.count(F.lit(1)).alias("n_pages"))
    confirmed = pages.where(F.col("n_pages") >= least_pages).select(F.struct("site", "key").alias("_k"), "n_pages")
    return _members(kept.withColumn("_k", F.struct("site", "key")), confirmed, "n_pages").select("text_id", "line_no", "site", "key").distinct()


def _members(lines: DataFrame, keys: DataFrame, n: str) -> DataFrame:
    """The ``lines`` whose ``_k`` is in ``keys``: a broadcast set while its measured size is under the bound, else a salted join."""
    stored = cut(keys)
    size = stored.agg(F.sum(F.length(F.col("_k").cast("string")) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return lines.join(F.broadcast(stored.select("_k")), "_k", "left_semi")
    return salted_lookup(lines, stored, "_k", ["text_id", "line_no"], n)  # a hot line's rows are split


def without_repeated(texts: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``texts`` with the repeated lines taken out of ``text``, and ``n_removed``; all other lines stay as they are."""
    gone = repeated_lines(texts, least_pages).groupBy("text_id").agg(F.collect_set("line_no").alias("_gone"))
    joined = texts.join(gone, "text_id", "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.col("_gone"), i + 1))
    return joined.withColumn("text", F.array_join(kept, "\n")).withColumn("n_removed", F.size("_gone")).drop("_gone")
