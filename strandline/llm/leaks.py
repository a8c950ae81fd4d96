"""Evaluation texts inside training documents: CGK embedding, bit-sampling LSH, exact verification."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import arrow_map, ship

#: Characters handled at once by a Python worker, which bounds its memory (one longer text goes alone).
SLICE = 4_000_000
#: Windows of items per broadcast index: about 200 bytes each with all repetitions. More items make more blocks.
WINDOWS_PER_BLOCK = 200_000
#: Blocks a worker keeps in memory; with more of them it gathers documents of BUFFER bytes and loads the blocks in turn.
BLOCKS_HELD = 4
BUFFER = 64 << 20
_WORD_GAP = r"[^\p{L}\p{Nd}]+"


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` in order - lower-cased runs of letters and digits of any script - and each text's first place."""
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), _WORD_GAP)
    owner, flat = pc.list_parent_indices(parts), pc.list_flatten(parts)
    real = pc.not_equal(flat, "")
    owner, flat = owner.filter(real).to_numpy(), flat.filter(real)
    return flat, np.searchsorted(owner, np.arange(len(texts) + 1))


@dataclass
class Repetition:
    """One random walk and one sample of its places."""

    coins: np.ndarray  # a row of 64 coin bits per word of the vocabulary for every 64 steps of the walk
    places: np.ndarray
    keys: np.ndarray = field(default=None)  # sorted keys of the item windows
    at: np.ndarray = field(default=None)  # the window of each key


@cache
def walks_needed(window: int, edits: int, recall: float, sampled: int, pairs: int = 64, walks: int = 192) -> int:
    """How many independent walks let two windows ``edits`` apart meet with probability ``recall``, found by simulation.

    Where the edits stand and whether they change, add or drop words decides how long two walks stay apart
    (their distance has no short tail), so pairs of every kind are walked many times and the worst kind counts.
    """
    if not edits:
        return 1
    rng, most = np.random.default_rng(window * 1009 + edits), 1
    for kind in ("s", "i", "d"):
        pad = window + edits
        left, right = np.full((pairs, pad + 1), pad), np.full((pairs, pad + 1), pad)
        left[:, :window] = np.arange(window)
        for p in range(pairs):
            text = list(range(window))
            for n, at in enumerate(sorted(rng.choice(window, edits, replace=False), reverse=True)):
                text[at : at + (kind != "i")] = [] if kind == "d" else [window + n]
            right[p, : len(text)] = text
        met = np.ones((walks, pairs), bool)
        for w in range(walks):
            coins = rng.integers(0, 2, (3 * window, pad + 1))
            wanted = set(rng.choice(3 * window, sampled, replace=False).tolist())
            a, b, row = np.zeros(pairs, int), np.zeros(pairs, int), np.arange(pairs)
            for step in range(max(wanted) + 1):
                x, y = left[row, a], right[row, b]
                if step in wanted:
                    met[w] &= x == y
                a, b = np.minimum(a + coins[step][x], pad), np.minimum(b + coins[step][y], pad)
        chance = np.maximum(met.mean(0), 0.3 / walks)  # of each pair in one walk
        aim = recall + 0.3 * (1 - recall)  # leaves room for the simulation's own error
        while (1 - (1 - chance) ** most).mean() < aim:
            most += max(1, most // 16)
    return most


class LeakIndex:
    """Item windows under ``repetitions`` independent CGK walks, for at most ``edits`` word edits.

    CGK reads a window with a pointer that moves on or waits by a coin drawn for (step, word), so
    two windows a few edits apart soon read the same words again: edit distance becomes Hamming
    distance. Sampling places of the output gives buckets; equal windows always meet, others with
    a probability that the number of repetitions lifts to ``recall``. An edit may add or drop a word,
    so stretches of ``window - edits`` to ``window + edits`` words are compared with an item's window.
    """

    def __init__(self, items: list[tuple[int, str]], *, window: int, edits: int, recall: float, sampled: int, seed: int):
        self.window, self.edits = window, edits
        flat, starts = words(pa.array([t for _, t in items], pa.string()))
        self.vocabulary = flat.unique().combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat.unique()
        tokens = self.encode(flat)
        begin = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(starts, starts[1:])] or [np.zeros(0, int)]).astype(np.int64)
        owner = np.searchsorted(starts, begin, "right") - 1
        self.items = np.array([i for i, _ in items], np.int64)[owner] if len(begin) else np.zeros(0, np.int64)
        self.windows = tokens[begin[:, None] + np.arange(window)] if len(begin) else np.zeros((0, window), np.int32)
        # of edits + 1 equal parts of a window, some part is whole after that many edits
        self.part = max(1, window // (edits + 1))
        self.parts = np.unique(self._hashes(tokens)[(begin[:, None] + np.arange(window - self.part + 1)).ravel()]) if len(begin) else np.zeros(0, np.uint64)
        rng = np.random.default_rng(seed)
        self.repetitions = []
        for _ in range(walks_needed(window, edits, recall, sampled)):
            coins = rng.integers(0, 2**64, (3 * window // 64 + 1, len(self.vocabulary) + 2), np.uint64)
            one = Repetition(coins, np.sort(rng.choice(3 * window, sampled, replace=False)))
            keys, _ = self.embed(tokens, begin, np.arange(-edits, edits + 1) == np.zeros((len(begin), 1)), one)
            order = np.argsort(keys, kind="stable")
            one.keys, one.at = keys[order], order
            self.repetitions.append(one)

    def encode(self, flat: pa.Array) -> np.ndarray:
        """Each word's place in the items' vocabulary, or its length for a word of no item."""
        coded = flat.dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        places = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.vocabulary), len(self.vocabulary)).to_numpy(zero_copy_only=False).astype(np.int32)
        return places[coded.indices.to_numpy()]

    def _hashes(self, tokens: np.ndarray) -> np.ndarray:
        """Hashes of each ``part`` words in a row."""
        n = max(0, len(tokens) - self.part + 1)
        out = np.zeros(n, np.uint64)
        for i in range(self.part):
            out = (out ^ tokens[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def embed(self, tokens: np.ndarray, begin: np.ndarray, lengths: np.ndarray, one: Repetition) -> tuple[np.ndarray, np.ndarray]:
        """LSH keys of stretches of ``tokens``, and the place in ``begin`` of each.

        Column k of ``lengths`` says which stretches of ``window - edits + k`` words are wanted.
        """
        pad, shortest = len(self.vocabulary) + 1, self.window - self.edits
        rows = np.arange(len(begin))
        at, end = begin, None
        keys = np.zeros(len(begin), np.uint64)
        wanted = set(one.places.tolist())
        for j in range(int(one.places[-1]) + 1):
            if j == shortest:  # no walk has come to an end before; from here on the lengths part
                row, k = np.nonzero(lengths[rows])
                rows, at, keys = rows[row], at[row], keys[row]
                end = begin[rows] + shortest + k
            word = tokens[at] if end is None else np.where(at < end, tokens[np.minimum(at, len(tokens) - 1)], pad)
            at = at + ((one.coins[j >> 6][word] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64)
            if j in wanted:
                keys = (keys ^ word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                keys ^= keys >> np.uint64(29)
        return (keys, rows) if end is not None else (np.repeat(keys, lengths[rows].sum(1)), rows[np.nonzero(lengths[rows])[0]])

    def _distance(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Fewest word edits between a beginning of each row of ``left`` and its window of ``right``; words of no item equal nothing."""
        if not self.edits:
            return np.where((left == right).all(1), 0, 1)
        w, e, unknown = self.window, self.edits, len(self.vocabulary)
        left, right = np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)
        more = np.full(left.shape[1], e + 1, np.int16)  # away from the diagonal more edits are needed
        row = [np.full(left.shape[1], min(j, e + 1), np.int16) for j in range(w + 1)]
        best = row[w]
        for i, read in enumerate(left, 1):
            new = [more] * (w + 1)
            new[0] = np.full(left.shape[1], min(i, e + 1), np.int16)
            strange = read == unknown
            for j in range(max(1, i - e), min(w, i + e) + 1):
                differ = (read != right[j - 1]) | strange
                new[j] = np.minimum(np.minimum(row[j], new[j - 1]) + 1, row[j - 1] + differ)
            row, best = new, np.minimum(best, new[w])
        return best

    def search(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text places, item ids and fewest edits of the pairs found, each pair once."""
        flat, starts = words(texts)
        none = np.zeros(0, np.int64)
        shortest, longest, unknown = self.window - self.edits, self.window + self.edits, len(self.vocabulary)
        if len(flat) < shortest or not len(self.windows):
            return none, none, none
        tokens = self.encode(flat)
        strange = np.r_[0, np.cumsum(tokens == unknown)]
        begin = np.flatnonzero(strange[shortest:] - strange[:-shortest] <= self.edits)  # else more edits are needed
        if self.edits < self.window:  # nor does it do without a part of an item
            hashes = self._hashes(tokens)
            at = np.minimum(np.searchsorted(self.parts, hashes), len(self.parts) - 1)
            whole = np.r_[0, np.cumsum(self.parts[at] == hashes)]
            begin = begin[whole[np.minimum(begin + longest - self.part + 1, len(hashes))] > whole[np.minimum(begin, len(hashes))]]
        owner = np.searchsorted(starts, begin, "right") - 1
        inside = begin + shortest <= starts[owner + 1]
        begin, owner = begin[inside], owner[inside]
        last = starts[owner + 1]
        lengths = np.stack([(begin + n <= last) & (strange[np.minimum(begin + n, len(tokens))] - strange[begin] <= self.edits) for n in range(shortest, longest + 1)], axis=1)
        ahead = np.arange(longest)
        found, met, n_met = [], [], 0
        for one in self.repetitions:
            keys, mine = self.embed(tokens, begin, lengths, one)
            low, high = np.searchsorted(one.keys, keys, "left"), np.searchsorted(one.keys, keys, "right")
            n = high - low
            theirs = one.at[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            met.append(np.unique(np.repeat(mine, n) * len(self.windows) + theirs))
            n_met += len(met[-1])
            if n_met < 2_000_000 and one is not self.repetitions[-1]:
                continue
            candidates, met, n_met = np.unique(np.concatenate(met)), [], 0
            for a in range(0, len(candidates), 50_000):
                m, t = np.divmod(candidates[a : a + 50_000], len(self.windows))
                where = begin[m][:, None] + ahead
                read = np.where(where < last[m][:, None], tokens[np.minimum(where, len(tokens) - 1)], unknown)  # no word of the next text
                edits = self._distance(read, self.windows[t])
                good = edits <= self.edits
                found.append(np.unique(np.stack([owner[m][good], self.items[t][good], edits[good]]), axis=1))
        if not found:
            return none, none, none
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)  # sorted: the fewest edits of a pair come first
        first = np.r_[True, (pairs[:2, 1:] != pairs[:2, :-1]).any(0)] if pairs.shape[1] else np.zeros(0, bool)
        return tuple(pairs[:, first])


def window_sizes(least: int, longest: int = 10_000) -> list[int]:
    """The sizes of item-sized windows: from ``least`` words on, each a quarter larger than the one before."""
    out = [least]
    while out[-1] < longest:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


def _blocks(items: DataFrame, window: int, whole: bool, options: dict) -> list:
    """Broadcasts of the indexes of the stated items. Tasks build them, each for items of one window size with a bounded number of windows."""
    spark = items.sparkSession
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    rows = rows.withColumn("_n", F.size(F.filter(F.split(F.lower("text"), _WORD_GAP, -1), lambda w: w != ""))).where(F.col("_n") >= window)
    sizes = F.array(*map(F.lit, window_sizes(window)))
    size = F.element_at(F.filter(sizes, lambda x: x <= F.col("_n")), -1) if whole else F.lit(window)
    rows = rows.withColumn("size", size).withColumn("_windows", F.col("_n") - F.col("size") + 1)
    share = F.ceil(F.sum("_windows").over(Window.partitionBy("size")) / WINDOWS_PER_BLOCK)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), share).cast("long"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["item_id", "text"])
        index = LeakIndex(list(zip(group["item_id"].tolist(), group["text"].tolist())), window=int(group["size"].iloc[0]), **options)
        return pd.DataFrame({"index": [pickle.dumps(index)]})

    ship(spark)
    built = rows.select("item_id", "text", "size", "block").groupBy("size", "block").applyInPandas(build, "index binary")
    return [spark.sparkContext.broadcast(bytes(row["index"])) for row in built.toLocalIterator()]


def leaks(documents: DataFrame, items: DataFrame, *, window: int = 12, whole: bool = False, edits: int = 0, recall: float = 0.95, sampled: int = 8, seed: int = 7) -> DataFrame:
    """``doc_id, item_id, edits``: documents with ``window`` consecutive words of an item, up to ``edits`` words changed, added or dropped.

    With ``whole`` windows are item-sized instead: an item is sought by stretches of the largest of
    ``window_sizes(window)`` it holds, 80 % of the item or more. Exact sharing (``edits=0``) is found without
    loss, since equal windows get equal keys; with edits a pair is found with probability ``recall`` or more.
    Every hit is verified. Documents stay where they are and are read once: tasks build the index of the
    stated items in blocks of bounded size, and a worker that reads documents puts them to one block after another.

    Nulls: a null text has no words, rows with null id are ignored. Items shorter than ``window``
    words and documents shorter than a window less ``edits`` match nothing. A text of any length is read whole. Repeated rows come out once, other
    columns are ignored, empty tables give an empty result.
    """
    blocks = _blocks(items, window, whole, {"edits": edits, "recall": recall, "sampled": sampled, "seed": seed})
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, LeakIndex] = {}

        def index(i: int) -> LeakIndex:
            if i not in held:
                if len(held) >= BLOCKS_HELD:
                    held.clear()
                held[i] = pickle.loads(blocks[i].value)
                blocks[i].__dict__.pop("_value", None)  # its bytes aren't needed any more
            return held[i]

        def search(buffer: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(buffer).combine_chunks()
            sizes = np.cumsum(pc.utf8_length(rows["text"]).to_numpy())
            for n in range(len(blocks)):
                a = 0
                while a < rows.num_rows:
                    b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + SLICE, "right")))
                    place, item, edited = index(n).search(rows["text"].slice(a, b - a).combine_chunks())
                    found = rows["doc_id"].slice(a, b - a).take(pa.array(place)).combine_chunks()
                    yield pa.RecordBatch.from_arrays([found, pa.array(item, pa.int64()), pa.array(edited, pa.int32())], ["doc_id", "item_id", "edits"])
                    a = b

        buffer, size = [], 0
        for batch in batches:
            buffer.append(batch)
            size += batch.nbytes
            if size >= (BUFFER if len(blocks) > BLOCKS_HELD else 1):  # blocks that can't be held are loaded once a buffer
                yield from search(buffer)
                buffer, size = [], 0
        if buffer:
            yield from search(buffer)

    out = arrow_map(texts, run, "doc_id long, item_id long, edits int")
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def leaked_items(pairs: DataFrame) -> DataFrame:
    """``item_id, n_docs, edits`` of the items that leaked."""
    return pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("edits").alias("edits"))
