"""Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.session import cut, ship

#: The words of the endless random source.
RANDOM_WORDS = ("The", "quick", "brown", "fox", "jumps", "over", "dog")


def random_words(spark: SparkSession, rows_per_second: int = 10, words: tuple[str, ...] = RANDOM_WORDS) -> DataFrame:
    """An endless stream ``word, ts`` of words drawn at random."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    array = F.array(*[F.lit(w) for w in words])
    return rate.select(F.element_at(array, (F.floor(F.rand() * len(words)) + 1).cast("int")).alias("word"), F.col("timestamp").alias("ts"))


def running_counts(words: DataFrame, word: str = "word") -> DataFrame:
    """``word, n`` so far; for complete or update mode."""
    return words.where(F.col(word).isNotNull()).groupBy(word).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, key: str, ts: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, key, n`` of tumbling windows; rows later than ``late`` are dropped, state older than that is freed."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")


def new_documents(postings: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    """Incremental document counts: each (word, url_hash) once, for ``running_counts``."""
    return postings.withWatermark(ts, late).dropDuplicatesWithinWatermark(["word", "url_hash"])


def worker_sessions(checkins: DataFrame, timeout: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """``worker, alive_from, alive_until``: check-ins closer than ``timeout`` belong to one life."""
    lives = checkins.withWatermark("ts", late).groupBy(F.session_window("ts", timeout).alias("s"), "worker").agg(F.count(F.lit(1)).alias("n"))
    return lives.select("worker", F.col("s.start").alias("alive_from"), F.col("s.end").alias("alive_until"), "n")


def polite(attempts: DataFrame, delay_seconds: float, late: str = "10 seconds") -> DataFrame:
    """``host, ts, accepted`` of a stream ``host, ts``: the per-host clock is keyed state and moves on accepted visits."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")  # one micro-batch of one host
        accepted = []
        for t in rows["ts"].astype("int64") // 1000 if str(rows["ts"].dtype).endswith("[ns]") else rows["ts"].astype("datetime64[us]").astype("int64"):
            ok = last is None or t - last >= delay_seconds * 1_000_000
            last = t if ok else last
            accepted.append(ok)
        state.update((int(last),))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(last // 1000 + delay_seconds * 1000)))
        yield pd.DataFrame({"host": key[0], "ts": rows["ts"].to_numpy(), "accepted": accepted})

    ship(attempts.sparkSession)
    keyed = attempts.withWatermark("ts", late).groupBy("host")
    return keyed.applyInPandasWithState(step, "host string, ts timestamp, accepted boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def crawl_stream(spark: SparkSession, frontier: str, links_of: Callable[[DataFrame], DataFrame], allow: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """The crawl's loop as a stream over a folder: URLs (``url``) that arrive in ``frontier`` are visited, and what they link to goes back into it.

    Each micro-batch reads the files that came since the last one, keeps those of its URLs it hasn't visited,
    writes them to ``<frontier>/../visited`` and their allowed, unvisited links as new files of ``frontier``, which
    the stream reads next. It rests when nothing new is found. Both folders must be shared; a batch
    that is done again after a failure overwrites its own part, so each URL is visited once however long ago it was seen.
    """
    folder = frontier.rstrip("/").rsplit("/", 1)[0]
    visited = f"{folder}/visited"

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        old = session.read.schema("url string, round long").parquet(f"{visited}/round=*") if number else None
        new = batch.select("url").where("url is not null").distinct()
        new = new.join(old.where(F.col("round") < number).select("url"), "url", "left_anti") if old is not None else new
        new.withColumn("round", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{visited}/round={number}")
        done = session.read.schema("url string, round long").parquet(f"{visited}/round=*").where(F.col("round") <= number)
        now = done.where(F.col("round") == number).select("url")
        found = allow(links_of(now).select(F.col("link").alias("url")).distinct().join(done.select("url"), "url", "left_anti"))
        rows = cut(found.select("url").distinct())
        if not rows.isEmpty():
            rows.write.mode("overwrite").parquet(f"{frontier}/batch-{number}")

    stream = spark.readStream.schema("url string").option("recursiveFileLookup", "true").parquet(frontier)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
