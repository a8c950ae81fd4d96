"""Crawl policy over stored pages: robots rules, delays, filters, the frontier."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import url as U
from strandline.session import arrow_map, cut, parallelism

#: Hosts that skip the encyclopedia and cap tests, and what marks an encyclopedia's host.
BYPASS = ("en.wikipedia.org", "www.amazon.com")
REFERENCE_HOST = "wiki"
HOST_CAP = 100


def robots_rules(lines: Column, agent: str) -> Column:
    """``struct<allow, disallow, crawl_delay>`` of the ordered lines of one robots.txt.

    The rules are those of the first block for ``*`` or ``agent``; later blocks of ``agent`` replace
    them. A delay that is no whole number counts as 0. The fold reads each line once.
    """
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("state"), none.alias("allow"), none.alias("disallow"), F.lit(0).alias("delay"))
    own = f"user-agent: {agent.lower()}"

    def step(a: Column, raw: Column) -> Column:
        line = F.lower(raw)
        opens = (a["state"] == 0) & ((line == "user-agent: *") | (line == own))
        any_agent = F.startswith(line, F.lit("user-agent"))
        again = (a["state"] >= 1) & F.startswith(line, F.lit(own))
        # 0: looking for the first block, 1: reading a block, 2: between blocks, where only the agent's own opens
        state = F.when(opens | again, 1).when((a["state"] == 1) & any_agent, 2).otherwise(a["state"])
        reading = (state == 1) & ~any_agent
        delay = F.coalesce(F.trim(F.substr(line, F.lit(14), F.length(line))).try_cast("int"), F.lit(0))
        return F.struct(
            state.alias("state"),
            F.when(again, none).when(reading & F.startswith(line, F.lit("allow: ")), F.concat(a["allow"], F.array(F.substr(line, F.lit(8), F.length(line))))).otherwise(a["allow"]).alias("allow"),
            F.when(again, none).when(reading & F.startswith(line, F.lit("disallow: ")), F.concat(a["disallow"], F.array(F.substr(line, F.lit(11), F.length(line))))).otherwise(a["disallow"]).alias("disallow"),
            F.when(again, 0).when(reading & F.startswith(line, F.lit("crawl-delay")), delay).otherwise(a["delay"]).alias("delay"),
        )

    return F.aggregate(lines, start, step, lambda a: F.struct(a["allow"].alias("allow"), a["disallow"].alias("disallow"), a["delay"].alias("crawl_delay")))


def parse_robots(files: DataFrame, agent: str = "crawler") -> DataFrame:
    """``host, allow, disallow, crawl_delay`` from ``host, text``; a null text has no rules, of repeated hosts the largest text counts."""
    one = files.where("host is not null").groupBy("host").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    return one.select("host", robots_rules(F.split("text", "\r?\n"), agent).alias("r")).select("host", "r.*")


def _matches(rules: Column, path: Column) -> Column:
    return F.exists(rules, lambda r: F.when(F.endswith(r, F.lit("/")), F.contains(path, r) & (path != r)).otherwise(path == r))


def allowed(host: Column, path: Column, allow: Column, disallow: Column, visited: Column, cap: int = HOST_CAP) -> Column:
    """Whether a path may be fetched: caps first, then allow rules, then disallow rules, else yes."""
    none = F.array().cast("array<string>")
    free = host.isin(*BYPASS)
    return (
        F.when(~free & F.contains(host, F.lit(REFERENCE_HOST)), False)
        .when(~free & (F.coalesce(visited, F.lit(0)) > cap), False)
        .when(_matches(F.coalesce(allow, none), path), True)
        .when(_matches(F.coalesce(disallow, none), path), False)
        .otherwise(True)
    )


def check_robots(urls: DataFrame, robots: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """``url, allowed``; a URL without host is never allowed, a host without rules always. ``visited``: ``host, n``."""
    parsed = urls.select("url", U.parse(F.col("url")).alias("u")).select("url", F.col("u.host").alias("host"), F.col("u.path").alias("path")).distinct()
    joined = parsed.join(robots.select("host", "allow", "disallow"), "host", "left")
    joined = joined.join(visited.select("host", "n"), "host", "left") if visited is not None else joined.withColumn("n", F.lit(0))
    ok = allowed(F.col("host"), F.col("path"), F.col("allow"), F.col("disallow"), F.col("n"))
    return joined.select("url", F.when(F.col("host").isNull(), False).otherwise(ok).alias("allowed"))


def _delays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    host, last = None, None
    for batch in batches:
        t, delay = batch["t"].to_numpy(), batch["delay"].to_numpy() * 1_000_000
        code = batch["host"].dictionary_encode().indices
        known, code = code.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(code, -1).to_numpy()
        accepted = ~known | (delay == 0)
        edges = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(t) else []
        for a, b in zip(edges, [*edges[1:], len(t)]):
            name = batch["host"][int(a)].as_py()
            if name != host:
                host, last = name, None
            if accepted[a]:
                continue
            at = a if last is None else a + int(np.searchsorted(t[a:b], last + delay[a]))
            while at < b:  # from one accepted attempt to the next
                accepted[at], last = True, int(t[at])
                at += int(np.searchsorted(t[at:b], last + delay[a]))
        yield pa.RecordBatch.from_arrays([batch["host"], batch["t"], batch["n"], pa.array(accepted)], ["host", "t", "n", "accepted"])


def crawl_delay(attempts: DataFrame, delays: DataFrame) -> DataFrame:
    """``host, ts, n, accepted``: attempts in order of time; only an accepted one moves its host's clock.

    ``delays``: ``host, crawl_delay`` (seconds, 0 or unknown passes). A null host always passes. The
    ``n`` attempts of one host and time are one row: with a delay only the first of them is accepted.
    Each decision depends on the last accepted attempt, so a host's attempts are read in order, as a
    stream and without keeping them.
    """
    rows = attempts.where("ts is not null").groupBy("host", F.unix_micros("ts").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    known = rows.join(delays.where("crawl_delay > 0").groupBy("host").agg(F.max("crawl_delay").alias("delay")), "host", "left")
    ordered = known.select("host", "t", "n", F.coalesce("delay", F.lit(0)).cast("long").alias("delay")).repartition(parallelism(attempts.sparkSession), "host").sortWithinPartitions("host", "t")
    done = arrow_map(ordered, _delays, "host string, t long, n long, accepted boolean")
    return done.select("host", F.timestamp_micros("t").alias("ts"), "n", "accepted")


def content_filter(pages: DataFrame, max_mb: float = 20.0) -> DataFrame:
    """Pages of an HTML or XML ``type`` whose ``length`` is at most ``max_mb``; a null type is rejected, a null length passes."""
    kind = F.col("type")
    good = F.startswith(kind, F.lit("text/html")) | F.startswith(kind, F.lit("application/xml")) | F.startswith(kind, F.lit("text/xml")) | F.endswith(kind, F.lit("+xml"))
    return pages.where(good & (F.coalesce(F.col("length"), F.lit(0)) <= max_mb * 1024 * 1024))


def modified(seen: DataFrame, visited: DataFrame) -> DataFrame:
    """``url, last_modified`` of URLs never visited or changed since; of repeated rows the latest counts."""
    now = seen.where("url is not null").groupBy("url").agg(F.max("last_modified").alias("last_modified"))
    then = visited.where("url is not null").groupBy("url").agg(F.max("last_visited").alias("last_visited"))
    return now.join(then, "url", "left").where("last_visited is null or last_modified > last_visited").select("url", "last_modified")


def record_visits(visited: DataFrame, passed: DataFrame) -> DataFrame:
    """``url, last_visited`` after the passed URLs are visited."""
    return visited.select("url", "last_visited").unionByName(passed.select("url", F.col("last_modified").alias("last_visited"))).groupBy("url").agg(F.max("last_visited").alias("last_visited"))


def first_outlinks(outlinks: DataFrame, order: str) -> DataFrame:
    """``url, links`` of the first record of each URL; later ones are ignored."""
    rows = outlinks.where(F.col("url").isNotNull()).groupBy("url").agg(F.min_by("links", order).alias("links"))
    return rows.withColumn("links", F.coalesce("links", F.array().cast("array<string>")))


def within_host_cap(rows: DataFrame, order: str, cap: int = HOST_CAP, host: str = "host") -> DataFrame:
    """The first ``cap + 1`` rows of each host by ``order``, the number fetched before the cap bites."""
    place = Window.partitionBy(host).orderBy(order)
    return rows.withColumn("visit", F.row_number().over(place)).where(F.col("visit") <= cap + 1)


def poll(frontier: DataFrame, n: int = 1000, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The next ``n`` rows of the queue and the rest."""
    head = frontier.orderBy(order).limit(n)
    return head, frontier.join(head.select(order), order, "left_anti")


def ready(frontier: DataFrame, hosts: DataFrame, now: Column) -> DataFrame:
    """``frontier`` with ``ready``: whether its host's delay has passed at ``now``; unknown hosts are ready."""
    wait = F.col("last_visited") + F.make_dt_interval(secs=F.col("crawl_delay")) > now
    known = hosts.select("host", "crawl_delay", "last_visited")
    return frontier.join(known, "host", "left").withColumn("ready", ~F.coalesce(wait & (F.col("crawl_delay") > 0), F.lit(False))).drop("crawl_delay", "last_visited")


def passing_links(outlinks: DataFrame, hosts: DataFrame, now: Column) -> DataFrame:
    """``url, link``: the cleaned links of each page whose host's delay has passed at ``now``."""
    links = outlinks.select("url", F.explode(U.clean_links(F.col("links"))).alias("link"))
    marked = ready(links.withColumn("host", U.host(F.col("link"))), hosts, now)
    return marked.where("ready").select("url", "link")


def record(links: DataFrame, robots: DataFrame, frontier: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """``url`` of new entries for the frontier: allowed by the robots rules and not queued yet."""
    candidates = links.where("link is not null").select(F.col("link").alias("url")).distinct()
    good = check_robots(candidates, robots, visited).where("allowed").select("url")
    return good.join(frontier.select("url"), "url", "left_anti")


def crawl(pages: DataFrame, seeds: DataFrame, links_of: Callable[[DataFrame], DataFrame], allow: Callable[[DataFrame], DataFrame], max_rounds: int | None = None) -> DataFrame:
    """``url, round``: pages reached from ``seeds`` by breadth-first rounds over stored ``pages``.

    Each round fetches the frontier's stored pages, extracts their links, drops those visited and
    those ``allow`` rejects. It ends when nothing new turns up; if that takes more than
    ``max_rounds`` rounds, a ``RuntimeError`` says so. Rounds are written to the shared folder, so
    lineage stays short and a lost executor costs one round.
    """
    visited = cut(seeds.select("url").distinct().join(pages.select("url").distinct(), "url", "left_semi").withColumn("round", F.lit(0)))
    frontier = visited
    for i in count(1):
        found = links_of(pages.join(frontier.select("url"), "url", "left_semi")).select(F.col("link").alias("url")).distinct()
        new = allow(found.join(visited.select("url"), "url", "left_anti")).join(pages.select("url").distinct(), "url", "left_semi")
        frontier = cut(new.select("url").distinct().withColumn("round", F.lit(i)))
        if frontier.isEmpty():
            break
        if max_rounds is not None and i > max_rounds:
            raise RuntimeError(f"the crawl isn't done after {max_rounds} rounds")
        visited = cut(visited.unionByName(frontier))
    return visited


def live_workers(checkins: DataFrame, now: Column, timeout: float = 15.0) -> DataFrame:
    """``worker, last_checkin`` of workers heard of within ``timeout`` seconds (exactly ``timeout`` still counts)."""
    last = checkins.groupBy("worker").agg(F.max("ts").alias("last_checkin"))
    return last.where(F.unix_micros(now) - F.unix_micros("last_checkin") <= int(timeout * 1_000_000))
