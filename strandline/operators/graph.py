"""The link graph: adjacency, repair of dangling pages, PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.skew import salted, salted_lookup
from strandline.session import cut


def edges_of(links: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` pairs without nulls."""
    return links.where("src is not null and dst is not null").select("src", "dst").distinct()


def adjacency(edges: DataFrame, block: int = 10_000) -> DataFrame:
    """``src, block, neighbors``: the sorted targets of each source, a hub's in several blocks of about ``block`` targets."""
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_rows"))
    blocks = degree.withColumn("_blocks", F.ceil(F.col("n_rows") / block).cast("int"))
    placed = salted_lookup(edges, blocks, "src", ["dst"])
    return placed.groupBy("src", F.pmod(F.xxhash64("dst"), F.col("_blocks")).cast("int").alias("block")).agg(F.array_sort(F.collect_set("dst")).alias("neighbors"))


def dangling(edges: DataFrame) -> DataFrame:
    """``dst, n_rows``: targets without links of their own and how many sources link to them."""
    return edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n_rows")).join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti")


def repair(edges: DataFrame) -> DataFrame:
    """``edges`` plus, for each dangling target, a link to itself and links back to all its referrers."""
    loose = dangling(edges)
    back = salted_lookup(edges, loose, "dst", ["src"]).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    itself = loose.select(F.col("dst").alias("src"), "dst")
    return edges.unionByName(back).unionByName(itself).distinct()


def start_ranks(edges: DataFrame, rank: float = 100.0) -> DataFrame:
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return ids.withColumn("rank", F.lit(rank))


class Links:
    """The parts of a graph that stay the same in every round, written once to the shared folder."""

    def __init__(self, edges: DataFrame):
        self.edges = cut(edges)
        degree = cut(self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_rows")))
        placed, sources = salted(self.edges, degree, "src", ["dst"])
        self.placed, self.sources = placed, sources

    def contributions(self, ranks: DataFrame) -> DataFrame:
        """``src, dst, contrib``: each source's rank divided among its links; a hub's links are salted."""
        facts = self.sources.join(ranks.withColumnRenamed("id", "src"), "src").select("src", "_salt", (F.col("rank") / F.col("n_rows")).alias("contrib"))
        return self.placed.join(facts, ["src", "_salt"]).select("src", "dst", "contrib")


def contributions(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    return Links(edges).contributions(ranks)


#: Ranks are summed in whole grains, so a sum doesn't depend on the order in which tasks deliver its parts.
GRAIN = 1e-9


def pagerank_step(links: Links, ranks: DataFrame, d: float = 0.85, damping_power: int = 1, teleport_all: bool = False) -> DataFrame:
    """``id, rank, moved`` after one iteration, ``(1 - d) + d**damping_power * sum`` over in-links; ``moved`` is the change.

    A vertex without in-links keeps its rank, or gets ``1 - d`` with ``teleport_all``. Contributions are
    rounded to ``GRAIN`` and summed as integers: a lost executor's work done again gives the same ranks. A
    sum above 9.2e9 raises an overflow error.
    """
    grains = F.floor(F.col("contrib") / F.lit(GRAIN) + 0.5).cast("long")
    sums = links.contributions(ranks.select("id", "rank")).groupBy(F.col("dst").alias("id")).agg((F.sum(grains) * F.lit(GRAIN)).alias("s"))
    new = F.lit(1 - d) + F.lit(d**damping_power) * F.col("s")
    stepped = ranks.select("id", F.col("rank").alias("_old")).join(sums, "id", "left").select("id", F.coalesce(new, F.lit(1 - d) if teleport_all else F.col("_old")).alias("rank"), "_old")
    return stepped.select("id", "rank", F.abs(F.col("rank") - F.col("_old")).alias("moved"))


def pagerank(edges: DataFrame, *, iterations: int = 15, d: float = 0.85, damping_power: int = 1, init_rank: float = 100.0, teleport_all: bool = False, tolerance: float | None = None) -> DataFrame:
    """``id, rank`` after ``iterations`` over distinct ``src, dst``, or fewer once no rank moves by more than ``tolerance``.

    A round's ranks go to the shared folder, as the next one uses them twice.
    """
    links = Links(edges)
    ranks = start_ranks(links.edges, init_rank)
    for i in range(iterations):
        last = i == iterations - 1 and tolerance is None
        stepped = pagerank_step(links, ranks, d, damping_power, teleport_all)
        ranks = stepped if last else cut(stepped)
        if tolerance is not None and (ranks.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
    return ranks.select("id", "rank")


def lookup(ranks: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """``id, rank_text`` with two decimals, of a few ids or a table of them (``id``); unknown ids and null ranks give no row."""
    asked = ranks.where(F.col("id").isin(ids)) if isinstance(ids, list) else ranks.join(ids.select("id"), "id", "left_semi")
    return asked.where("rank is not null").select("id", F.format_string("%.2f", "rank").alias("rank_text"))
