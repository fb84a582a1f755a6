"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import forget, saved

#: A node is a hub if it has more than HUB edges and more than one in HUB_SHARE of all edges, so there are at most
#: 2 * HUB_SHARE hubs whatever the table is: their rows are met by a broadcast of that bounded size.
HUB, HUB_SHARE = 200, 20_000


def _met(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """Rows (u, ...) of n with the m of their u in least (u, m, n). The rows of a hub stay where they are and get its m by
    broadcast, so that no task gathers a hub's rows."""
    if n <= HUB:  # no node can be a hub
        return rows.join(least.select("u", "m"), "u")
    many = F.col("n") > max(HUB, n // HUB_SHARE)
    hubs, others = F.broadcast(least.where(many).select("u", "m")), least.where(~many).select("u", "m")
    return rows.join(hubs, "u").unionByName(rows.join(hubs, "u", "left_anti").join(others, "u"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node that it sees."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return _met(both.where("v > u"), least, n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these. Edges run from larger u to smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _met(edges, least, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Of edges (u, v): one row (node, root) for each node that has an edge, root being its component's smallest node.

    Self loops, repeated edges and either direction are allowed; an empty table gives an empty one. Rounds end when
    the edge set no longer changes: every component is then a star. Each round is a written table, so a lost executor
    costs one round at most; nothing but two sums reaches the driver.
    """
    edges = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == now or now.n == 0:
            break
        before = now
        for star in (_large_star, _small_star):
            then = saved(star(edges, now.n), "edges")
            forget(edges)
            edges = then
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return leaves.union(tops)
