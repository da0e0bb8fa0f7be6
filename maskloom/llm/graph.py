"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import spread_join, staged


def with_least(edges: DataFrame, hub: int) -> DataFrame:
    """edges (u, v) with m, the least v of each u. hub: the most edges of a u; those of a large one are dealt over several tasks."""
    if hub <= common.HOT_IDS:
        return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    return spread_join(edges, least, "u", "n", "v")


def large_star(edges: DataFrame, hub: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return with_least(both, hub).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def small_star(edges: DataFrame, hub: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them. edges: u larger than v."""
    link = lambda u: F.struct(F.col(u).alias("u"), F.col("m").alias("v"))
    return with_least(edges, hub).select(F.inline(F.array(link("u"), link("v")))).filter("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """links: u, v (long). Returns u, v: each linked node but the least of its component, with that least node.

    Every round is written to the shared folder; only counts come to the driver. The rounds needed grow with
    the logarithm of the nodes; more than most_rounds raise an error and lose nothing silently.
    """
    edges = staged(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    ends = lambda c, o, i: F.struct(F.col(c).alias("x"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    for _ in range(most_rounds):
        # Stars: no node has two edges out, and none has edges both out and in.
        per_node = edges.select(F.inline(F.array(ends("u", 1, 0), ends("v", 0, 1)))).groupBy("x").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        out, through, hub = per_node.agg(F.max("o"), F.max(F.least("o", "i")), F.max(F.col("o") + F.col("i"))).first()
        if (out or 0) <= 1 and not through:
            return edges
        edges = staged(small_star(large_star(edges, hub), hub), "stars")
    raise RuntimeError(f"no stars after {most_rounds} rounds")
