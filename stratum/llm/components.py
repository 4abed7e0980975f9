"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step finds the least neighbour of each node by an aggregation, with a map-side combine, and sends it to the node's edges by a join. Nodes with more
than one in HUBS of the edges, of which there are fewer than HUBS, are joined by broadcast (16 bytes each); all others by shuffle, so no task has more than
a small share of the edges because of one node. Where no node has more than HUB_EDGES edges, all are joined by shuffle. The rounds end when the edges are
stars, which is checked exactly. Each round is written to the scratch folder.

Defined results: edges of a node with itself and repeated edges do not matter; an empty table has no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

HUBS, HUB_EDGES = 4096, 50_000


def _with_least(edges: DataFrame, node: str, total: int, hubs: bool) -> tuple[DataFrame, DataFrame]:
    """The least neighbour m of each node, and the edges with it. total: at least the number of edges; hubs: whether a node may have many."""
    other = "b" if node == "a" else "a"
    least = edges.groupBy(node).agg(F.min(other).alias("m"), F.count(F.lit(1)).alias("degree"))
    if not hubs:
        return least, edges.join(least.select(node, "m"), node).select("a", "b", "m")
    hub = F.col("degree") * HUBS > total
    many = least.where(hub)
    of_hubs = edges.join(F.broadcast(many.select(node, "m")), node)
    rest = edges.join(F.broadcast(many.select(node)), node, "left_anti").join(least.where(~hub).select(node, "m"), node)
    return least, of_hubs.select("a", "b", "m").union(rest.select("a", "b", "m"))


def _large(edges: DataFrame, total: int, hubs: bool) -> DataFrame:
    """Each node hands all its greater neighbours to the least of itself and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    _, joined = _with_least(both, "a", 2 * total, hubs)
    return joined.where("b > a").select(F.least("m", "a").alias("a"), "b").distinct()


def _small(edges: DataFrame, total: int, hubs: bool) -> DataFrame:
    """edges: a < b. Each node b hands all its smaller neighbours to the least of them."""
    least, joined = _with_least(edges, "b", total, hubs)
    moved = joined.select(F.col("m").alias("x"), F.col("a").alias("y")).union(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
    return moved.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """The number of edges, the most of one node, and the number of nodes that keep the edges from being stars around their least nodes: they have a smaller
    neighbour and either another one or a greater one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("up")).union(edges.select(F.col("b").alias("node"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("smaller"), F.count(F.lit(1)).alias("degree"))
    state = nodes.agg(F.sum("smaller"), F.max("degree"), F.sum(F.when((F.col("smaller") > 0) & (F.col("degree") > 1), 1).otherwise(0))).first()
    return tuple(x or 0 for x in state)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root (the least node reachable) for every node with an edge. edges: columns a and b, of any order and number."""
    now = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}0")
    k = 0
    while True:
        total, most, unsettled = _state(now)
        if not unsettled:
            break
        k, hubs = k + 1, most > HUB_EDGES
        # A step leaves a node no more neighbours than it had, or hands it to its least one, so hubs are known from the round's start.
        now = scratch.save(_small(_large(now, total, hubs), total, hubs), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(now.select("a", "a").distinct())
