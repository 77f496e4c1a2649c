"""Connected components by alternating large-star / small-star.

The edge set itself is rewritten until it is a forest of stars whose centres
are the smallest node of each component.  *Large-star* re-points every larger
neighbour of a node to the smallest node it can see, *small-star* re-points a
node and its smaller neighbours to the smallest of them.  Both keep the
connectivity and never add edges, and the pair converges in O(log² n) rounds
(about log n in practice), whatever the order of the ids along a path.  There is no cap on
rounds: the loop ends at the fixpoint, recognised by an order-free signature
(row count and xor of row hashes) of the written edge table.

Minima are partial aggregates, so a hub never gathers its neighbourhood in
one task, and the join back on a hub is one that adaptive execution can
split.  Each round is one written table in the shared checkpoint folder; its
predecessor is deleted once the successor exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusgraph.session import RoundKeeper


def arcs_of(edges: DataFrame) -> DataFrame:
    """Both directions of every non-loop edge, as ``a -> b``."""
    e = edges.where(F.col("src") != F.col("dst"))
    return (e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
            .unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b")))
            .distinct())


def _large_star(e: DataFrame) -> DataFrame:
    """``e(hi, lo)``: every neighbour larger than a node moves to the
    smallest node of that neighbourhood."""
    arcs = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    low = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (arcs.where(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """``e(hi, lo)``: a node and its smaller neighbours move to the smallest
    of them."""
    low = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = (e.join(low, "hi").where(F.col("lo") != F.col("m"))
             .select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
    return moved.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()


def star_forest(edges: DataFrame) -> DataFrame:
    """``(hi, lo)``: every node of a non-loop edge, except the smallest of its
    component, with that smallest node.  Null endpoints are dropped."""
    keeper = RoundKeeper(("hi", "lo"))
    state, seen = keeper.keep_signed(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct())
    while seen[0]:
        state, now = keeper.keep_signed(_small_star(_large_star(state)))
        if now == seen:
            break
        seen = now
    return state


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``membership(node, community)``; community = smallest node id.  Nodes
    without an edge are their own community; edge endpoints absent from
    ``nodes`` still connect their neighbours but get no row."""
    stars = star_forest(edges).select(F.col("hi").alias("node"), F.col("lo").alias("community"))
    return (nodes.select("node").distinct().join(stars, "node", "left")
            .select("node", F.coalesce("community", "node").alias("community")))
