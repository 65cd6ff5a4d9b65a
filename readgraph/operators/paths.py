"""Walks along single links, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import counted
from .graph import Graph, degrees


def follow(links: DataFrame) -> DataFrame:
    """``node, last, hops``: where the links from a node end, and after how many.

    ``links`` (node, next) has one row a node at most. A node without a link is its own end after 0 hops.
    Each round doubles the steps, so the longest walk takes its logarithm in rounds. Nodes that run into a
    cycle have no end and no row.
    """
    at = links.select("node", F.col("next").alias("last"), F.lit(1).cast("long").alias("hops"))
    ends = links.select(F.col("next").alias("node")).join(links.select("node"), "node", "left_anti").distinct()
    state, before = counted(at.withColumn("done", F.lit(False)).unionByName(ends.select("node", F.col("node").alias("last"), F.lit(0).cast("long").alias("hops"), F.lit(True).alias("done"))), "walk", F.count_if("done"))
    while True:
        ahead = state.select(F.col("node").alias("last"), F.col("last").alias("next_last"), F.col("hops").alias("next_hops"), F.col("done").alias("next_done"))
        going = state.filter("NOT done").join(ahead, "last").select("node", F.col("next_last").alias("last"), (F.col("hops") + F.col("next_hops")).alias("hops"), F.col("next_done").alias("done"))
        state, now = counted(state.filter("done").unionByName(going), "walk", F.count_if("done"))
        if now == before:  # nodes at every distance end earlier than those farther off, so only cycles are left
            return state.filter("done").select("node", "last", "hops")
        before = now


def simple_links(graph: Graph, cut_branches: bool = False) -> DataFrame:
    """``node, next``: the only edge out of a node and the only one into the next.

    With ``cut_branches`` the next node mustn't have several edges out.
    """
    degree = degrees(graph)
    source = degree.filter("out_degree = 1").select(F.col("node_id").alias("src"))
    target = degree.filter("in_degree = 1" + " AND out_degree <= 1" * cut_branches).select(F.col("node_id").alias("dst"))
    return graph.edges.join(source, "src", "left_semi").join(target, "dst", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("next"))


def tip_lengths(graph: Graph, max_walk: int) -> DataFrame:
    """``node_id, length`` of nodes without edges in: moves along single edges until a node with several in, or ``max_walk``."""
    degree = degrees(graph)
    starts = degree.filter("present AND in_degree = 0").select("node_id")
    walks = follow(simple_links(graph)).select(F.col("node").alias("node_id"), "last", "hops")
    ended = starts.join(walks, "node_id", "left").select("node_id", F.coalesce("last", "node_id").alias("last"), F.coalesce("hops", F.lit(0)).alias("hops"))
    more = degree.filter("out_degree = 1").select(F.col("node_id").alias("last"), F.lit(1).alias("more"))
    # one more move leads from the last node into one with several edges in
    return ended.join(more, "last", "left").select("node_id", F.least(F.lit(max_walk).cast("long"), F.col("hops") + F.coalesce("more", F.lit(0))).alias("length"))


def internal_chains(graph: Graph, max_ext: int) -> DataFrame:
    """``node_id`` of the nodes of chains between two branching nodes, of at most ``max_ext`` nodes."""
    degree = degrees(graph).filter("present")
    simple = degree.filter("in_degree = 1 AND out_degree = 1").select("node_id")
    branching = degree.filter("out_degree >= 2").select("node_id")
    edges = graph.edges.select("src", "dst")
    walks = follow(edges.join(simple.select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("next")))
    # a chain's nodes end at the same node; the first of them comes from a branching node
    ended = walks.filter("hops > 0").join(branching.select(F.col("node_id").alias("last")), "last", "left_semi")
    first = edges.join(branching.select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))
    heads = ended.join(first, "node", "left_semi").filter(F.col("hops") <= max_ext)
    # several chains may end at one node; a node belongs to the chain whose nodes lead back to its head
    back = follow(edges.join(simple.select(F.col("node_id").alias("src")), "src", "left_semi").join(simple.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("next")))
    chain = simple.join(back.select(F.col("node").alias("node_id"), F.col("last").alias("head")), "node_id", "left").select("node_id", F.coalesce("head", "node_id").alias("head"))
    return chain.join(heads.select(F.col("node").alias("head")), "head", "left_semi").select("node_id")


def cut_internal(graph: Graph, max_ext: int) -> Graph:
    """Removes the reads of internal chains on both strands, then edges to nodes that aren't there."""
    from .graph import drop_nodes, live_edges

    cut = drop_nodes(graph, internal_chains(graph, max_ext), purge=False)
    return cut._replace(edges=live_edges(cut))
