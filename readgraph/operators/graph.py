"""The bidirected overlap graph as two tables, and operators that return a new one.

Nodes are oriented reads (name and strand), edges are ``src, dst, edge_len, overlap_len, identity``. Edges
belong to their source: a removed node takes its out-edges along, and in-edges only where an operator says so.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import rc_node
from ..plans.lineage import materialize, short_lived_shuffles

EDGE = ["src", "dst", "edge_len", "overlap_len", "identity"]


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def build_graph(overlaps: DataFrame, unique: bool = False) -> Graph:
    """Two edges an overlap; of edges with the same ends the first in order of length is kept.

    With ``unique`` two reads have one overlap at most, as ``find_overlaps`` gives them: then no two edges have the same ends,
    and none are compared.
    """
    edge = lambda s, d, n: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), F.col(n).alias("edge_len"), "overlap_len", "identity")
    both = F.explode(F.array(edge("source_name", "sink_name", "edge_len"), edge("rc_sink_name", "rc_source_name", "rc_edge_len"))).alias("e")
    edges = overlaps.select(both).select("e.*")
    return Graph(edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct(), edges if unique else first_edges(edges))


def first_edges(edges: DataFrame) -> DataFrame:
    """One edge for each source and target."""
    best = edges.groupBy("src", "dst").agg(F.min(F.struct("edge_len", F.negative("overlap_len").alias("o"), F.negative("identity").alias("i"))).alias("m"))
    return best.select("src", "dst", "m.edge_len", F.negative("m.o").alias("overlap_len"), F.negative("m.i").alias("identity"))


def saved(graph: Graph, name: str) -> Graph:
    return Graph(materialize(graph.nodes, f"{name}-nodes"), materialize(graph.edges, f"{name}-edges"))


def twins(edges: DataFrame) -> DataFrame:
    """The ends of the edges' twins."""
    return edges.select(rc_node(F.col("dst")).alias("src"), rc_node(F.col("src")).alias("dst"))


def symmetrize(graph: Graph) -> Graph:
    """Without edges whose twin is absent."""
    return graph._replace(edges=graph.edges.join(twins(graph.edges), ["src", "dst"], "left_semi"))


def sync_violations(graph: Graph) -> DataFrame:
    """``kind, id``: nodes without their other strand and edges without their twin; empty for a sound graph."""
    lone = graph.nodes.join(graph.nodes.select(rc_node(F.col("node_id")).alias("node_id")), "node_id", "left_anti").select(F.lit("node").alias("kind"), F.col("node_id").alias("id"))
    odd = graph.edges.join(twins(graph.edges), ["src", "dst"], "left_anti").select(F.lit("edge").alias("kind"), F.concat_ws(" ", "src", "dst").alias("id"))
    return lone.union(odd)


def check_synchronized(graph: Graph) -> None:
    with short_lived_shuffles(graph.edges.sparkSession):
        bad = sync_violations(graph).head()
    if bad:
        raise ValueError(f"the graph is not synchronized: {bad['kind']} {bad['id']}")


def degrees(graph: Graph) -> DataFrame:
    """``node_id, in_degree, out_degree, present`` of nodes, and of targets that are no nodes."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0).alias("p")), F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).alias("p")))).alias("x")).select("x.*")
    all_ = ends.unionByName(graph.nodes.select("node_id", F.lit(0).alias("i"), F.lit(0).alias("o"), F.lit(1).alias("p")))
    return all_.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), (F.max("p") == 1).alias("present"))


def degree_distribution(graph: Graph) -> DataFrame:
    """``direction, degree, n_nodes``."""
    both = F.explode(F.array(F.struct(F.lit("in").alias("direction"), F.col("in_degree").alias("degree")), F.struct(F.lit("out").alias("direction"), F.col("out_degree").alias("degree")))).alias("d")
    return degrees(graph).filter("present").select(both).groupBy("d.direction", "d.degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def compressible_stats(graph: Graph) -> DataFrame:
    """``compressible, total, fraction``: nodes with one edge in and one out; 0.0 of none."""
    simple = F.sum(((F.col("in_degree") == 1) & (F.col("out_degree") == 1)).cast("long"))
    counted = degrees(graph).filter("present").agg(F.coalesce(simple, F.lit(0)).alias("compressible"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("fraction", F.when(F.col("total") > 0, F.col("compressible") / F.col("total")).otherwise(0.0))


def branching_topk(graph: Graph, k: int) -> DataFrame:
    """The k nodes with most edges, of those with more than one in or out."""
    found = degrees(graph).filter("present AND (in_degree > 1 OR out_degree > 1)")
    return found.orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "node_id").limit(k).select("node_id", "in_degree", "out_degree")


def graph_summary(graph: Graph) -> DataFrame:
    nodes = graph.nodes.agg(F.count(F.lit(1)).alias("nodes"))
    edges = graph.edges.agg(F.count(F.lit(1)).alias("edges"))
    return nodes.join(edges, F.lit(True)).withColumn("ratio", F.when(F.col("edges") > 0, F.col("nodes") / F.col("edges")))


def live_edges(graph: Graph) -> DataFrame:
    """Edges whose target is a node."""
    return graph.edges.join(graph.nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(*EDGE)


def drop_edges(edges: DataFrame, ends: DataFrame) -> DataFrame:
    return edges.join(ends, ["src", "dst"], "left_anti").select(*EDGE)


def drop_nodes(graph: Graph, nodes: DataFrame, purge: bool = True) -> Graph:
    """Without ``nodes`` (node_id), their other strands and their out-edges; with ``purge`` without in-edges too."""
    gone = nodes.select(F.explode(F.array("node_id", rc_node(F.col("node_id")))).alias("node_id")).distinct()
    edges = graph.edges.join(gone.select(F.col("node_id").alias("src")), "src", "left_anti")
    if purge:
        edges = edges.join(gone.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    return Graph(graph.nodes.join(gone, "node_id", "left_anti"), edges.select(*EDGE))


def multi_edges(graph: Graph) -> DataFrame:
    """``src, dst, n``: ends that several edges share."""
    return graph.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def remove_multi_edges(graph: Graph) -> Graph:
    """Of edges with the same ends the largest overlap, then identity, is kept, and the other three edges between the two reads go; then the graph is symmetrized."""
    order = Window.partitionBy("src", "dst").orderBy(F.desc("overlap_len"), F.desc("identity"), "edge_len")
    best = graph.edges.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")
    rs, rd = rc_node(F.col("src")), rc_node(F.col("dst"))
    others = F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")), F.struct(rd.alias("src"), rs.alias("dst")), F.struct(rs.alias("src"), rd.alias("dst")))).alias("x")
    return symmetrize(graph._replace(edges=drop_edges(best, multi_edges(graph).select(others).select("x.*"))))


def _with_reverse(ends: DataFrame) -> DataFrame:
    return ends.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("x")).select("x.*").distinct()


def short_edges(graph: Graph, ratio: float) -> DataFrame:
    """``src, dst`` of edges with an overlap below the ratio of their source's largest (rounded), where there are several."""
    own = Window.partitionBy("src")
    least = F.floor(F.max("overlap_len").over(own) * F.lit(ratio) + 0.499)
    marked = graph.edges.select("src", "dst", "overlap_len", least.alias("least"), F.count(F.lit(1)).over(own).alias("n"))
    return marked.filter("n >= 2 AND overlap_len < least").select("src", "dst")


def remove_short_edges(graph: Graph, ratio: float) -> Graph:
    """Removes short edges and the edges from target to source, which aren't their twins: the graph may lose its symmetry."""
    return graph._replace(edges=drop_edges(graph.edges, _with_reverse(short_edges(graph, ratio))))


def weak_edges(graph: Graph) -> DataFrame:
    """``src, dst`` of all edges but their source's most alike one (the shortest of equals), where there are several.

    An edge without a number as its identity (NaN) is never the most alike; of several such none stays.
    """
    own = Window.partitionBy("src")
    sound = ~F.isnan("identity")
    rank = F.row_number().over(own.orderBy(F.desc(sound), F.desc("identity"), "edge_len", "dst"))
    ranked = graph.edges.select("src", "dst", ((rank == 1) & sound).alias("best"), F.count(F.lit(1)).over(own).alias("n"))
    return ranked.filter("n >= 2 AND NOT best").select("src", "dst")


def remove_weak_edges(graph: Graph) -> Graph:
    return graph._replace(edges=drop_edges(graph.edges, _with_reverse(weak_edges(graph))))


def singleton_nodes(graph: Graph) -> DataFrame:
    """``node_id`` of weak components of one node."""
    joined = graph.edges.filter("src <> dst").select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return graph.nodes.join(joined, "node_id", "left_anti")


def remove_singletons(graph: Graph) -> Graph:
    """Singletons and their other strands go; edges into those stay, as edges into nothing."""
    return drop_nodes(graph, singleton_nodes(graph), purge=False)


def cut_biloops(graph: Graph) -> Graph:
    """The graph as it is: the walk that would cut a loop starts at a branching node, where it ends at once."""
    return graph
