"""Transitive edge reduction."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import counted, mark, materialize, trim
from .graph import EDGE, Graph, twins
from .numbering import dense_ids

#: Targets of a source that is decided from lists; of one with more, or with a target that has more, triangles are rows.
WIDE = 500


def numbered_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, id`` with ids in the order of names, and ``src, dst, len`` of the edges in ids: the shortest of each two ends, no loops."""
    names = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    ids = materialize(dense_ids(names, ["node"], "id"), "node-ids")
    of = lambda c: ids.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    plain = edges.filter("src <> dst").groupBy("src", "dst").agg(F.min("edge_len").alias("len"))
    return ids, materialize(plain.join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "len"), "edges-by-id")


def triangles(edges: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """``n1, n2, n3, len12, len23, len13, longest1, shortest2``: n1 -> n2 -> n3 and n1 -> n3, from edges by number (src, dst, len).

    The three nodes are found from the one with the fewest neighbours: it makes a pair of each two of those of its neighbours
    that have more. No node has more of these than the square root of twice the number of edges, so a hub, whose
    neighbours mostly have fewer, makes few pairs. Directions are looked at when the third edge is found. Of edges that are a
    part of a graph only, ``bounds`` has the whole graph's (node, longest, shortest).
    """
    both = edges.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), F.when(F.col("src") < F.col("dst"), F.col("len")).alias("up"), F.when(F.col("src") > F.col("dst"), F.col("len")).alias("down"))
    both = both.groupBy("x", "y").agg(F.min("up").alias("up"), F.min("down").alias("down"))
    n_near = both.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.max("len").alias("longest"), F.min("len").alias("shortest")) if bounds is None else bounds
    node = materialize(n_near.join(out, "node", "left"), "node-degrees")
    of = lambda c: node.select(F.col("node").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("n", "longest", "shortest")])
    pairs = materialize(both.join(of("x"), "x").join(of("y"), "y"), "node-pairs")
    x_first = F.struct("n_x", "x") < F.struct("n_y", "y")
    of_lo = lambda a, b: F.when(x_first, F.col(a)).otherwise(F.col(b))
    low = pairs.select(of_lo("x", "y").alias("v"), of_lo("y", "x").alias("w"), of_lo("up", "down").alias("to"), of_lo("down", "up").alias("back"), of_lo("longest_x", "longest_y").alias("longest_v"), of_lo("shortest_x", "shortest_y").alias("shortest_v"))
    one = low.select("v", F.col("w").alias("x"), F.col("to").alias("vx"), F.col("back").alias("xv"), "longest_v", "shortest_v")
    two = low.select("v", F.col("w").alias("y"), F.col("to").alias("vy"), F.col("back").alias("yv"))
    closed = one.join(two, "v").filter("x < y").join(pairs.select("x", "y", F.col("up").alias("xy"), F.col("down").alias("yx"), "longest_x", "shortest_x", "longest_y", "shortest_y"), ["x", "y"])
    case = lambda a, b, c: F.struct(F.col(a).alias("n1"), F.col(b).alias("n2"), F.col(c).alias("n3"), F.col(a + b).alias("len12"), F.col(b + c).alias("len23"), F.col(a + c).alias("len13"), F.col(f"longest_{a}").alias("longest1"), F.col(f"shortest_{b}").alias("shortest2"))
    cases = F.array(*[case(*order) for order in ("vxy", "vyx", "xvy", "xyv", "yvx", "yxv")])
    return closed.select(F.inline(cases)).filter("len12 IS NOT NULL AND len23 IS NOT NULL AND len13 IS NOT NULL")


def _struck_in_rounds(edges: DataFrame, bounds: DataFrame, fuzz: int) -> DataFrame:
    """``a, b``: the superfluous edges among ``edges`` (src, dst, len), decided in rounds of joins over their triangles.

    Only the rule of the fuzz and the longest edge depends on the order: a target is
    struck out once a nearer one that reaches it stands, and stands once all of them are struck out. So a source's triangles
    are never held together.
    """
    reach = (F.col("len12") + F.col("len23")) <= F.col("longest1") + fuzz
    close = (F.col("len23") < fuzz) | (F.col("len23") == F.col("shortest2"))
    nearer = F.struct("len12", "n2") < F.struct("len13", "n3")
    marked = triangles(edges, bounds).select("n1", "n2", "n3", reach.alias("far"), close.alias("near"), nearer.alias("nearer")).filter("far OR near")
    marked = materialize(marked, "transitive")
    far = marked.filter("far").select("n1", "n2", "n3")
    open_, left = counted(marked.filter("far AND nearer").select("n1", "n2", "n3"), "transitive-open")
    ends = lambda df: df.select("n1", F.col("n3").alias("n2")).distinct()
    new = materialize(far.select("n1", "n2").distinct().join(ends(open_), ["n1", "n2"], "left_anti"), "transitive-stand")
    standing = new
    while left:
        struck = materialize(ends(open_.join(new, ["n1", "n2"], "left_semi")), "transitive-struck")
        rest = open_.join(struck, ["n1", "n2"], "left_anti").join(struck.withColumnRenamed("n2", "n3"), ["n1", "n3"], "left_anti")
        rest, left = counted(rest.select("n1", "n2", "n3"), "transitive-open")
        new = materialize(ends(open_).join(struck, ["n1", "n2"], "left_anti").join(ends(rest), ["n1", "n2"], "left_anti"), "transitive-stand")
        standing, open_ = standing.union(new), rest
    by_far = far.join(standing, ["n1", "n2"], "left_semi").select(F.col("n1").alias("a"), F.col("n3").alias("b"))
    return materialize(by_far.union(marked.filter("near").select(F.col("n1").alias("a"), F.col("n3").alias("b"))).distinct(), "transitive-found")


def _decided(lists: DataFrame, fuzz: int) -> DataFrame:
    """``a, struck, left``: of each source its superfluous targets and the others, from lists of targets (node, near, lens, targets, longest).

    Lists are in the order of length and target. A source gets of each target's list the part that it may strike out: as the
    list is in order, this is its beginning, up to a length that the source's longest edge gives, or up to ``near``.
    """
    edges = lists.select(F.col("node").alias("a"), "longest", F.inline(F.arrays_zip(F.col("targets").alias("mid"), F.col("lens").alias("len"))))
    of_mid = lists.select(F.col("node").alias("mid"), "near", "lens", "targets")
    far = F.size(F.filter("lens", lambda n: n <= F.col("longest") + fuzz - F.col("len")))
    joined = edges.join(of_mid, "mid", "left").select("a", "len", "mid", F.coalesce(far, F.lit(0)).alias("far"), F.coalesce("near", F.lit(0)).alias("near"), "targets")
    none = F.array().cast("array<bigint>")
    reached = F.coalesce(F.slice("targets", 1, F.greatest("far", "near")), none)
    sent = joined.select("a", "len", "mid", F.when(F.col("targets").isNull(), 0).otherwise(F.col("far")).alias("far"), "near", reached.alias("to")).repartition("a")
    own = sent.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("len", "mid", "far", "near", "to"))).alias("by_length"))
    strike = lambda gone, m: F.when(F.array_contains(gone, m["mid"]), gone).otherwise(F.array_union(gone, F.slice(m["to"], 1, m["far"])))
    gone = F.aggregate("by_length", none, strike)
    near = F.flatten(F.transform("by_length", lambda m: F.slice(m["to"], 1, m["near"])))
    targets = F.transform("by_length", lambda m: m["mid"])
    return own.select("a", targets.alias("targets"), F.array_union(gone, near).alias("hit")).select("a", F.array_intersect("targets", "hit").alias("struck"), F.array_except("targets", "hit").alias("left"))


class Judged(NamedTuple):
    ids: DataFrame  # node, id
    struck: DataFrame  # a, b: superfluous edges, by number
    left: DataFrame  # a, b: the others


def judged(edges: DataFrame, fuzz: int, wide: int = WIDE) -> Judged:
    """The edges' ends, superfluous ones and others, by number; without loops.

    For each source, its targets count from near to far. A target that still stands strikes out
    those that it leads to within the source's longest edge and the fuzz. Any target strikes out those that
    it leads to within the fuzz, or by its shortest edge. A source of at most ``wide`` targets, of which each has at most as many,
    is decided as such (``_decided``), so no row holds more than that many lists of that many numbers. Others are decided
    in rounds of joins over the part of the graph that they and their targets make, in which no source is held together.
    """
    spark = edges.sparkSession
    since = mark(spark)
    ids, plain = numbered_edges(edges)
    trim(spark, since, 2)
    out = plain.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("longest"), F.min("len").alias("shortest"))
    bounds, n_wide = counted(out, "out-degrees", F.count_if(F.col("n") > wide))
    narrow, large = plain, None
    if n_wide:
        many = bounds.filter(F.col("n") > wide).select("node")
        to_many = plain.join(many.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
        large = materialize(many.union(to_many).distinct(), "wide-sources")
        narrow = plain.join(many.withColumnRenamed("node", "src"), "src", "left_anti")
    listed = narrow.repartition("src").groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.struct("len", "dst"))).alias("out"))
    lists = listed.select("node", F.col("out.len").alias("lens"), F.col("out.dst").alias("targets"))
    last = F.greatest(F.element_at("lens", 1), F.lit(fuzz - 1))
    lists = lists.select("node", "lens", "targets", F.element_at("lens", -1).alias("longest"), F.size(F.filter("lens", lambda n: n <= last)).alias("near"))
    lists = materialize(lists, "targets")
    decided = _decided(lists, fuzz)
    if large is not None:
        decided = decided.join(large.withColumnRenamed("node", "a"), "a", "left_anti")
    decided = materialize(decided, "decided")
    struck, left = (decided.select("a", F.explode(c).alias("b")) for c in ("struck", "left"))
    if large is None:
        trim(spark, since + 1, 1)  # numbers of nodes, and what is decided
        return Judged(ids, struck, left)
    about = large.union(plain.join(large.withColumnRenamed("node", "src"), "src", "left_semi").select("dst")).distinct()
    about = materialize(about, "wide-nodes")
    part = plain.join(about.withColumnRenamed("node", "src"), "src", "left_semi").join(about.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "len")
    found = _struck_in_rounds(materialize(part, "wide-edges"), bounds.select("node", "longest", "shortest"), fuzz)
    found = found.join(large.withColumnRenamed("node", "a"), "a", "left_semi")
    rest = plain.join(large.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b")).join(found, ["a", "b"], "left_anti")
    return Judged(ids, struck.union(found), left.union(rest))


def _named(ids: DataFrame, ends: DataFrame) -> DataFrame:
    """``src, dst`` of ends by number; the wider rows of names take no second shuffle."""
    name = lambda c, n: ids.select(F.col("id").alias(c), F.col("node").alias(n))
    return ends.join(name("a", "src"), "a").join(name("b", "dst"), "b").select("src", "dst")


def transitive_edges(edges: DataFrame, fuzz: int, wide: int = WIDE) -> DataFrame:
    """``src, dst`` of edges that the edges over a third node make superfluous (``judged``)."""
    found = judged(edges, fuzz, wide)
    return _named(found.ids, found.struck)


def reduce_transitive(graph: Graph, fuzz: int, wide: int = WIDE) -> Graph:
    """Removes transitive edges and their twins.

    Most edges are transitive, so those that are left are looked up in the graph, and of their twins only those that aren't left too.
    """
    spark = graph.edges.sparkSession
    since = mark(spark)
    found = judged(graph.edges, fuzz, wide)
    left = materialize(_named(found.ids, found.left), "edges-left")
    alone, n_alone = counted(twins(left).join(left, ["src", "dst"], "left_anti"), "twins-not-left")
    if n_alone:  # a twin is struck, or there is none
        number = lambda c, n: found.ids.select(F.col("node").alias(n), F.col("id").alias(c))
        by_id = alone.join(number("a", "src"), "src").join(number("b", "dst"), "dst")
        struck = materialize(by_id.join(found.struck, ["a", "b"], "left_semi").select("src", "dst"), "twins-struck")
        left = left.join(twins(struck), ["src", "dst"], "left_anti")
    loops = graph.edges.filter("src = dst").select("src", "dst").distinct()
    left = materialize(left.union(loops), "ends-left")
    trim(spark, since, 1)
    return graph._replace(edges=graph.edges.join(left, ["src", "dst"], "left_semi").select(*EDGE))
