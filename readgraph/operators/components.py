"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import counted, materialize

#: Rows of a round for each task, so that small rounds don't make as many small files as a large one has partitions.
ROWS_A_TASK = 200_000


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` of every endpoint; a component's label is its smallest node.

    Direction doesn't matter; loops, repeated and reversed edges are harmless; rows with a null
    endpoint are dropped; no edges give no rows. In each round every node chooses the first of its neighbours
    and itself in the order of a hash that differs by round, and takes the choice of its choice as its representative;
    the graph is contracted to the representatives. Whatever the graph and the names of its nodes, a round leaves three
    quarters of the nodes or less on average (Bögeholz, Brand and Todor, 2018, who take the choice itself), so the rounds
    grow with their logarithm and their work with their number; it goes on until no edge is left, at every size. The
    representatives are then followed back from the last round to the first. Rounds are written to the shared folder, and
    their edges counted as they are written, which tells how many tasks the next round is worth; the joins are equi-joins on
    node ids, so the edges of a hub are split by Spark's skew join.
    """
    return contracted(edges, src, dst)[0]


def contracted(edges: DataFrame, src: str, dst: str) -> tuple[DataFrame, int]:
    """The components and the number of rounds."""
    plain = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    both, left = counted(plain.union(plain.select("v", "u")).distinct(), "cc-edges")
    rounds: list[DataFrame] = []
    while left or not rounds:
        order = lambda c, k=len(rounds): F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("r"))
        chosen = both.groupBy("u").agg(F.min(order("v")).alias("near")).select("u", F.least(order("u"), "near")["r"].alias("first"))
        further = chosen.select(F.col("u").alias("first"), F.col("first").alias("r"))
        tasks = -(-left // ROWS_A_TASK) or 1  # a round has no more rows than the edges before it
        rounds.append(chosen := materialize(chosen.join(further, "first").select("u", "r").coalesce(tasks), "cc-round"))
        half = both.join(chosen, "u").select(F.col("r").alias("ru"), F.col("v").alias("u"))
        whole = half.join(chosen, "u").filter("ru <> r").select(F.col("ru").alias("u"), F.col("r").alias("v"))
        both, left = counted(whole.distinct().coalesce(tasks), "cc-edges")
    found = rounds[-1]
    for before in reversed(rounds[:-1]):
        later = found.select(F.col("u").alias("r"), F.col("r").alias("further"))
        found = before.join(later, "r", "left").select("u", F.coalesce("further", "r").alias("r"))
    found = materialize(found, "cc-found")
    names = found.groupBy("r").agg(F.min("u").alias("component"))
    return materialize(found.join(names, "r").select(F.col("u").alias("node"), "component"), "cc-labels"), len(rounds)
