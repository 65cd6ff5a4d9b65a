"""From alignments to overlaps: clipping, classification, and removal of contained and thin reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..config import FilterConfig
from ..functions.sequences import opposite, percent_identity
from ..plans.lineage import mark, materialize, trim
from .filtering import coverage, passing

PROPER, INTERNAL, FIRST, SECOND, FILTERED = "proper", "internal", "first_contained", "second_contained", "filtered"


def _side(stats: DataFrame, name: str, k: int) -> DataFrame:
    """The covered region of the reads, to be joined as ``name``."""
    return stats.select(F.col("read_name").alias(name), F.col("coverage_start").alias(f"cs{k}"), F.col("coverage_end").alias(f"ce{k}"))


def clipped(best: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds b1, e1, l1, b2, e2, l2: spans within the reads' covered regions, the target's on the query's strand.

    Positions stay those of the whole read while lengths are the regions'.
    """
    joined = best.join(_side(stats, "query_name", 1), "query_name").join(_side(stats, "target_name", 2), "target_name")
    return joined.select(*best.columns, *_spans())


def _spans() -> list[Column]:
    """b1 to l2, from the regions cs1, ce1 of the query and cs2, ce2 of the target."""
    start, end, length = F.greatest("target_start", "cs2"), F.least("target_end", "ce2"), F.col("ce2") - F.col("cs2")
    forward = F.col("strand") == "+"
    return [
        F.greatest("query_start", "cs1").alias("b1"), F.least("query_end", "ce1").alias("e1"), (F.col("ce1") - F.col("cs1")).alias("l1"),
        F.when(forward, start).otherwise(length - end).alias("b2"), F.when(forward, end).otherwise(length - start).alias("e2"), length.alias("l2"),
    ]


def classify(best: DataFrame, stats: DataFrame, config: FilterConfig) -> DataFrame:
    """Adds ``cls`` to the clipped alignments; the tests hold in this order."""
    return clipped(best, stats).withColumn("cls", _class(config))


def _class(config: FilterConfig) -> Column:
    b1, e1, l1, b2, e2, l2 = (F.col(c) for c in ("b1", "e1", "l1", "b2", "e2", "l2"))
    overhang = F.least(b1, b2) + F.least(l1 - e1, l2 - e2)
    ratio = F.lit(config.overhang_ratio).cast("float").cast("double")
    most = F.ceil(F.greatest(e1 - b1, e2 - b2) * ratio)
    least = config.min_overlap_length
    return (
        F.when(overhang > most, INTERNAL)
        .when((b1 <= b2) & (l1 - e1 <= l2 - e2), FIRST)
        .when((b1 >= b2) & (l1 - e1 >= l2 - e2), SECOND)
        .when((e1 - b1 + overhang < least) | (e2 - b2 + overhang < least), FILTERED)
        .otherwise(PROPER)
    )


def contained_reads(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("cls").isin(FIRST, SECOND)).select(F.when(F.col("cls") == FIRST, F.col("query_name")).otherwise(F.col("target_name")).alias("read_name")).distinct()


def low_coverage_reads(stats: DataFrame, min_overlap_count: int) -> DataFrame:
    return stats.filter(F.col("max_depth") < min_overlap_count).select("read_name")


def proper_overlaps(classified: DataFrame) -> DataFrame:
    """The overlaps that proper alignments make, each with its twin on the other strands."""
    b1, e1, l1, b2, e2, l2 = (F.col(c) for c in ("b1", "e1", "l1", "b2", "e2", "l2"))
    q, t = F.col("query_name"), F.col("target_name")
    query_first = b1 > b2
    plus, minus = F.concat(q, F.lit("+")), F.concat(q, F.lit("-"))
    own, other = F.concat(t, F.col("strand")), F.concat(t, opposite(F.col("strand")))
    return classified.filter(F.col("cls") == PROPER).select(
        "query_name", "target_name",
        F.when(query_first, plus).otherwise(own).alias("source_name"), F.when(query_first, other).otherwise(minus).alias("rc_sink_name"),
        F.when(query_first, own).otherwise(plus).alias("sink_name"), F.when(query_first, minus).otherwise(other).alias("rc_source_name"),
        F.when(query_first, b1 - b2).otherwise(b2 - b1).alias("edge_len"),
        F.when(query_first, (l2 - e2) - (l1 - e1)).otherwise((l1 - e1) - (l2 - e2)).alias("rc_edge_len"),
        F.greatest(e1 - b1, e2 - b2, F.lit(0)).alias("overlap_len"), "identity",
    )


def without_reads(overlaps: DataFrame, reads: DataFrame, *sides: str) -> DataFrame:
    """Overlaps of which neither read is among ``reads``; or not the read on one of the sides."""
    columns = overlaps.columns
    for side in sides or ("query_name", "target_name"):
        overlaps = overlaps.join(reads.select(F.col("read_name").alias(side)), side, "left_anti")
    return overlaps.select(*columns)


def unique_reads(overlaps: DataFrame) -> DataFrame:
    return overlaps.select(F.explode(F.array("query_name", "target_name")).alias("read_name")).distinct()


#: What is carried along of an alignment to classify it.
CARRIED = ["line_no", "query_start", "query_end", "strand", "target_start", "target_end", "num_matching", "alignment_block_length"]


def classified_alignments(alignments: DataFrame, config: FilterConfig, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """Classified best alignments (``line_no, query_name, target_name, strand, identity, b1`` to ``l2, cls``), and the reads' coverage.

    Both branches start from the alignments that pass; these are written once, since their source may be text or a
    join, with what is used of them; not if they are ``stored`` as columns, where reading them twice costs less. Pairs of reads are dealt out by the read whose name comes first, so the best of a pair is
    found, and that read's region joined, after one shuffle; the other read's region takes a second one, which starts from a
    table so that the disk never holds both.
    """
    spark = alignments.sparkSession
    since = mark(spark)
    passed = passing(alignments, config).select("query_name", "query_length", "target_name", "target_length", *CARRIED)
    passed = passed if stored else materialize(passed, "passing")
    found = coverage(passed, config.min_overlap_count).select("read_name", "coverage_start", "coverage_end", "max_depth")
    regions = materialize(found, "coverage")
    forward = F.col("query_name") <= F.col("target_name")
    pairs = passed.select(F.least("query_name", "target_name").alias("low"), F.greatest("query_name", "target_name").alias("high"), forward.alias("forward"), *CARRIED).repartition("low")
    order = Window.partitionBy("low", "high").orderBy(F.desc("alignment_block_length"), "line_no")
    best = pairs.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")
    identity = percent_identity(F.col("num_matching"), F.col("alignment_block_length")).alias("identity")
    best = best.join(_side(regions, "low", 1), "low").select("low", "high", "forward", *CARRIED[:-2], identity, "cs1", "ce1")
    best = materialize(best, "best-alignments")
    trim(spark, since, 2)  # those that pass are done with
    either = lambda a, b: F.when(F.col("forward"), F.col(a)).otherwise(F.col(b))
    both = best.join(_side(regions, "high", 2), "high").select(
        either("low", "high").alias("query_name"), either("high", "low").alias("target_name"), *CARRIED[:-2], "identity",
        either("cs1", "cs2").alias("cs1"), either("ce1", "ce2").alias("ce1"), either("cs2", "cs1").alias("cs2"), either("ce2", "ce1").alias("ce2"),
    )
    classified = both.select("line_no", "query_name", "target_name", "strand", "identity", *_spans()).withColumn("cls", _class(config))
    return classified, regions


def find_overlaps(alignments: DataFrame, config: FilterConfig, stored: bool = False) -> DataFrame:
    """Overlaps between reads that are neither contained nor thinly covered, one of two reads at most."""
    spark = alignments.sparkSession
    since = mark(spark)
    classified, regions = classified_alignments(alignments, config, stored)
    classified = materialize(classified.drop("line_no"), "classified")
    out = materialize(contained_reads(classified).union(low_coverage_reads(regions, config.min_overlap_count)).distinct(), "reads-out")
    trim(spark, since, 2)
    # the rows are narrow until both reads have been looked at, and the disk never holds the shuffles of both
    left = materialize(without_reads(classified.filter(F.col("cls") == PROPER), out, "query_name"), "overlaps-left")
    return proper_overlaps(without_reads(left, out, "target_name"))
