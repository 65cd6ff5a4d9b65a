"""Alignments: predicates, the best alignment of a pair, and coverage of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FilterConfig
from ..functions.sequences import percent_identity
from ..plans.lineage import materialize


def unsound() -> F.Column:
    """Why an alignment can't be used: a position beyond its read or a strand that is none; null if it can."""
    said = lambda what: F.concat(F.lit(f"{what}: "), F.concat_ws(" ", "query_name", "query_start", "query_end", "strand", "target_name", "target_start", "target_end"))
    within = lambda s: (F.col(f"{s}_start") >= 0) & (F.col(f"{s}_start") <= F.col(f"{s}_end")) & (F.col(f"{s}_end") <= F.col(f"{s}_length"))
    return F.when(~(within("query") & within("target")), said("positions beyond the read")).when(~F.col("strand").isin("+", "-"), said("a strand other than + and -"))


def rated(alignments: DataFrame, config: FilterConfig) -> DataFrame:
    """Adds ``identity`` and ``skip``: why an alignment is left out (self, length or identity), or null.

    One that isn't left out but can't be used (``unsound``) is an error.
    """
    identity = percent_identity(F.col("num_matching"), F.col("alignment_block_length"))
    span = F.least(F.col("query_end") - F.col("query_start"), F.col("target_end") - F.col("target_start"))
    least = F.lit(config.min_percent_identity).cast("float").cast("double")
    reason = F.when(F.col("query_name") == F.col("target_name"), "self").when(span < config.min_overlap_length, "length").when(~F.isnan("identity") & (F.col("identity") < least), "identity")
    fault = unsound()
    return alignments.withColumn("identity", identity).withColumn("skip", reason.when(fault.isNotNull(), F.raise_error(fault).cast("string")))


def passing(alignments: DataFrame, config: FilterConfig) -> DataFrame:
    """Alignments of two reads that are long and alike enough, with ``identity``."""
    return rated(alignments, config).filter("skip IS NULL").drop("skip")


def filter_counts(alignments: DataFrame, config: FilterConfig) -> DataFrame:
    """``outcome, n``: alignments kept or skipped, and why."""
    return rated(alignments, config).groupBy(F.coalesce("skip", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def best_alignments(passed: DataFrame) -> DataFrame:
    """The longest block of each unordered pair of reads; the first line wins ties."""
    pair = Window.partitionBy(F.least("query_name", "target_name"), F.greatest("query_name", "target_name")).orderBy(F.desc("alignment_block_length"), "line_no")
    return passed.withColumn("__rank", F.row_number().over(pair)).filter("__rank = 1").drop("__rank")


def _sides(passed: DataFrame, *columns) -> DataFrame:
    """Each alignment once for its query and once for its target, read once."""
    side = lambda s, k: F.struct(F.col(f"{s}_name").alias("read_name"), F.col(f"{s}_length").alias("length"), F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end"), F.lit(k).alias("side"))
    return passed.select(*columns, F.explode(F.array(side("query", 0), side("target", 1))).alias("r")).select(*columns, "r.*")


def depth_segments(passed: DataFrame) -> DataFrame:
    """``read_name, start, end, depth``: stretches of a read that as many alignments cover.

    Events are summed by position before they are put in order, so the rows of a read in one window are at
    most its covered positions.
    """
    moves = _sides(passed).select("read_name", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("m"))
    moves = moves.groupBy("read_name", "m.pos").agg(F.sum("m.d").alias("d"))
    order = Window.partitionBy("read_name").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return moves.select("read_name", F.col("pos").alias("start"), F.lead("pos").over(order).alias("end"), F.sum("d").over(upto).alias("depth")).filter("end IS NOT NULL")


def covered_regions(segments: DataFrame, min_overlap_count: int) -> DataFrame:
    """``read_name, coverage_start, coverage_end``: the longest stretch with a depth above the count, the first of equals."""
    order = Window.partitionBy("read_name").orderBy("start")
    deep = segments.filter(F.col("depth") > min_overlap_count)
    islands = deep.withColumn("new", (F.lag("end").over(order).isNull() | (F.lag("end").over(order) != F.col("start"))).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("read_name", "island").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    best = runs.groupBy("read_name").agg(F.min(F.struct((F.col("s") - F.col("e")).alias("l"), "s", "e")).alias("b"))
    return best.select("read_name", F.col("b.s").alias("coverage_start"), F.col("b.e").alias("coverage_end"))


def coverage(passed: DataFrame, min_overlap_count: int) -> DataFrame:
    """``read_name, coverage_start, coverage_end, max_depth, least_length, most_length`` of every read that an alignment names.

    As ``depth_segments`` and ``covered_regions``, but in one shuffle: a read's spans go to one task, where they are summed by
    position, so what is put in order is at most a read's covered positions. The rest follows this order: where a deep
    stretch begins is carried along to each of its segments, and the longest way from there is its length.
    """
    side = lambda s: F.struct(F.col(f"{s}_name").alias("read_name"), F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end"), F.col(f"{s}_length").alias("length"))
    spans = passed.select(F.inline(F.array(side("query"), side("target")))).repartition("read_name")
    moves = spans.select("read_name", "length", F.inline(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))))
    moves = moves.groupBy("read_name", "pos").agg(F.sum("d").alias("d"), F.min("length").alias("least"), F.max("length").alias("most"))
    order = Window.partitionBy("read_name").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    segments = moves.select("read_name", "pos", "least", "most", F.lead("pos").over(order).alias("end"), F.sum("d").over(upto).alias("depth"))
    deep = F.col("end").isNotNull() & (F.col("depth") > min_overlap_count)
    marked = segments.withColumn("deep", deep).withColumn("begins", F.col("deep") & ~F.coalesce(F.lag("deep").over(order), F.lit(False)))
    begun = marked.withColumn("begin", F.last(F.when(F.col("begins"), F.col("pos")), ignorenulls=True).over(upto))
    # of equal lengths the first
    longest = F.max(F.when(F.col("deep"), F.struct((F.col("end") - F.col("begin")).alias("n"), F.negative("begin").alias("b"))))
    found = begun.groupBy("read_name").agg(longest.alias("l"), F.max(F.when(F.col("end").isNotNull(), F.col("depth"))).alias("max_depth"), F.min("least").alias("least_length"), F.max("most").alias("most_length"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    begin = F.negative("l.b")
    return found.select("read_name", zero(begin).alias("coverage_start"), zero(begin + F.col("l.n")).alias("coverage_end"), zero(F.col("max_depth")).alias("max_depth"), "least_length", "most_length")


def read_stats(passed: DataFrame, min_overlap_count: int) -> DataFrame:
    """``read_name, length, coverage_start, coverage_end, max_depth`` of every read that an alignment names.

    The length is that of the first line, query before target; a read without a deep stretch has (0, 0). The lines are looked
    at for reads only that have several lengths.
    """
    found = materialize(coverage(passed, min_overlap_count), "coverage")
    several = found.filter("least_length <> most_length OR least_length IS NULL").select("read_name")
    first = _sides(passed, "line_no").join(several, "read_name", "left_semi").groupBy("read_name").agg(F.min(F.struct("line_no", "side", "length")).alias("f"))
    out = found.join(first, "read_name", "left")
    length = F.when(F.col("f").isNull(), F.col("least_length")).otherwise(F.col("f.length"))
    return out.select("read_name", length.alias("length"), "coverage_start", "coverage_end", "max_depth")
