"""Scalar functions on reads, nodes and alignments, as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def percent_identity(matching: Column, block: Column) -> Column:
    """100 * matching / block in 32-bit arithmetic, widened; NaN for 0/0 and infinity for n/0."""
    quotient = (matching.cast("float") / F.nullif(block.cast("float"), F.lit(0.0).cast("float"))).cast("float")
    percent = (quotient * F.lit(100.0).cast("float")).cast("float").cast("double")
    return F.when(block != 0, percent).when(matching == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))


def opposite(strand: Column) -> Column:
    return F.when(strand == "+", "-").when(strand == "-", "+").otherwise(strand)


def rc_node(node: Column) -> Column:
    """The node of the other strand; ids without a strand stay."""
    last = F.right(node, F.lit(1))
    return F.when(last.isin("+", "-"), F.concat(F.substr(node, F.lit(1), F.length(node) - 1), opposite(last))).otherwise(node)


def read_of(node: Column) -> Column:
    return F.substr(node, F.lit(1), F.length(node) - 1)


def rev_comp(seq: Column) -> Column:
    """Reverse complement; lower-case bases come out in upper case, other characters stay."""
    return F.translate(F.reverse(seq), "ACGTNacgtn", "TGCANTGCAN")


def escape_dot(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def degree_color(degree: Column) -> Column:
    return F.when(degree == 0, "gray").when(degree == 1, "black").when(degree == 2, "blue").when(degree <= 5, "orange").otherwise("red")


def prefix(seq: Column, n: Column) -> Column:
    """The first n bases; an error if there are fewer."""
    return F.when(F.length(seq) >= n, F.substr(seq, F.lit(1), n.cast("int"))).otherwise(F.raise_error(F.lit("an edge is longer than its read")))
