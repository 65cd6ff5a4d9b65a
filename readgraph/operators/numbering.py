"""Dense numbers for rows in an order, and sums of what comes before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import materialize


def sums_before(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before, in the order of columns that identify a row.

    Rows are dealt by range and summed up within each part; the parts' sums, one row a part, are summed up in turn.
    """
    parts = materialize(df.orderBy(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    sizes = parts.groupBy("__part").agg(F.sum(value).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(starts, "__part").withColumn(name, (F.col("__before") + own).cast("long")).drop("__part", "__before")


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... in the order of columns that identify a row."""
    return sums_before(df.withColumn("__one", F.lit(1)), order, "__one", name).drop("__one")
