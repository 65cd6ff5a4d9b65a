"""Alignments as a stream of files.

Parsing and the row filters need one line at a time, so they run on each batch of arriving lines. The best
alignment of a pair and coverage need all lines: what passes is written as Parquet, and the batch operators
take it from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import FilterConfig
from ..operators.filtering import passing
from ..sources.alignments import parse_paf


def collect_paf(spark: SparkSession, folder: str, config: FilterConfig, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the passing alignments of the PAF files in ``folder`` to ``out`` and stops; started again, it goes on with new ones.

    A batch that is repeated after a failure replaces its own folder, so nothing is written twice. Lines are
    in order of batch, file and place in the file.
    """
    lines = spark.readStream.option("lineSep", "\n").text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def write(batch: DataFrame, number: int) -> None:
        place = F.struct(F.lit(number).cast("long").alias("number"), "file", "block", F.monotonically_increasing_id().alias("row"))
        passing(parse_paf(batch.select("value", place.alias("line_no"))), config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
