"""PAF alignments and FASTQ reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..operators.numbering import sums_before
from ..plans.lineage import materialize

#: The first twelve columns, by kind.
PAF = [
    ("query_name", "string"), ("query_length", "u32"), ("query_start", "i64"), ("query_end", "i64"), ("strand", "char"), ("target_name", "string"),
    ("target_length", "u32"), ("target_start", "i64"), ("target_end", "i64"), ("num_matching", "u32"), ("alignment_block_length", "u32"), ("mapq", "u8"),
]
MOST = {"u32": 2**32 - 1, "u8": 2**8 - 1}


def _number(text: Column, kind: str) -> Column:
    """The number that ``text`` is; null if it isn't one, or is out of range."""
    # a cast alone would also take spaces around, and parts of numbers after a point
    value = F.when(F.translate(text, "0123456789", "").isin("", *(["+", "-"] if kind == "i64" else ["+"])), text.try_cast("bigint"))
    return value if kind == "i64" else F.when(value <= MOST[kind], value)


def parse_paf(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Alignments of text lines (``value``); ``order`` tells which line is first.

    Comments, blank lines, lines of fewer than twelve columns and lines with a number that isn't one are
    dropped; further columns are ignored. A strand is the first character of its column, "+" if empty.
    """
    line = F.regexp_replace("value", "\r$", "")
    kept = lines.filter(~F.col("value").startswith("#")).select(F.col(order).alias("line_no"), F.split(line, "\t", -1).alias("f")).filter(F.size("f") >= len(PAF))

    def column(i: int, kind: str) -> Column:
        value = F.col("f")[i]
        if kind == "char":
            return F.when(value == "", "+").otherwise(F.left(value, F.lit(1)))
        return value if kind == "string" else _number(value, kind)

    # inlined, so that later filters look at the parsed values and don't parse again
    row = F.inline(F.array(F.struct(*[column(i, kind).alias(name) for i, (name, kind) in enumerate(PAF)])))
    parsed = kept.select("line_no", row)
    return parsed.dropna(subset=[name for name, kind in PAF if kind in ("u32", "i64", "u8")]).withColumn("mapq", F.col("mapq").cast("smallint"))


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a PAF file or folder; ``line_no`` orders lines as the files have them."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return parse_paf(spark.read.option("lineSep", "\n").text(path).select("value", place.alias("line_no")))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``read_name, seq`` of four-line records; the last record of a name wins.

    A header that doesn't begin with "@", or a header without a sequence line, is an error. Lines are
    numbered without a shuffle: the files' splits are counted first, then each adds the lines before it.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), place.alias("place"))
    return parse_fastq(lines)


def parse_fastq(lines: DataFrame) -> DataFrame:
    """Reads of text lines (``value``) in the order of ``place`` (a struct of file, block and row)."""
    splits = lines.groupBy("place.file", "place.block").agg(F.count(F.lit(1)).alias("n"), F.min("place.row").alias("first"))
    offsets = materialize(sums_before(splits, ["file", "block"], "n", "before").drop("n"), "fastq-splits")
    # one row a split, which Spark broadcasts only while the table is small
    numbered = lines.withColumns({"file": F.col("place.file"), "block": F.col("place.block")}).join(offsets, ["file", "block"])
    line = F.col("place.row") - F.col("first") + F.col("before")
    records = numbered.select("value", line.alias("line")).withColumn("record", F.floor(F.col("line") / 4)).withColumn("part", F.col("line") % 4).filter("part < 2")
    whole = records.groupBy("record").agg(F.max(F.when(F.col("part") == 0, F.col("value"))).alias("header"), F.max(F.when(F.col("part") == 1, F.col("value"))).alias("seq"))
    # a file may end with an empty line
    whole = whole.filter(~((F.col("header") == "") & F.col("seq").isNull()))
    checked = F.when(~F.col("header").startswith("@"), F.raise_error(F.concat(F.lit("not a FASTQ header: "), F.col("header")))).when(F.col("seq").isNull(), F.raise_error(F.concat(F.lit("no sequence after "), F.col("header")))).otherwise(F.col("seq"))
    name = F.regexp_extract("header", r"^@\s*(\S*)", 1)
    return whole.select(name.alias("read_name"), "record", checked.alias("seq")).groupBy("read_name").agg(F.max_by("seq", "record").alias("seq"))


def write_overlaps(overlaps: DataFrame, path: str) -> None:
    overlaps.write.mode("overwrite").parquet(path)


def read_overlaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
