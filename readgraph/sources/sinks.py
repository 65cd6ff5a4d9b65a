"""DOT, FASTA and GFA: lines in order, and files of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.sequences import degree_color, escape_dot
from ..operators.graph import Graph
from .chunks import ChunkSource


def dot_lines(graph: Graph) -> DataFrame:
    """``section, a, b, line``: in order of the first three they are a DOT file; nodes are coloured by edges out."""
    spark = graph.nodes.sparkSession
    quoted = lambda c: F.concat(F.lit('"'), escape_dot(F.col(c)), F.lit('"'))
    frame = [(0, "0", "digraph OverlapGraph {"), (0, "1", "  rankdir=LR;"), (0, "2", '  node [shape=box fontname="Helvetica"];'), (0, "3", '  edge [fontname="Helvetica"];'), (0, "4", ""), (2, "0", ""), (4, "0", "}")]
    fixed = spark.createDataFrame(frame, "section int, a string, line string").select("section", "a", F.lit("").alias("b"), "line")
    out = graph.edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    color = degree_color(F.coalesce("n", F.lit(0)))
    nodes = graph.nodes.join(out, "node_id", "left").select(F.lit(1).alias("section"), F.col("node_id").alias("a"), F.lit("").alias("b"), F.concat(F.lit("  "), quoted("node_id"), F.lit(" [style=filled fillcolor="), color, F.lit(" ];")).alias("line"))
    edges = graph.edges.select(F.lit(3).alias("section"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(";")).alias("line"))
    return fixed.unionByName(nodes).unionByName(edges)


def fasta_lines(sequences: DataFrame) -> DataFrame:
    """``unitig_id, line``: header and sequence, the sequence on one line."""
    text = F.format_string(">unitig_%d len=%dbp\n%s", F.col("unitig_id"), F.length("sequence"), F.col("sequence"))
    return sequences.select("unitig_id", text.alias("line"))


def gfa_lines(sequences: DataFrame, edges: DataFrame) -> DataFrame:
    """``section, a, b, line``: in order of the first three they are a GFA file. Links are + to +, as each strand has its own unitig."""
    spark = sequences.sparkSession
    head = spark.range(1).select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit("H\tVN:Z:1.0").alias("line"))
    segments = sequences.select(F.lit(1).alias("section"), F.col("unitig_id").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.lit("S\tunitig_"), F.col("unitig_id").cast("string"), F.lit("\t"), F.coalesce("sequence", F.lit("*"))).alias("line"))
    links = edges.select(F.lit(2).alias("section"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.format_string("L\tunitig_%d\t+\tunitig_%d\t+\t%dM", F.col("from_id"), F.col("to_id"), F.col("overlap_len")).alias("line"))
    return head.unionByName(segments).unionByName(links)


def write_lines(lines: DataFrame, path: str) -> None:
    """A folder of text parts that follow each other by name; the order of the columns before ``line``."""
    order = [c for c in lines.columns if c != "line"]
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def _framed(unitigs: DataFrame, chunks: DataFrame, head: Column) -> DataFrame:
    """``unitig_id, part, text``: chunks between a head (part -1), which may use the column ``bases``, and the line's end."""
    sizes = chunks.groupBy("unitig_id").agg(F.sum(F.length("text")).alias("bases"), (F.max("part") + 1).alias("end"))
    known = unitigs.select("unitig_id").join(sizes, "unitig_id", "left").select("unitig_id", F.coalesce("bases", F.lit(0)).alias("bases"), F.coalesce("end", F.lit(0)).cast("long").alias("end"))
    row = lambda part, text: F.struct(part.cast("long").alias("part"), text.alias("text"))
    frame = known.select("unitig_id", F.inline(F.array(row(F.lit(-1), head), row(F.col("end"), F.lit("\n")))))
    return frame.unionByName(chunks.select("unitig_id", F.col("part").cast("long").alias("part"), "text"))


def fasta_chunks(unitigs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``unitig_id, part, text``: in order of the first two, the texts after each other are the file of ``fasta_lines``."""
    return _framed(unitigs, chunks, F.format_string(">unitig_%d len=%dbp\n", "unitig_id", "bases"))


def gfa_chunks(unitigs: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """``section, a, b, text``: in order of the first three, the texts after each other are the file of ``gfa_lines``."""
    segments = _framed(unitigs, chunks, F.format_string("S\tunitig_%d\t", "unitig_id")).select(F.lit(1).alias("section"), F.col("unitig_id").alias("a"), F.col("part").alias("b"), "text")
    empty = segments.limit(0).select(F.col("a").alias("unitig_id"), F.col("text").alias("sequence"))
    lines = gfa_lines(empty, edges).select("section", "a", "b", F.concat("line", F.lit("\n")).alias("text"))
    return lines.unionByName(segments)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """As ``write_lines``, for a column ``text`` that brings its own line ends; a line may go on in the next part."""
    chunks.sparkSession.dataSource.register(ChunkSource)
    order = [c for c in chunks.columns if c != "text"]
    chunks.orderBy(*order).select("text").write.format(ChunkSource.name()).mode("overwrite").option("path", path).save()
