"""Command line: ``alignment-filtering`` and ``assemble``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import FilterConfig, GraphConfig
from .operators.unitigs import sequence_chunks
from .plans.assembly import assemble, filter_metrics, filter_paf
from .plans.lineage import materialize, release
from .sources.alignments import read_fastq, read_overlaps, read_paf, write_overlaps
from .sources.sinks import dot_lines, fasta_chunks, gfa_chunks, write_chunks, write_lines


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="readgraph", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    filtering = commands.add_parser("alignment-filtering", help="filter alignments into overlaps")
    building = commands.add_parser("assemble", help="build, clean and compress the overlap graph")
    filtering.add_argument("-f", "--input-paf", required=True)
    filtering.add_argument("--output-overlaps", default="overlaps.parquet")
    building.add_argument("-f", "--input-paf")
    building.add_argument("--overlaps", help="overlaps of an earlier run; filter options are then ignored")
    building.add_argument("-r", "--reads-fq", required=True)
    building.add_argument("-p", "--output-prefix", default="unitigs")
    building.add_argument("-o", "--output-dir", default=".")
    for p in (filtering, building):
        d = FilterConfig()
        p.add_argument("-l", "--min-overlap-length", type=int, default=d.min_overlap_length)
        p.add_argument("-c", "--min-overlap-count", type=int, default=d.min_overlap_count)
        p.add_argument("-i", "--min-percent-identity", type=float, default=d.min_percent_identity)
        p.add_argument("--overhang-ratio", type=float, default=d.overhang_ratio)
    d = GraphConfig()
    building.add_argument("--unitig-order", choices=("branch-first", "sequential"), default=d.unitig_order)
    for name in ("max_bubble_length", "max_tip_len", "fuzz", "cleanup_iterations"):
        building.add_argument("--" + name.replace("_", "-"), type=int, default=getattr(d, name))
    for name in ("min_support_ratio", "short_edge_ratio"):
        building.add_argument("--" + name.replace("_", "-"), type=float, default=getattr(d, name))
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("readgraph").getOrCreate()
    wanted = FilterConfig(a.min_overlap_length, a.min_overlap_count, a.min_percent_identity, a.overhang_ratio)
    if a.command == "alignment-filtering":
        write_overlaps(filter_paf(spark, a.input_paf, wanted), a.output_overlaps)
        filter_metrics(read_paf(spark, a.input_paf), wanted).show(100, False)
        return
    if a.overlaps:
        overlaps = read_overlaps(spark, a.overlaps)
    elif a.input_paf:
        path = f"{a.output_dir}/{a.output_prefix}.overlaps.parquet"
        write_overlaps(filter_paf(spark, a.input_paf, wanted), path)
        overlaps = read_overlaps(spark, path)
    else:
        raise SystemExit("assemble needs --input-paf or --overlaps")
    config = GraphConfig(a.max_bubble_length, a.min_support_ratio, a.max_tip_len, a.fuzz, a.cleanup_iterations, a.short_edge_ratio, unitig_order=a.unitig_order)
    done = assemble(overlaps, config)
    write_lines(dot_lines(done.graph), f"{a.output_dir}/graph.dot")
    found = done.unitigs
    chunks = materialize(sequence_chunks(found.members, done.graph, read_fastq(spark, a.reads_fq)), "chunks")
    write_chunks(fasta_chunks(found.unitigs, chunks), f"{a.output_dir}/{a.output_prefix}.fa")
    write_chunks(gfa_chunks(found.unitigs, chunks, found.edges), f"{a.output_dir}/{a.output_prefix}.gfa")
    done.metrics.show(200, False)
    release(spark)


if __name__ == "__main__":
    main()
