"""What steps leave on the disk, and that narrower rows and fewer shuffles give the same results."""

import random

import pytest
from pyspark.sql import functions as F

from readgraph.config import FilterConfig, GraphConfig
from readgraph.operators import filtering, graph, overlaps, paths
from readgraph.plans import assembly, lineage


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(i)) for i in range(files.size()) if "shuffle_" in str(files.apply(i))}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def made_alignments(spark, seed):
    """Reads of 100 bases of 1,500, some pairs twice, with ends that are a little off."""
    r = random.Random(seed)
    place = {f"r{i}": r.randrange(1500) for i in range(90)}
    rows = []
    for a in place:
        for b in place:
            s, e = max(place[a], place[b]), min(place[a], place[b]) + 100
            if a != b and e - s > 10 and r.random() < 0.7:
                s, e = s + r.randrange(3), e - r.randrange(3)
                rows.append((len(rows), a, 100, s - place[a], e - place[a], r.choice("+++-"), b, 100, s - place[b], e - place[b], e - s - r.randrange(9), e - s))
    return spark.createDataFrame(rows, "line_no long, query_name string, query_length long, query_start long, query_end long, strand string, target_name string, target_length long, target_start long, target_end long, num_matching long, alignment_block_length long")


def test_shuffle_files_go_with_their_execution(spark):
    before = shuffle_files(spark)
    counts = spark.range(5_000).groupBy((F.col("id") % 97).alias("k")).count()
    lineage.materialize(counts, "counts")
    _, n = lineage.counted(counts, "counts-again")
    assert n == 97 and not shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"  # for others it is as it was


def test_coverage_in_one_shuffle(spark):
    """As segments and regions found one after the other; several lengths of a read, and spans without a base."""
    passed = made_alignments(spark, 3).withColumn("query_length", F.when(F.col("line_no") % 7 == 0, F.col("query_length") + F.col("line_no")).otherwise(F.col("query_length")))
    empty = passed.filter("line_no < 2").withColumns({"query_name": F.lit("e1"), "target_name": F.lit("e2"), "query_end": F.col("query_start"), "target_end": F.col("target_start"), "query_length": F.lit(7).cast("long"), "target_length": F.lit(8).cast("long")})
    passed = passed.union(empty)
    segments = filtering.depth_segments(passed)
    regions = {r["read_name"]: (r[1], r[2]) for r in filtering.covered_regions(segments, 3).collect()}
    depths = {r["read_name"]: r[1] for r in segments.groupBy("read_name").agg(F.max("depth")).collect()}
    first = {}
    for r in sorted(passed.collect(), key=lambda r: r["line_no"]):
        first.setdefault(r["query_name"], r["query_length"])
        first.setdefault(r["target_name"], r["target_length"])
    want = sorted((n, first[n], *regions.get(n, (0, 0)), depths.get(n, 0)) for n in first)
    stats = filtering.read_stats(passed, 3)
    assert rows_of(stats) == want
    plan = filtering.coverage(passed, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_overlaps_from_narrow_rows(spark):
    """As from whole rows; the tables they were made from are few, and none is wider than what is used of it."""
    config, rows = FilterConfig(5, 3, 5.0, 0.8), made_alignments(spark, 5)
    passed = filtering.passing(rows, config)
    stats = filtering.read_stats(passed, 3)
    classes = overlaps.classify(filtering.best_alignments(passed), stats, config)
    out = overlaps.contained_reads(classes).union(overlaps.low_coverage_reads(stats, 3)).distinct()
    want = overlaps.without_reads(overlaps.proper_overlaps(classes), out)
    for stored in (False, True):
        since = lineage.mark(spark)
        found = overlaps.find_overlaps(rows, config, stored)
        assert found.columns == want.columns and rows_of(found) == rows_of(want)
        assert lineage.mark(spark) - since == 3  # classes, reads that go, and what is left by the first of them
        got, _ = overlaps.classified_alignments(rows, config, stored)
        assert rows_of(got) == rows_of(classes.select(*got.columns))
    assert want.count() > 5 and classes.select("cls").distinct().count() > 2


def test_graph_of_unique_overlaps_compares_no_edges(spark):
    config = FilterConfig(5, 3, 5.0, 0.8)
    found = lineage.materialize(overlaps.find_overlaps(made_alignments(spark, 5), config), "overlaps")
    plain, unique = graph.build_graph(found), graph.build_graph(found, unique=True)
    assert rows_of(unique.edges) == rows_of(plain.edges) and rows_of(unique.nodes) == rows_of(plain.nodes)
    assert "Exchange" not in unique.edges._jdf.queryExecution().executedPlan().toString()


def test_walks_are_counted_as_they_are_written(spark, monkeypatch):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "node long, next long")
    monkeypatch.setattr(type(links), "count", lambda self: pytest.fail("a job for the count alone"))
    found = {r["node"]: (r["last"], r["hops"]) for r in paths.follow(links).collect()}
    assert found == {i: (40, 40 - i) for i in range(41)}


def test_stored_overlaps_are_built_from_as_they_are(spark, monkeypatch):
    config = GraphConfig(cleanup_iterations=0)
    found = lineage.materialize(overlaps.find_overlaps(made_alignments(spark, 5), FilterConfig(5, 3, 5.0, 0.8)), "overlaps")
    want = assembly.assemble(found, config)
    monkeypatch.setattr(graph, "first_edges", lambda edges: pytest.fail("edges compared"))
    done = assembly.assemble(found, config, stored=True)
    assert rows_of(done.metrics) == rows_of(want.metrics) and rows_of(done.unitigs.members) == rows_of(want.unitigs.members)
