"""Some registered queries against their SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from readgraph import queries as q

DATA = "/root/testdata/sf0.001"
NAMES = ["paf_parse", "best_alignment", "read_stats", "classify_alignments", "filtering_metrics", "transitive_edges", "short_edges", "unitig_members", "gfa", "gfa_chunks", "component_sizes", "multi_edges", "remove_short_edges", "remove_weak_edges", "contended_nodes", "sequential_unitigs", "fasta_chunks"]
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{DATA}/orders.parquet')")
    cursor = con.execute(q.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    got = sorted(repr(tuple(r)) for r in q.QUERIES[name](spark, DATA).select(*columns).collect())
    assert got == want
