"""Sources that are decided from lists, and those that are too wide for it."""

import random

import pytest
from test_core import ends

from readgraph.operators import graph, reduction
from readgraph.operators.graph import EDGE
from readgraph.plans import lineage


def made(spark, seed):
    """A random graph with a hub, ties, loops, edges without a twin and two edges with the same ends."""
    r = random.Random(seed)
    flip = lambda n: n[:-1] + {"+": "-", "-": "+"}[n[-1]]
    rows = {}
    for a in range(16):
        for b in range(16):
            if a != b and (a == 0 or r.random() < 0.25):
                s, d, n = f"r{a:02d}+", f"r{b:02d}" + r.choice("++-"), r.randrange(1, 30)
                rows[s, d] = n
                if r.random() < 0.9:
                    rows[flip(d), flip(s)] = r.choice([n, n + 1])
    rows["r03+", "r03+"] = 4
    edges = [(s, d, n, 100, 90.0) for (s, d), n in rows.items()]
    edges.append((*edges[5][:2], edges[5][2] + 3, 80, 70.0))
    nodes = sorted({x for e in edges for x in e[:2]})
    return graph.Graph(spark.createDataFrame([(n,) for n in nodes], "node_id string"), spark.createDataFrame(edges, EDGE)), edges, rows


@pytest.mark.parametrize("wide", [500, 6, 0])
def test_sources_of_any_width(spark, wide):
    g, edges, rows = made(spark, 8)
    flip = lambda n: n[:-1] + {"+": "-", "-": "+"}[n[-1]]
    found = set(ends(reduction.transitive_edges(g.edges, 5, wide)))
    assert found == set(ends(reduction.transitive_edges(g.edges, 5, 0))) and len(found) > 20
    gone = found | {(flip(d), flip(s)) for s, d in found}
    since = lineage.mark(spark)
    left = reduction.reduce_transitive(g, 5, wide).edges
    assert lineage.mark(spark) - since == 1  # the tables that it was decided from are gone
    want = sorted(e for e in edges if e[:2] not in gone)
    assert sorted(map(tuple, left.collect())) == want and 0 < len(want) < len(edges)


def test_lists_make_no_triangle_rows(spark, monkeypatch):
    g, _, _ = made(spark, 9)
    monkeypatch.setattr(reduction, "triangles", lambda *a: pytest.fail("triangles as rows"))
    assert reduction.transitive_edges(g.edges, 5).count() > 20
