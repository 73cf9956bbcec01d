"""Triangles and degrees of edges: against brute force, and without a row for each wedge."""

import random

from sieveline.operators import edges as E
from sieveline.plans import fixtures as X
from tests.test_bootstrap_size import shuffled


def table(spark, edges):
    return spark.createDataFrame([(a, b, a % 2 == 0) for a, b in edges], "a long, b long, strong boolean")


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    edges = sorted({tuple(sorted(rnd.sample(range(60), 2))) for _ in range(400)} | {(0, 1 << 40), (5, 1 << 40)})
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {(a, b): (a % 2 == 0, len(near[a] & near[b]), len(near[a]), len(near[b])) for a, b in edges}
    for entries, looked_up in ((1 << 18, 1 << 20), (40, 7)):
        monkeypatch.setattr(E, "ENTRIES", entries)
        monkeypatch.setattr(E, "LOOKED_UP", looked_up)
        got = {(r.a, r.b): (r.strong, r.tri, r.deg_a, r.deg_b) for r in E.with_common(table(spark, edges)).collect()}
        assert got == want
    assert E.with_common(table(spark, edges).limit(0)).collect() == []


def test_wedges_are_no_rows(spark):
    """All edges of 120 vertices: 842,520 wedges, of which none is shuffled."""
    edges, before = table(spark, [(a, b) for a in range(120) for b in range(a)]), shuffled(spark)
    assert {r.tri for r in E.common_neighbours(edges.selectExpr("least(a, b) a", "greatest(a, b) b")).collect()} == {118}
    assert shuffled(spark) - before < 2_000_000


def test_groups_are_made_once(spark, sf, monkeypatch):
    """One search for edges serves groups, arms and splits of a query."""
    from sieveline.plans import design

    calls, real = [], X.edge_table
    monkeypatch.setattr(X, "edge_table", lambda *a: calls.append(a) or real(*a))
    for query in (design.partition_validation, design.report_metrics, design.group_split_leak, design.build_counts):
        calls.clear()
        query(spark, sf)
        assert len(calls) == 1
