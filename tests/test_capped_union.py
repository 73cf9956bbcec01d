"""The capped union in rounds against a walk along the order."""

import random

import pytest

from sieveline.operators.edges import capped_union


def walk(groups, edges, cap):
    """Clusters as sets of items, edge by edge."""
    cluster = {}
    for item, g in groups:
        cluster.setdefault(g, set()).add(item)
    home, name = {i: cluster[g] for i, g in groups}, {}
    for g, own in cluster.items():
        name[id(own)] = g
    merged = refused = 0
    for _, a, b in sorted((-n, a, b) for a, b, n in edges):
        one, two = home[a], home[b]
        if one is two:
            continue
        if len(one) + len(two) > cap:
            refused += 1
            continue
        merged += 1
        if len(one) < len(two):
            one, two = two, one
        name[id(one)] = min(name[id(one)], name[id(two)])
        one |= two
        for i in two:
            home[i] = one
    return {i: name[id(own)] for i, own in home.items()}, merged, refused


def compare(spark, groups, edges, cap, few):
    got, counts = capped_union(spark.createDataFrame(groups, "id long, grp long"), spark.createDataFrame(edges, "a long, b long, n_inl long"), cap, few)
    want, merged, refused = walk(groups, edges, cap)
    assert tuple(counts.first()) == (merged, refused)
    assert {r.id: r.grp for r in got.collect()} == want
    return merged, refused


def test_one_large_component(spark):
    """100,000 edges of one component: rounds bring them down to what one task walks."""
    r = random.Random(1)
    n = 40_000
    groups = [(i, i - i % 2 if r.random() < 0.3 else i) for i in range(n)]
    edges = {(min(a, b), max(a, b)): r.randrange(1000) for a, b in [(i, r.randrange(i)) for i in range(1, n)] + [(r.randrange(n), r.randrange(n)) for _ in range(60_500)] if a != b}
    merged, refused = compare(spark, groups, [(a, b, c) for (a, b), c in edges.items()], 40, 5000)
    assert merged > 10_000 and refused > 10_000


@pytest.mark.parametrize("shape", ["chain", "star", "mixed"])
def test_orders_that_rounds_are_slow_at(spark, shape):
    r = random.Random(3)
    groups = [(i, i) for i in range(300)]
    edges = {"chain": [(i, i + 1, 1000 - i) for i in range(299)], "star": [(0, i, i % 7) for i in range(1, 300)], "mixed": [(i, j, r.randrange(4)) for i in range(300) for j in range(i + 1, min(300, i + 4))]}[shape]
    compare(spark, groups, edges, 9, 60)


def test_nothing_to_merge(spark):
    assert compare(spark, [(1, 1), (2, 1)], [(1, 2, 5)], 5, 10) == (0, 0)
    got, counts = capped_union(spark.createDataFrame([], "id long, grp long"), spark.createDataFrame([], "a long, b long, n_inl long"), 5)
    assert got.collect() == [] and tuple(counts.first()) == (0, 0)
