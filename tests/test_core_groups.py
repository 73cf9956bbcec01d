"""Groups of the rule against chaining and plain components, without a row for each pair, against brute force."""

import numpy as np
import pytest

from sieveline.operators import core as C
from sieveline.operators import packs as K
from sieveline.operators.edges import Thresholds
from tests.test_bootstrap_size import shuffled


def table(spark, v):
    rows = [(i * 5, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9005, [0.0] * v.shape[1])]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(3)


def components(n, edges):
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return {i * 5: g * 5 for i, g in enumerate(label)} | {9000: 9000, 9005: 9005}


def brute(v, t, least):
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim, same = x @ x.T, 64 - ((v[:, None] > 0) != (v[None] > 0)).sum(axis=2)
    near = (sim >= least) & ((sim >= t.accept_sim) | (same >= t.accept_count)) & ~np.eye(len(v), dtype=bool)
    degree = near.sum(axis=1)
    every = [(a, b) for a, b in np.argwhere(near).tolist() if a < b]
    used = [(a, b) for a, b in every if sim[a, b] >= t.strong_sim or same[a, b] >= t.strong_count or (near[a] & near[b]).any() or min(degree[a], degree[b]) == 1]
    return components(len(v), every), components(len(v), used), len(every), len(used)


@pytest.mark.parametrize("seed,blocks", [(1, 1), (3, 5)])
def test_against_brute_force(spark, monkeypatch, seed, blocks):
    monkeypatch.setattr(K, "LEAST_PACK", 150 // blocks)
    monkeypatch.setattr(K, "PRODUCTS", 700)
    monkeypatch.setattr(C, "OPEN_PAIRS", 9)
    v = np.random.default_rng(seed).normal(size=(150, 12))
    t, least = Thresholds(accept_count=63, accept_sim=0.68, strong_count=65, strong_sim=0.85), 0.6
    plain, core, n, m = brute(v, t, least)
    assert m < n and len(set(plain.values())) < len(set(core.values())) < 130  # edges that chain, triangles and leaves
    assert dict(C.core_groups(table(spark, v), t, least).collect()) == core
    assert dict(C.plain_groups(table(spark, v), t, least).collect()) == plain


def test_pairs_are_no_rows(spark):
    """1,500 vectors that are all near each other: 1,124,250 pairs."""
    v = np.random.default_rng(2).normal(size=(1500, 8)) * 0.1 + 1
    df, before, t = table(spark, v), shuffled(spark), Thresholds(accept_count=60, accept_sim=0.5, strong_count=64, strong_sim=0.8)
    assert {r.grp for r in C.core_groups(df, t, 0.3).where("id < 9000").collect()} == {0}
    assert {r.grp for r in C.plain_groups(df, t, 0.3).where("id < 9000").collect()} == {0}
    assert shuffled(spark) - before < 2_000_000
    assert C.core_groups(df.limit(0), t, 0.3).collect() == []
