"""Queries over pairs of vectors that no longer write or shuffle a row for each pair, against brute force."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from sieveline.functions.scalar import median_signature
from sieveline.operators import core as C
from sieveline.operators import packs as K
from sieveline.operators import pairs as P
from sieveline.operators.edges import Thresholds
from tests.test_bootstrap_size import shuffled
from tests.test_core_groups import table


def pairs_of(v, least):
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = x @ x.T
    return {(i * 5, j * 5): sim[i, j] for i in range(len(v)) for j in range(i + 1, len(v)) if sim[i, j] >= least}


def test_summary(spark, monkeypatch):
    """Quantiles by cells within cells; equal cosines too."""
    v = np.random.default_rng(1).normal(size=(150, 6))
    v[20:40] = v[20]
    for name, value in (("LEAST_PACK", 40), ("PRODUCTS", 700)):
        monkeypatch.setattr(K, name, value)
    for cells, few in ((4096, 1 << 14), (8, 3)):
        monkeypatch.setattr(C, "CELLS", cells)
        monkeypatch.setattr(C, "FEW", few)
        s, got = np.array(list(pairs_of(v, 0.3).values())), C.summary(table(spark, v), 0.3, [0.25, 0.5, 0.75])
        assert got["n"] == len(s)
        assert np.allclose([got["mean"], got["sd"], got["low"], got["high"], *got["q"]], [s.mean(), s.std(ddof=1), s.min(), s.max(), *np.quantile(s, [0.25, 0.5, 0.75])], atol=1e-9)
    assert C.summary(table(spark, v).limit(0), 0.3, [0.5])["n"] == 0


def test_pair_rows(spark, monkeypatch):
    """1,000 near vectors: 499,500 pairs go out, and only vectors are shuffled."""
    v = np.random.default_rng(2).normal(size=(120, 8))
    monkeypatch.setattr(K, "LEAST_PACK", 40)
    got = {(r.a, r.b): (r.n_inl, r.n_good) for r in C.pair_rows(table(spark, v), 0.3).collect()}
    up = v > 0
    want = {(a, b): (56 + int((up[a // 5] == up[b // 5]).sum()), int((up[a // 5] & up[b // 5]).sum())) for a, b in pairs_of(v, 0.3)}
    assert got == want
    df, before = table(spark, np.random.default_rng(3).normal(size=(1000, 8)) * 0.1 + 1), shuffled(spark)
    assert C.pair_rows(df, 0.3).count() == 499_500
    assert shuffled(spark) - before < 2_000_000


def test_wide_signatures_are_compared_in_blocks(spark):
    """More signatures than probes, which all would be shuffled."""
    rng = np.random.default_rng(4)
    sigs = rng.integers(-(1 << 63), 1 << 63, 700, dtype=np.int64)
    sigs[350:] = sigs[:350] ^ (1 << rng.integers(0, 63, 350))
    df, before = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sigs)], "id long, sig long"), shuffled(spark)
    found = P.hamming_pairs(df, 8).collect()
    assert {(r.a, r.b) for r in found} == {(i, j) for i in range(700) for j in range(i + 1, 700) if int(np.bitwise_count((sigs[i] ^ sigs[j]).view(np.uint64))) <= 8}
    assert shuffled(spark) - before < 100_000


def test_median_signatures(spark):
    v = np.random.default_rng(5).normal(size=(40, 9))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(50, [1.0, 2.0, None]), (51, None), (52, [3.0, float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert set(P.median_signatures(df).collect()) == set(df.select("id", median_signature(F.col("v")).alias("sig")).collect())


def test_strata_and_degrees(spark, monkeypatch):
    """The first pairs of each stratum by key are among the sample, and partners are counted by stratum."""
    monkeypatch.setattr(K, "LEAST_PACK", 40)
    v, t = np.random.default_rng(6).normal(size=(120, 8)), Thresholds(accept_count=65, accept_sim=0.5, strong_count=65, strong_sim=0.7)
    sims = pairs_of(v, 0.3)
    strata = lambda s, n: (s >= 0.5).astype(int) + (s >= 0.7)
    some, sizes = C.strata_sample(table(spark, v), t, 0.3, strata, 5, lambda a, b: F.md5(F.concat_ws("-", a, b).cast("binary")))
    of = {k: [p for p, s in sims.items() if int(s >= 0.5) + int(s >= 0.7) == k] for k in range(3)}
    assert sizes == {k: len(x) for k, x in of.items()}
    got = {(r.a, r.b) for r in some.collect()}
    for pairs in of.values():
        assert set(sorted(pairs, key=lambda p: hashlib.md5(f"{p[0]}-{p[1]}".encode()).hexdigest())[:5]) <= got
    labeled = table(spark, v).withColumn("label", (F.col("id") % 10).cast("long"))
    want = {}
    for (a, b), s in sims.items():
        for x, y in ((a, b), (b, a)):
            if s >= 0.5 and y % 10:
                want.setdefault(x, [0, 0])[int(s < 0.7)] += 1
    assert {r.id: [r.strong, r.weak] for r in C.degrees(labeled, t, 0.3).collect()} == want
