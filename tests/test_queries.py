"""Queries against their SQL over whole tables, and invariants of those that SQL can't express."""

import functools

import duckdb
import pytest

from sieveline import registry
from sieveline.plans import design, fixtures, leakage

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def once():
    """Tables that many queries begin with are made once for all of them."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fixtures, "sim_pairs", functools.cache(fixtures.sim_pairs))
        core = functools.cache(leakage.core_groups)
        for module in (leakage, design):
            patch.setattr(module, "core_groups", core)
        for name in ("arms_of", "both_splits", "rated_of"):
            patch.setattr(design, name, functools.cache(getattr(design, name)))
        yield


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    found = con.execute(f"select {', '.join(cols)} from ({registry.ORACLES[name]})")
    assert [str(d[1]) for d in found.description] == [KINDS[dict(df.dtypes)[c]] for c in cols]
    assert sorted(map(repr, map(tuple, df.select(cols).collect()))) == sorted(map(repr, found.fetchall()))


def test_capped_groups(spark, sf):
    from sieveline.operators import edges as E
    from sieveline.plans import fixtures as X
    from sieveline.plans.leakage import core_groups

    core, e = core_groups(spark, sf)
    size = {}
    for r in core.collect():
        size[r.grp] = size.get(r.grp, 0) + 1
    group = {r.id: r.grp for r in core.collect()}
    up = {g: g for g in size}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    merged = refused = 0
    for r in sorted(e.where("not used").collect(), key=lambda r: (-r.n_inl, r.a, r.b)):
        a, b = sorted((top(group[r.a]), top(group[r.b])))
        if a == b:
            continue
        if size[a] + size[b] > X.T.cap:
            refused += 1
        else:
            up[b], size[a], merged = a, size[a] + size[b], merged + 1
    got, counts = E.capped_union(core, e.where("not used").select("a", "b", "n_inl"), X.T.cap)
    assert {r.id: r.grp for r in got.collect()} == {i: top(g) for i, g in group.items()}
    assert tuple(counts.first()) == (merged, refused)


def test_balanced_split(spark):
    from sieveline.operators import splits as S

    rows = spark.createDataFrame([(i, i // (1 + i % 7), i % 3) for i in range(600)], "id long, grp long, res int")
    split = S.balanced_split(rows, [0, 1, 2], restarts=6)
    joined = rows.join(split, "grp")
    n = {r.split: r.n for r in joined.groupBy("split").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert sum(n.values()) == 600 and abs(n["train"] - 420) < 12 and abs(n["val"] - 90) < 12
    assert split.count() == rows.select("grp").distinct().count()
    assert {tuple(r) for r in split.collect()} == {tuple(r) for r in S.balanced_split(rows, [0, 1, 2], restarts=6).collect()}


def test_vectors_and_bits(spark):
    from pyspark.sql import functions as F

    from sieveline.functions import scalar as V

    df = spark.createDataFrame([([3.0, -4.0, 1.0, 0.0, 2.0],), ([0.0] * 5,)], "v array<double>")
    a, b = df.select(V.normalise(F.col("v")).alias("n"), V.sign_signature(F.col("v")).alias("s"), V.median_signature(F.col("v")).alias("m"), V.unpack_bits(V.sign_signature(F.col("v")), 5).alias("u")).collect()
    assert abs(sum(x * x for x in a.n) - 1) < 1e-12 and b.n == [None] * 5
    assert (a.s, a.m, list(a.u)) == (0b10101, 0b10101, [1, 0, 1, 0, 1]) and b.s == 0
