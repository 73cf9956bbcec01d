"""Selection of quantiles against numpy, whatever is left for one task."""

import math
import random

import numpy as np
import pytest

from sieveline.operators.quantiles import quantiles

PROBS = [0.0, 0.05, 0.5, 0.75, 0.999, 1.0]


def check(got, rows):
    want = {}
    for g in {r[0] for r in rows}:
        own = [r[1] for r in rows if r[0] == g and r[1] is not None]
        for p in PROBS if own else []:
            want[g, p] = float(np.quantile(own, p))
    found = {(r[0], r["p"]): r["q"] for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(math.isclose(found[k], want[k], rel_tol=1e-12, abs_tol=1e-12) for k in want)


@pytest.mark.parametrize("few", [2, 30, 1 << 20])
def test_groups_of_any_kind(spark, few):
    """Nulls, ties, one value, huge and tiny values, a null group, a clashing name."""
    r = random.Random(2)
    rows = [(None, r.gauss(0, 1)) for _ in range(500)] + [("ties", float(r.choice((1, 1, 1, 2, 7)))) for _ in range(700)] + [("one", 4.5)] + [("none", None)] * 3
    rows += [("wide", r.choice((-1, 1)) * 10.0 ** r.uniform(-300, 300)) for _ in range(400)] + [("wide", None)]
    df = spark.createDataFrame(rows, "p string, x double")
    check(quantiles(df.withColumnRenamed("p", "g"), "x", PROBS, "g", few=few), rows)


def test_a_large_group(spark):
    from pyspark.sql import functions as F

    df = spark.range(1_000_000).select((F.col("id") % 3).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(10**12)) / 7.0).alias("x"))
    pdf = df.toPandas()
    got = {(r["g"], r["p"]): r["q"] for r in quantiles(df, "x", [0.01, 0.5], "g", few=1000).collect()}
    assert len(got) == 6 and all(math.isclose(q, np.quantile(pdf.x[pdf.g == g], p), rel_tol=1e-12) for (g, p), q in got.items())


def test_whole_and_empty_tables(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert [tuple(r) for r in quantiles(df, "v", [0.25]).collect()] == [(0.25, 2.5)]
    assert quantiles(df.limit(0), "v", [0.25]).collect() == []
