"""Multi-index probing against all pairs, and what the incremental join looks at."""

import random

import pytest

from sieveline.operators import pairs as P
from sieveline.streaming import incremental


def signatures(seed, n):
    """Signed 64-bit numbers, many of them some bits from others."""
    r = random.Random(seed)
    sigs = [r.getrandbits(64) for _ in range(n // 4)]
    while len(sigs) < n:
        s = r.choice(sigs[: n // 4])
        for bit in r.sample(range(64), r.randrange(20)):
            s ^= 1 << bit
        sigs.append(s)
    return [(i, s - (1 << 64) if s >> 63 else s) for i, s in enumerate(sigs)]


def brute(left, right, most):
    return {(min(a, b), max(a, b), d) for a, x in left for b, y in right if a != b and (d := ((x ^ y) & ((1 << 64) - 1)).bit_count()) <= most}


@pytest.mark.parametrize("most", [0, 3, 7, 8, 10, 13, 17])
def test_probes_against_all_pairs(spark, most):
    rows = signatures(most, 120)
    df = spark.createDataFrame(rows + [(None, 1), (500, None)], "id long, sig long")
    want = brute(rows, rows, most)
    assert want
    clean = df.where("id is not null and sig is not null")
    found = [tuple(r) for r in P._probed(clean, clean, most, lambda x, y: x < y).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert {tuple(r) for r in P.hamming_pairs(df, most).collect()} == want
    left, right = rows[:30], rows[25:]
    between = [tuple(r) for r in P.hamming_between(df.where("id < 30"), df.where("id >= 25"), most).collect()]
    assert set(between) == brute(left, right, most)


def test_rows_of_the_join_follow_what_is_found():
    """Probes of a signature don't depend on the number of signatures."""
    assert P.probing(7) == (8, 0) and P.probing(10) == (4, 2) and P.probing(17) == (4, 4)
    assert len(P.masks(16, 2)) == 137 and len(P.masks(16, 4)) == 2517 and len(set(P.masks(16, 3))) == 697


@pytest.mark.parametrize("most", [3, 10])
def test_a_step_looks_at_no_old_pair(spark, most):
    rows = signatures(4, 90)
    batch = spark.createDataFrame(rows[60:] + rows[60:63] + [(5, rows[70][1])], "id long, sig long")
    seen = spark.createDataFrame(rows[:60], "id long, sig long")
    step = incremental.step(batch, seen, most)
    new = [*rows[60:], (5, rows[70][1])]
    old = [r for r in rows[:60] if r[0] != 5]
    found = [tuple(r) for r in step.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(new, new + old, most)
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
