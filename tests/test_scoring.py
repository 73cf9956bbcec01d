import random

import pytest

from sieveline.operators import scoring as R


def iou(a, b):
    w = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return w / (area(a) + area(b) - w + 1e-12)


def greedy(dets, truth, least, inside=lambda b: True):
    out = {}
    for key in {(d[0], d[1]) for d in dets}:
        own, taken = [g for g in truth if (g[0], g[2]) == key], set()
        for d in sorted((d for d in dets if (d[0], d[1]) == key), key=lambda d: (-d[3], d[2])):
            best = sorted((not inside(g[3:]), -iou(d[4:], g[3:]), g[1]) for g in own if g[1] not in taken and iou(d[4:], g[3:]) >= least)
            if best:
                taken.add(best[0][2])
            if best and not best[0][0]:
                out[d[:3]] = 1
            elif not best and inside(d[4:]):
                out[d[:3]] = 0
    return out


def draw(rnd):
    box = lambda: (x := rnd.random() * 0.5, y := rnd.random() * 0.5, x + 0.1 + rnd.random() / 2, y + 0.1 + rnd.random() / 2)
    truth = [(i, k, rnd.randrange(2), *box()) for i in range(25) for k in range(rnd.randrange(7))]
    dets = [(i, rnd.randrange(2), d, rnd.randrange(5) / 5, *box()) for i in range(25) for d in range(rnd.randrange(12))]
    return dets, truth


def frames(spark, dets, truth):
    cols = "x1 double, y1 double, x2 double, y2 double"
    return spark.createDataFrame(dets, f"id long, cls int, det long, conf double, {cols}"), spark.createDataFrame(truth, f"id long, k int, cls int, {cols}")


def test_match(spark):
    dets, truth = draw(random.Random(1))
    d, g = frames(spark, dets, truth)
    got = {(r.id, r.cls, r.det): r.tp for r in R.match(d, g, 0.3).collect()}
    assert got == greedy(dets, truth, 0.3) and sum(got.values()) > 10


def test_match_by_size(spark):
    dets, truth = draw(random.Random(2))
    d, g = frames(spark, dets, truth)
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    got = {(r.id, r.cls, r.det): r.tp for r in R.match_by_size(d, g, 0.05, 0.13, 0.3).collect()}
    assert got == greedy(dets, truth, 0.3, lambda b: 0.05 <= area(b) < 0.13)


def test_average_precision(spark):
    tp = spark.createDataFrame([(1, 0, 1, 0.9, 1), (1, 0, 2, 0.8, 0), (2, 0, 1, 0.7, 1)], "id long, cls int, det long, conf double, tp int")
    pos = spark.createDataFrame([(0, 4.0), (1, 3.0), (2, 0.0)], "cls int, npos double")
    got = {r.cls: r.ap for r in R.average_precision(R.pr_curve(tp, pos), pos).collect()}
    assert abs(got[0] - (26 * 1 + 25 * 2 / 3) / 101) < 1e-12 and got[1] == 0 and got[2] is None
    pos = spark.createDataFrame([(0, 7.0)], "cls int, npos double")
    rec = [1 / 7, 1 / 7, 2 / 7]
    want = sum(next((p for r, p in zip(rec, [1, 2 / 3, 2 / 3]) if r >= k / 100), 0) for k in range(101)) / 101
    assert abs(R.average_precision(R.pr_curve(tp, pos), pos).first().ap - want) < 1e-12


def test_bootstrap_against_brute_force(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from sieveline.operators import bootstrap as P

    rnd = np.random.default_rng(3)
    rows = [(1000 * i + 7, int(rnd.integers(2)), k, float(rnd.integers(9)) / 9, int(rnd.integers(2)), i % 7) for i in range(40) for k in range(3)]
    tp = spark.createDataFrame(rows, "id long, cls int, det long, conf double, tp int, unit long")
    boxes = [(c, u) for c in (0, 1) for u in range(7)] * 5 + [(1, 99)]
    monkeypatch.setattr(P, "STEP", 7)
    monkeypatch.setattr(P, "SIDE", 16)
    reps = 50
    monkeypatch.setattr(P, "BUCKET_UNITS", 3)
    w, at = slow_weights([*range(7), 99], reps, 3, 3), {u: i for i, u in enumerate([*range(7), 99])}
    want = {}
    for rep in range(reps):
        for c in (0, 1):
            npos = sum(w[at[u], rep] for k, u in boxes if k == c)
            if not npos:
                continue
            some = sorted((r for r in rows if r[1] == c and w[at[r[5]], rep]), key=lambda r: (-r[3], r[0], r[2]))
            weight = np.array([w[at[r[5]], rep] for r in some])
            hit = np.cumsum(weight * [r[4] for r in some])
            recall, precision = hit / npos, hit / np.cumsum(weight)
            want[rep, c] = np.mean([max(precision[recall >= k / 100.0], default=0) for k in range(101)])
    got = {(r.rep, r.cls): r.ap for r in P.bootstrap_ap(tp, spark.createDataFrame(boxes, "cls int, unit long"), reps, 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    drawn = P.bootstrap_weights(spark.createDataFrame(boxes, "cls int, unit long"), reps, 3).collect()
    assert {(r.rep, r.unit): r.w for r in drawn} == {(rep, u): w[at[u], rep] for rep in range(reps) for u in at if w[at[u], rep]}
    none = tp.where("false")
    assert P.bootstrap_ap(none, spark.createDataFrame([], "cls int, unit long"), reps).collect() == []
    assert {r.ap for r in P.bootstrap_ap(none, spark.createDataFrame(boxes, "cls int, unit long"), reps).select(F.col("ap")).collect()} == {0.0}


def slow_weights(units, reps, seed, bucket_units):
    """A matrix of weights, draw by draw: each falls into a bucket by its number, and there on a unit."""
    import numpy as np

    from sieveline.operators.bootstrap import PLACE, _draw

    n, count = len(units), max(1, -(-len(units) // bucket_units))
    buckets = {}
    for u in sorted(units):
        buckets.setdefault(_draw(u, 0, 5) % count, []).append(u)
    places = [(b, k) for b in sorted(buckets) for k in range(len(buckets[b]))]
    w = np.zeros((n, reps), int)
    for rep in range(reps):
        had = dict.fromkeys(buckets, 0)
        for t in range(n):
            b, _ = places[(_draw(t, rep, 3 * seed) * (1 << 31) + _draw(t, rep, 3 * seed + 1)) % n]
            own = buckets[b]
            w[units.index(own[_draw((b << PLACE) + had[b], rep, 3 * seed + 2) % len(own)]), rep] += 1
            had[b] += 1
    return w


@pytest.mark.parametrize("replicates", [1000, 2000])
def test_n_of_n_are_drawn(spark, replicates):
    """The replicates of the queries over groups and items: each sums up to n, and weights are multinomial."""
    import numpy as np

    from sieveline.operators import bootstrap as P

    n = 1500
    units = spark.range(n).selectExpr("id * 3 AS unit")
    table = P.weight_table(units.unionAll(units), replicates).collect()
    w = np.zeros((n, -(-replicates // P.SIDE) * P.SIDE))
    for r in table:
        w[r.unit // 3, r.block * P.SIDE : (r.block + 1) * P.SIDE] = P.weights_of([r.w])[0]
    assert not w[:, replicates:].any()
    w = w[:, :replicates]
    assert (w.sum(axis=0) == n).all()
    assert abs(w.var() - (1 - 1 / n)) < 0.02 and abs((w == 0).mean() - (1 - 1 / n) ** n) < 0.01
    for m in (w[:, :60], w[:60].T):  # replicates, and units, are as good as independent
        c = np.corrcoef(m.T)
        assert np.abs(c[~np.eye(len(c), dtype=bool)]).max() < 6 / np.sqrt(len(m))
    other = {(r.unit, r.block): r.w for r in P.weight_table(units, replicates, 1).collect()}
    assert any(other[r.unit, r.block] != r.w for r in table)
    again = {(r.unit, r.block): r.w for r in P.weight_table(units.repartition(5), replicates).collect()}
    assert again == {(r.unit, r.block): r.w for r in table}


def test_order(spark):
    from sieveline.operators import order as O

    rnd = random.Random(5)
    rows = [(i, rnd.randrange(4)) for i in rnd.sample(range(10**6), 300)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(5)
    got = {r.id: r.rank for r in O.ranked(df, "v", "id").collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    after = dict(zip((ids := sorted(i for i, _ in rows)), ids[1:]))
    v = dict(rows)
    assert {r.id: r.next_v for r in O.with_next(df, "id", "v").collect()} == {i: v.get(after.get(i)) for i in ids}
    assert O.ranked(df.limit(0), "id").collect() == [] and O.with_next(df.limit(0), "id", "v").collect() == []


def test_best_halves_against_brute_force(spark):
    from pyspark.sql import functions as F

    from sieveline.operators import splits as S

    rnd = random.Random(9)
    rows = [(i, rnd.randrange(3), rnd.randrange(1, 6), rnd.randrange(9)) for i in range(23)]
    df = spark.createDataFrame(rows, "id long, res long, twins long, boxes long")
    tries = 40
    keys = {(r.draw, r.id): r.k for r in spark.range(tries).select(F.col("id").cast("int").alias("draw")).crossJoin(df).select("draw", "id", S.half_key(F.col("draw"), 4).alias("k")).collect()}
    best = None
    for draw in range(tries):
        side, turn = {}, 0
        for res in range(3):
            own = sorted((r for r in rows if r[1] == res), key=lambda r: (keys[draw, r[0]], r[0]))
            n = len(own) // 2 + (len(own) % 2) * ((draw + turn) % 2)
            turn += len(own) % 2
            side |= {r[0]: 1 if k < n else -1 for k, r in enumerate(own)}
        cost = 10 * abs(sum(side[r[0]] * r[2] for r in rows)) + abs(sum(side[r[0]] * r[3] for r in rows)) + 5 * abs(sum(side.values()))
        if best is None or cost < best[0]:
            best = cost, side
    assert {r.id: r.half for r in S.best_halves(df, tries, 4).collect()} == {i: "A" if s > 0 else "B" for i, s in best[1].items()}
    assert S.best_halves(df.limit(0), tries).collect() == []


def test_deal_finds_the_cheapest_place():
    import numpy as np

    from sieveline.operators.splits import _Deal

    rng = np.random.default_rng(2)
    f, n = rng.integers(1, 9, (12, 3)).astype(float), rng.integers(1, 30, 12)
    unit, target = rng.random(3), np.array([0.7, 0.15, 0.15])[:, None] * (n @ f)
    state, slow = _Deal(f, unit, target), -target.copy()
    for kind in range(12):
        state.place(kind, int(n[kind]))
        for _ in range(n[kind]):  # one group after the other
            slow[np.argmin(((slow + f[kind]) ** 2 * unit).sum(axis=1) - (slow**2 * unit).sum(axis=1))] += f[kind]
        assert np.isclose((unit * slow**2).sum(), state.cost()) and (state.n[kind].sum(), (state.n[kind] < 0).sum()) == (n[kind], 0)
    before = state.cost()
    assert sum(state.improve(k) for k in range(12)) >= 0 and state.cost() <= before and (state.n.sum(axis=1) == n).all()
