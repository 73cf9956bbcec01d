"""Queries that SQL can't express, as a whole, against plain Python over the tables."""

from collections import Counter

import pytest

from sieveline import registry
from sieveline.plans import fixtures as X
from tests.test_scoring import greedy


@pytest.fixture(scope="module")
def tables(spark, sf):
    dets = [(r.id, r.cls, r.det, r.conf, r.x1, r.y1, r.x2, r.y2) for r in X.detections(spark, sf).collect()]
    truth = [(r.id, r.k, r.cls, r.x1, r.y1, r.x2, r.y2) for r in X.truth(spark, sf).collect()]
    return dets, truth


def by_item(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def flags(tables, least, inside=lambda b: True):
    dets, truth = map(by_item, tables)
    return {k: v for i, own in dets.items() for k, v in greedy(own, truth.get(i, []), least, inside).items()}


def ap(rows, npos):
    """rows: (conf, id, det, tp)."""
    hit, points = 0, []
    for n, (_, _, _, tp) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1], r[2])), 1):
        hit += tp
        points.append((hit / npos, hit / n))
    best, out, k = 0.0, 0.0, 100
    for recall, precision in reversed(points):
        while k >= 0 and recall < k / 100:
            out, k = out + best, k - 1
        best = max(best, precision)
    return (out + best * (k + 1)) / 101


def test_ap_by_hand():
    rows = [(0.9, 1, 1, 1), (0.8, 1, 2, 0), (0.7, 2, 1, 1)]
    want = sum(max((p for r, p in ((0.25, 1), (0.25, 0.5), (0.5, 2 / 3)) if r >= k / 100), default=0) for k in range(101)) / 101
    assert abs(ap(rows, 4) - want) < 1e-12


def test_match_summary(spark, sf, tables):
    found, conf = flags(tables, 0.55), {d[:3]: d[3] for d in tables[0]}
    npos = Counter(t[2] for t in tables[1])
    got = {r.cls: r for r in registry.QUERIES["match_summary"](spark, sf).collect()}
    assert got.keys() == npos.keys()
    for c, r in got.items():
        own = [(conf[k], k[0], k[2], v) for k, v in found.items() if k[1] == c]
        assert (r.n_tp, r.n_det, r.npos) == (sum(x[3] for x in own), len(own), npos[c]) and abs(r.ap - ap(own, npos[c])) < 1e-12


def test_ap_by_size(spark, sf, tables):
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    conf = {d[:3]: d[3] for d in tables[0]}
    got = {(r["size"], r.cls): r for r in registry.QUERIES["ap_by_size"](spark, sf).collect()}
    seen = 0
    for name, low, high in (("small", 0.0, 0.0025), ("medium", 0.0025, 0.0225), ("large", 0.0225, 1e9)):
        inside = lambda b, low=low, high=high: low <= area(b) < high
        found = flags(tables, 0.55, inside)
        for c, n in Counter(t[2] for t in tables[1] if inside(t[3:])).items():
            own = [(conf[k], k[0], k[2], v) for k, v in found.items() if k[1] == c]
            assert got[name, c].npos == n and abs(got[name, c].ap - ap(own, n)) < 1e-12
            seen += 1
    assert seen == len(got) > 5


def test_match_detections(spark, sf, tables):
    assert {(r.id, r.cls, r.det): r.tp for r in registry.QUERIES["match_detections"](spark, sf).collect()} == flags(tables, 0.55)


def test_splits_keep_groups_whole_and_come_near_their_shares(spark, sf):
    from pyspark.sql import functions as F

    from sieveline.plans.leakage import core_groups

    rows = X.items(spark, sf).where("labeled").select("id", "res").join(core_groups(spark, sf)[0], "id")
    n = rows.count()
    # Without moves a split is as near as dealing whole groups out brings it.
    for name, near in (("balanced_group_split", 0.01), ("fast_group_split", 0.03)):
        split = registry.QUERIES[name](spark, sf)
        size = {r.split: r["count"] for r in rows.join(split, "grp").groupBy("split").count().collect()}
        assert sum(size.values()) == n and split.count() == split.select("grp").distinct().count()
        assert all(abs(size[s] / n - share) < near for s, share in (("train", 0.7), ("val", 0.15), ("test", 0.15)))
    assert registry.QUERIES["capped_counts"](spark, sf).select(F.col("merged") + F.col("refused")).first()[0] >= 0


def test_source_probe(spark):
    from sieveline.operators.probe import source_probe

    rows = [(i, i // 2, [float(i % 3 == k) * 3 + (i * 37 % 11) / 11 for k in range(3)] + [(i * 13 % 7) / 7], i % 3) for i in range(300)] + [(900, 1, None, 1), (901, 2, [1.0] * 4, None)]
    df = spark.createDataFrame([(i, i // 6, v, r) for i, _, v, r in rows], "id long, grp long, v array<double>, res int")
    got = source_probe(df, parts=3, components=3).collect()
    assert sum(r.n for r in got) == 300 and all(r.accuracy > 0.95 for r in got)
    assert source_probe(df.limit(0)).collect() == []
