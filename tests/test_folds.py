"""Stratified folds of whole groups, and the design over searched halves."""

import random
from collections import Counter

import pytest

from sieveline.operators import splits as S
from sieveline.operators.probe import folded, source_recalls


@pytest.mark.parametrize("slice_groups", [20_000, 60])
def test_folds(spark, slice_groups):
    r = random.Random(1)
    groups = [(g, r.randrange(1, 9), r.choice((0, 0, 0, 1, 2))) for g in range(240)]
    rows = [(i, g, res if r.random() < 0.9 else 3) for g, n, res in groups for i in range(n)]
    items = spark.createDataFrame([(k, g, res) for k, (_, g, res) in enumerate(rows)], "id long, grp long, res int").repartition(3)
    got = folded(items, 5, slice_groups=slice_groups).collect()
    assert len(got) == len(rows)
    homes = {}
    for x in got:
        homes.setdefault(x.grp, set()).add(x.fold)
    assert all(len(f) == 1 for f in homes.values())
    whole, by = Counter(x.res for x in got), Counter((x.fold, x.res) for x in got)
    for res, n in whole.items():
        shares = [by[f, res] / n for f in range(5)]
        assert max(shares) - min(shares) < (0.08 if slice_groups > 100 else 0.2)
    again = folded(items.repartition(7), 5, slice_groups=slice_groups).collect()
    assert {(x.id, x.fold) for x in again} == {(x.id, x.fold) for x in got}


def test_recalls(spark):
    rows = [(i, i // 4, [float(i % 2) * 4 + (i * 37 % 11) / 11, (i * 13 % 7) / 7], i % 2) for i in range(120)] + [(900, 1, None, 1)]
    got = source_recalls(spark.createDataFrame(rows, "id long, grp long, v array<double>, res int"), parts=3).collect()
    assert sorted((x.res, x.n) for x in got) == [(0, 60), (1, 60)] and all(x.recall > 0.95 for x in got)


def test_design_over_searched_halves(spark):
    """Anchors and twins stand in the half that the search gave their anchor."""
    arms = spark.createDataFrame([(1, 10, "anchor", 0, "A"), (2, 10, "twin", 0, "A"), (3, 20, "anchor", 0, "A"), (4, 20, "twin", 0, "A"), (5, 30, "placebo", 0, None)], "id long, grp long, role string, res int, half string")
    halves = S.best_halves(spark.createDataFrame([(1, 0, 1, 2), (3, 0, 1, 2)], "id long, res int, twins int, boxes int"), tries=4)
    half = {x.id: x.half for x in halves.collect()}
    assert sorted(half.values()) == ["A", "B"]
    got = {x.id: x.half for x in S.with_halves(arms, halves).collect()}
    assert got == {1: half[1], 2: half[1], 3: half[3], 4: half[3], 5: None}
