"""PartEnum set joins against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import setjoin

DOCS = "doc_id long, text string, s string, n int, check string, signatures string, root int, component string"


def slow_components(docs, percent=90, shingle=3):
    """(doc_id, n_shingles, component_id) of each row, by comparing all pairs of different sets."""
    sets = []
    for _, text, *_ in docs:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
        sets.append(frozenset(" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset())
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[top(i)] = top(j)
    out = []
    for i, (doc_id, *_) in enumerate(docs):
        ids = [d[0] for k, d in enumerate(docs) if top(k) == top(i) and d[0] is not None]
        out.append((doc_id, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc_id))
    return sorted(out, key=repr)


def edited(r, words, share):
    """words with about a share of them replaced, at most."""
    words = list(words)
    for _ in range(r.randrange(int(len(words) * share) + 2)):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return words


def random_docs(seed, n=150):
    r = random.Random(seed)
    bases = [[f"w{r.randrange(5000)}" for _ in range(r.choice((1, 2, 3, 12, 30, 120, 400)))] for _ in range(8)]
    docs = [(r.choice((None, *range(1000))), None if r.random() < 0.03 else r.choice(("", " \n")) if r.random() < 0.05 else " ".join(edited(r, r.choice(bases), 0.05)).replace("w1", r.choice(("w1", "W1"))), "s", 1, "c", "x", 2, "y") for _ in range(n)]
    return docs + docs[: n // 5]


@pytest.mark.parametrize("seed,percent", [(0, 90), (1, 90), (2, 80), (3, 97), (4, 100)])
def test_components_against_all_pairs(spark, seed, percent):
    docs = random_docs(seed)
    found = setjoin.jaccard_components(spark.createDataFrame(docs, DOCS).repartition(3), percent)
    assert sorted(map(tuple, found.collect()), key=repr) == slow_components(docs, percent)
    assert found.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]


def test_empty_and_all_alike(spark):
    assert setjoin.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    docs = [(i or None, t, "", 0, "", "", 0, "") for i, t in enumerate((None, "", "a", "A", "a b", "long " * 50_000))]
    assert sorted(map(tuple, setjoin.jaccard_components(spark.createDataFrame(docs, DOCS)).collect()), key=repr) == slow_components(docs)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 900), st.integers(0, 400), st.integers(0, 400), st.sampled_from((50, 80, 90, 95, 100)), st.integers(0, 1 << 30))
def test_similar_sets_share_a_signature(common, left, right, percent, seed):
    """And sketches never rule them out."""
    share = min(left + right, common * (100 - percent) // percent)  # so many elements may differ
    left = left * share // max(1, left + right)
    right = share - left
    all_of = np.unique(np.random.default_rng(seed).integers(0, 1 << 63, common + left + right, dtype=np.uint64))
    if len(all_of) < common + left + right:
        return
    mixed = np.random.default_rng(seed + 1).permutation(all_of)
    a, b = np.sort(mixed[: common + left]), np.sort(np.concatenate([mixed[:common], mixed[common + left :]]))
    assert 100 * common >= percent * (common + left + right)
    assert set(setjoin.signatures(a, percent).tolist()) & set(setjoin.signatures(b, percent).tolist())
    n = np.array([len(a), len(b)])
    sketches = setjoin.Sketches(pa.array([setjoin.sketch(a), setjoin.sketch(b)]))
    assert sketches.bits(np.array([0]), np.array([1]))[0] <= left + right
    assert len(setjoin.likely(n, sketches, np.array([0]), np.array([1]), percent)[0]) == 1


def test_bands_hold_similar_sizes():
    for percent in (1, 50, 90, 99, 100):
        of = [setjoin.band(n, percent) for n in range(1, 3000)]
        assert of == sorted(of) and of[0] == 0
        for n in range(1, 3000):
            most = min(2999, 100 * n // percent)
            assert of[most - 1] - of[n - 1] <= 1


def test_tiles_give_what_a_group_gives(spark):
    """Cut into tiles or not, with many roots, each pair that may be similar comes once, best ones for each two roots."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    sets = {}
    for i in range(200):
        g = setjoin.shingle_set(" ".join(edited(r, base, 0.04)), 3)
        sets[i] = g
    rows = spark.createDataFrame([(i, len(g), bytearray(setjoin.sketch(g))) for i, g in sets.items()], "s long, n long, sketch binary")
    posts = spark.createDataFrame([(g, i) for i in sets for g in (1, 2 + i % 2)], "group long, s long")
    root = spark.createDataFrame([(i, i % 7) for i in range(200)], "q long, root long")
    n, k = np.array([len(g) for g in sets.values()]), setjoin.Sketches(pa.array([*map(setjoin.sketch, sets.values())]))
    i, j = np.triu_indices(200, 1)
    take = i % 7 != j % 7
    i, j = i[take], j[take]
    keep, _ = setjoin.likely(n, k, i, j, 90)
    want = set(zip(i[keep].tolist(), j[keep].tolist()))
    assert 100 < len(want) < len(i)
    for tile in (16, 70, 2048):
        assert {tuple(p) for p in setjoin.cross_pairs(posts, root, rows, 90, False, tile).collect()} == want
        best = {tuple(p) for p in setjoin.cross_pairs(posts, root, rows, 90, True, tile).collect()}
        assert best <= want
        assert {frozenset((a % 7, b % 7)) for a, b in best} == {frozenset((a % 7, b % 7)) for a, b in want}
    assert len(best) < len(want)
