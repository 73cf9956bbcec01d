from collections import Counter, defaultdict
from fractions import Fraction

import duckdb

from sieveline.llm import mixing
from sieveline.llm.queries import QUERIES


def fill(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), set()
    while True:
        left = Fraction(total - sum(most * sizes[s] for s in fixed))
        share = sum(w[s] for s in order if s not in fixed)
        goal = {s: Fraction(most * sizes[s]) if s in fixed else left * w[s] / share for s in order}
        over = {s for s in order if goal[s] > most * sizes[s]}
        if not over:
            return goal
        fixed |= over


def check(rows, got, near=True):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    goal, taken, largest = fill(sizes), Counter(), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, goal[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 1.5 * largest[s] + 1e-6 * sizes[s]
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len((t or "").split())) for i, t, s in rows)


def test_small(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 5}") for i in range(400)] + [(900 + i, "x y", "tiny") for i in range(3)]
    rows += [(i, "a b", "hot") for i in range(2000, 2600)] + [(2000, "a b", "hot"), (None, "q", None), (None, None, None), (7, "", "empty"), (8, "z " * 50_000, "é")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(docs, bucket_rows=50).collect()
    check(rows, got)
    again = mixing.mix(docs.repartition(7), bucket_rows=50).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert mixing.mix(docs.limit(0)).collect() == []
    assert {r.copies for r in mixing.mix(docs.where("source = 'empty'")).collect()} <= {0, 1, 2, 3}


def test_single_source_is_taken_once(spark):
    docs = spark.createDataFrame([(i, "w " * i, "s") for i in range(50)], "doc_id long, text string, source string")
    assert {r.copies for r in mixing.mix(docs).collect()} == {1}


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    want = sorted(con.execute(f"select {', '.join(cols)} from ({mixing.SQL})").fetchall())
    assert sorted(map(tuple, QUERIES["op3_mix"](spark, sf).select(cols).collect())) == want
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], mixing.mix(docs).collect())
