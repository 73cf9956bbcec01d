import random

from sieveline.operators.graph import connected_components


def brute(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)]
    pairs += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000), (5000, -7)]
    for small in (0, 1000):
        rows = connected_components(spark.createDataFrame(pairs + [(None, 4)], "src long, dst long"), small=small).collect()
        assert {r.node: r.component for r in rows} == brute(pairs)
        assert len(rows) == len(brute(pairs))


def test_names_of_bytes(spark):
    """Nodes that are binary: compared byte by byte, in rounds and in one task."""
    rnd = random.Random(4)
    pairs = [(bytes([rnd.randrange(256)]), bytes([rnd.randrange(256), 0])) for _ in range(150)]
    edges = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in pairs], "src binary, dst binary")
    for small in (0, 1000):
        assert {bytes(r.node): bytes(r.component) for r in connected_components(edges, small=small).collect()} == brute(pairs)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
