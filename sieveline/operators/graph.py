"""Graph operators over edge tables: components, degree, common neighbours, capped union."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.storage import cut, drop


#: Different edges up to which one task finds the components, instead of rounds of jobs.
SMALL = 1 << 16


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of a partition, each named by its smallest node."""
    up: dict = {}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = top(up.setdefault(u, u)), top(up.setdefault(v, v))
            up[max(u, v)] = min(u, v)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([top(x) for x in up], kind)], names=["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", small: int = SMALL) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is its smallest node.

    Alternating large-star and small-star rounds, about log(n) of them. Each round is two
    aggregations with map-side combine and two joins, so a hub with millions of edges never
    meets in one task (the joins are plain equi-joins that adaptive execution can split).
    A graph of up to ``small`` edges is walked in one task, with the same result.
    Rows with a null end are ignored; a self-loop makes its node a component of one.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    ends = cut(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    kind = dict(ends.dtypes)["u"]
    if kind in ("bigint", "int", "binary") and ends.count() <= small:
        return ends.repartition(1).mapInArrow(_walked, f"node {kind}, component {kind}")
    links, seen = ends.where("u <> v"), None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # Larger neighbours go to the smallest one; the smallest one is linked by the other side.
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, links = links, cut(small.union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        if seen is not None:  # the first round reads the edges' own table, which is needed at the end
            drop(before)
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == seen:
            break
        seen = (now["n"], now["h"])
    nodes = ends.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    at = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(at, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
