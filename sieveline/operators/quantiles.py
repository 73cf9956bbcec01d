"""Exact quantiles of whole tables and large groups, without a task that holds all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.storage import cut

#: Cells that a group's values are cut into at a time, and the accuracy of their bounds.
CELLS, ACCURACY = 64, 1000
#: Different values of a group that one task orders, at most.
FEW = 1 << 20


def quantiles(rows: DataFrame, value: str, probs: list[float], *groups: str, few: int = FEW) -> DataFrame:
    """(*groups, p, q): the quantiles of a column by group, interpolated as ``percentile`` does; nulls don't count.

    Selection: a group's values are cut into cells by approximate bounds, the cells' exact counts are summed up
    along their order, and only cells in which a wanted position falls are kept, until a group has ``few``
    different values left, which a task orders. All quantiles of all groups go through the same passes; sums and
    sketches are combined before the shuffle, so a group may be of any size. Null groups are groups.
    """
    if few < 2:
        raise ValueError("a task orders two values at least")  # as many as a position between values needs
    names = [f"g{i}" for i in range(max(1, len(groups)))]
    columns = [F.col(g).alias(n) for g, n in zip(groups, names)] or [F.lit(0).alias("g0")]
    own = cut(rows.select(*columns, F.col(value).cast("double").alias("x")).where("x is not null"))
    counts = own.groupBy(*names).agg(F.count("*").alias("n"))
    place = F.col("p") * (F.col("n") - 1)
    want = counts.select(*names, "n", F.posexplode(F.array(*map(F.lit, map(float, probs)))).alias("j", "p"))
    want = cut(want.select(*names, "j", "p", "n", F.floor(place).cast("long").alias("k"), (place - F.floor(place)).alias("part")))
    live, keys = own.select(*names, F.explode(F.array(*map(F.lit, range(len(probs))))).alias("j"), "x", F.lit(1).cast("long").alias("c")), [*names, "j"]

    def same(table, *more):
        """live joined with a table by group and quantile."""
        other = table.select(*(F.col(k).alias(f"_{k}") for k in keys), *more)
        return lambda left: left.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*(f"_{k}" for k in keys))

    most = want.agg(F.max("n")).first()[0] or 0
    while most > few:
        grid = live.groupBy(*keys).agg(F.percentile_approx("x", [i / CELLS for i in range(CELLS + 1)], ACCURACY).alias("grid"))
        celled = same(grid, "grid")(live).select(*keys, "x", "c", F.size(F.filter("grid", lambda g: g < F.col("x"))).alias("cell"))
        sums = celled.groupBy(*keys, "cell").agg(F.sum("c").alias("m"))
        by_cell = Window.partitionBy(*keys).orderBy("cell")
        sums = same(want, "k", "part")(sums.withColumn("end", F.sum("m").over(by_cell))).withColumn("start", F.col("end") - F.col("m"))
        last = F.col("k") + (F.col("part") > 0).cast("long")
        kept = cut(sums.where((F.col("start") <= last) & (F.col("end") > F.col("k"))).select(*keys, F.col("cell").alias("__cell"), "start"))
        live = cut(same(kept, "__cell")(celled).where(F.col("cell") == F.col("__cell")).groupBy(*keys, "x").agg(F.sum("c").alias("c")))
        before = kept.groupBy(*keys).agg(F.min("start").alias("before"))
        want = cut(same(before, "before")(want).withColumn("k", F.col("k") - F.col("before")).drop("before"))
        most = live.groupBy(*keys).count().agg(F.max("count")).first()[0]
    ordered = same(want, "p", "k", "part")(live.withColumn("end", F.sum("c").over(Window.partitionBy(*keys).orderBy("x"))))
    found = ordered.groupBy(*keys, "p", "part").agg(F.min(F.when(F.col("end") > F.col("k"), F.col("x"))).alias("low"), F.min(F.when(F.col("end") > F.col("k") + 1, F.col("x"))).alias("high"))
    q = F.when(F.col("part") > 0, F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).otherwise(F.col("low"))
    return found.select(*(F.col(n).alias(g) for g, n in zip(groups, names)), "p", q.alias("q"))
