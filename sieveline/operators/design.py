"""Crossover designs: trimming, removal, arms, direct edges, and the figures of what was built."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.order import ranked
from sieveline.operators.pairs import both_ways
from sieveline.operators.splits import shuffled


def twin_pairs(arms: DataFrame) -> DataFrame:
    """(a, b), a < b: each twin of arms (id, grp, role) with its own group's anchor."""
    of = lambda role, name: arms.where(F.col("role") == role).select("grp", F.col("id").alias(name))
    return of("twin", "twin").join(of("anchor", "anchor"), "grp").select(F.least("twin", "anchor").alias("a"), F.greatest("twin", "anchor").alias("b"))


def direct_twins(arms: DataFrame, edges: DataFrame) -> DataFrame:
    """(grp, anchor, n_twins, n_direct) of arms (id, grp, role): twins with an edge to the anchor of their own
    group. n_direct is 0 for anchors that no edge links to any of their twins."""
    anchors = arms.where("role = 'anchor'").select("grp", F.col("id").alias("anchor"))
    met = arms.where("role = 'twin'").select("grp", F.col("id").alias("twin")).join(anchors, "grp")
    ends = both_ways(edges).select(F.col("a").alias("anchor"), F.col("b").alias("twin"), F.lit(1).alias("direct"))
    per = met.join(ends, ["anchor", "twin"], "left").groupBy("anchor").agg(F.count("*").alias("n_twins"), F.count("direct").alias("n_direct"))
    return anchors.join(per, "anchor", "left").select("grp", "anchor", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_twins", "n_direct")))


def trimmed(twins: DataFrame, seed: int = 0) -> DataFrame:
    """(id, half) of twins (id, half): of both halves as many as the smaller has, by hash order."""
    n = twins.groupBy("half").agg(F.count("*").alias("n"))
    k = n.agg(F.when(F.count("*") == 2, F.min("n")).otherwise(0).alias("k"))
    before = n.select("half", F.coalesce(F.sum("n").over(Window.orderBy("half").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = ranked(twins.select("id", "half", shuffled(seed, F.col("id")).alias("key")), "half", "key", "id").join(before, "half")
    return placed.crossJoin(F.broadcast(k)).where(F.col("rank") - F.col("before") <= F.col("k")).select("id", "half")


def removed(train: DataFrame, k: DataFrame, seed: int = 0) -> DataFrame:
    """Ids of as many train items, by hash order, as the one row k says: they make room for the twins."""
    placed = ranked(train.select("id", shuffled(f"{seed}r", F.col("id")).alias("key")), "key", "id")
    return placed.crossJoin(F.broadcast(k)).where(F.col("rank") <= F.col("k")).select("id")


def crossover(arms: DataFrame, train: DataFrame, seed: int = 0) -> DataFrame:
    """(set, id): what a crossover design is made of. arms: id, role, half of the held-out items.

    anchors_A, anchors_B; twins_A and twins_B, equally many; removed: so many train items; base: train less
    these; train_A and train_B: base with one half's twins; placebo: held-out items of no other role.
    """
    twins = trimmed(arms.where("role = 'twin'").select("id", "half"), seed)
    out = removed(train, twins.where("half = 'A'").agg(F.count("*").alias("k")), seed)
    base = train.select("id").join(out, "id", "left_anti")
    sets = {"removed": out, "base": base, "placebo": arms.where("role = 'placebo'")}
    for half in ("A", "B"):
        own = twins.where(F.col("half") == half)
        sets |= {f"anchors_{half}": arms.where((F.col("role") == "anchor") & (F.col("half") == half)), f"twins_{half}": own, f"train_{half}": base.select("id").unionAll(own.select("id"))}
    rows = [df.select(F.lit(name).alias("set"), "id") for name, df in sets.items()]
    return rows[0] if len(rows) == 1 else _union(rows)


def single_control(arms: DataFrame, pool: DataFrame, seed: int = 0) -> DataFrame:
    """(arm, id) of the design with one control: of each anchor's twins the first by hash order; and controls
    from the pool (id, res), of each source as many, what a source lacks topped up from the rest."""
    from sieveline.operators.splits import stratified_fill

    order = Window.partitionBy("grp").orderBy(shuffled(seed, F.col("id")), "id")
    twins = arms.where("role = 'twin'").withColumn("k", F.row_number().over(order)).where("k = 1")
    control = stratified_fill(pool, twins.groupBy("res").agg(F.count("*").alias("n")), "res", seed)
    return _union([twins.select(F.lit("twin").alias("arm"), "id"), control.select(F.lit("control").alias("arm"), "id")])


def crossed(halves: DataFrame, twin_a: DataFrame, twin_b: DataFrame, base: DataFrame) -> DataFrame:
    """Rows of the three models on the anchors (id, half), with arm and half: leaked takes each half from the
    model that was trained on its twins, unleaked from the other one, base all from the base model."""
    of = lambda df, half: df.join(halves.where(F.col("half") == half), "id")
    arm = lambda name, df: df.withColumn("arm", F.lit(name))
    return _union([arm("leaked", of(twin_a, "A")), arm("leaked", of(twin_b, "B")), arm("unleaked", of(twin_b, "A")), arm("unleaked", of(twin_a, "B")), arm("base", base.join(halves, "id"))])


def _union(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df)
    return out
