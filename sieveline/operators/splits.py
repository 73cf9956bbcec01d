"""Splits: random by hash order, balanced over groups, their balance and cost; injection designs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.order import ranked
from sieveline.storage import cut

NAMES = ("train", "val", "test")
SHARES = (0.70, 0.15, 0.15)


def shuffled(seed: int | str, key: Column) -> Column:
    """A value to order by: a permutation that any engine with md5 can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")).cast("binary"))


def random_split(items: DataFrame, seed: int = 0, second: float | None = None) -> DataFrame:
    """(id, split): 70/15/15 of the items in the order of their hashes. With ``second`` the validation part ends
    at that share of all items, rounded, instead of being a rounded 15 % itself.

    Ranks are not taken in one task: the order is cut at its quarters of 4,096 hash ranges, counts
    of the ranges are summed up, and a range's own rows are ranked within it.
    """
    keyed = items.select("id", shuffled(seed, F.col("id")).alias("key")).withColumn("range", F.substring("key", 1, 3))
    counts = keyed.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("all"))
    ranked = keyed.join(starts, "range").withColumn("rank", F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy("key", "id")))
    train, val = (F.bround(F.col("all") * F.lit(s)) for s in SHARES[:2])
    end = train + val if second is None else F.bround(F.col("all") * F.lit(second))
    return ranked.select("id", F.when(F.col("rank") <= train, "train").when(F.col("rank") <= end, "val").otherwise("test").alias("split"))


def features(items: DataFrame, sources: list[int], classes: list[str] = ()) -> DataFrame:
    """Per group: the number of items, of items by source, and the sums of count columns."""
    one_hot = [F.sum((F.col("res") == r).cast("double")).alias(f"res_{r}") for r in sources]
    return items.groupBy("grp").agg(F.count("*").cast("double").alias("n"), *one_hot, *(F.sum(c).cast("double").alias(c) for c in classes))


def split_cost(by_split: DataFrame, columns: list[str], first_weight: float = 4.0) -> DataFrame:
    """One row with cost: squared deviations of each split's sums from its share of the whole, relative
    to the whole; the first column (the number of items) weighs more. by_split: split and columns."""
    share = F.when(F.col("split") == "train", SHARES[0]).otherwise(SHARES[1])
    tot = {c: F.sum(c).over(Window.partitionBy()) for c in columns}
    terms = [F.pow((F.col(c) - share * tot[c]) / F.greatest(tot[c], F.lit(1.0)), F.lit(2.0)) * F.lit(first_weight if i == 0 else 1.0) for i, c in enumerate(columns)]
    return by_split.select(sum(terms[1:], start=terms[0]).alias("term")).agg(F.sum("term").alias("cost"))


def balanced_split(items: DataFrame, sources: list[int], classes: list[str] = (), restarts: int = 300, sweeps: int = 3, seed: int = 0) -> DataFrame:
    """(grp, split): whole groups dealt to train, val and test so that items, sources and counts come near
    their shares, the number of items weighing four times. The best of ``restarts`` is kept, which run in
    parallel.

    Groups with equal features are interchangeable, so a restart knows only kinds: one row for each
    distinct feature vector, with its number of groups. It deals kinds out in a noisy order by size,
    a kind's groups one split at a time as long as that split gains most, then moves groups between
    splits while the cost falls (sweeps=0: no moves). The groups of a kind are dealt out by hash order
    at the end. What a task holds is kinds, whatever the number of groups.
    """
    per_group = features(items, sources, classes)
    columns = [c for c in per_group.columns if c != "grp"]
    kinds = cut(per_group.groupBy(*columns).agg(F.count("*").alias("groups")).withColumn("kind", F.xxhash64(*columns)))
    runs = kinds.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(restarts - 1).cast("long"))).alias("restart"))

    def deal(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("kind").reset_index(drop=True)
        rng = np.random.default_rng([seed, int(pdf.restart[0])])
        f, left = pdf[columns].to_numpy(float), pdf.groups.to_numpy(np.int64)
        whole = left @ f
        unit = np.append(4.0, np.ones(len(columns) - 1)) / np.maximum(whole, 1) ** 2
        state = _Deal(f, unit, np.array(SHARES)[:, None] * whole)
        for kind in np.argsort(-f[:, 0] * np.exp(rng.normal(0, 0.3, len(f))), kind="stable"):
            state.place(kind, int(left[kind]))
        for _ in range(sweeps):
            if not sum(state.improve(kind) for kind in rng.permutation(len(f))):
                break
        return pd.DataFrame({"restart": pdf.restart, "cost": state.cost(), "kind": pdf.kind, "train": state.n[:, 0], "val": state.n[:, 1]})

    found = runs.groupBy("restart").applyInPandas(deal, "restart long, cost double, kind long, train long, val long")
    best = found.groupBy("kind").agg(F.min_by(F.struct("train", "val"), F.struct("cost", "restart")).alias("n"))
    keyed = per_group.select("grp", F.xxhash64(*columns).alias("kind"), shuffled(seed, F.col("grp")).alias("key"))
    sizes = kinds.select("kind", F.coalesce(F.sum("groups").over(Window.orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    dealt = ranked(keyed, "kind", "key", "grp").join(sizes, "kind").withColumn("rank", F.col("rank") - F.col("before")).join(best, "kind")
    return dealt.select("grp", F.when(F.col("rank") <= F.col("n.train"), "train").when(F.col("rank") <= F.col("n.train") + F.col("n.val"), "val").otherwise("test").alias("split"))


class _Deal:
    """Numbers of groups of each kind in three splits, and how far the splits' sums are from their targets."""

    def __init__(self, f, unit, target):
        import numpy as np

        self.f, self.unit, self.off, self.n = f, unit, -target, np.zeros((len(f), len(target)), np.int64)
        self.own = (unit * f * f).sum(axis=1)  # what a group's own square adds, by kind

    def cost(self) -> float:
        return float((self.unit * self.off**2).sum())

    def slope(self, kind: int):
        """By split: half the change of its cost for a group more of the kind, without the group's own square."""
        return self.off @ (self.unit * self.f[kind])

    def add(self, kind: int, split: int, k: int) -> None:
        self.n[kind, split] += k
        self.off[split] += k * self.f[kind]

    def place(self, kind: int, k: int) -> None:
        """Deal k groups, each where the cost grows least. A split's slope rises by the same step with each
        group, so a run of groups goes to one split at once, up to where the next split is as good."""
        own = self.own[kind]
        while k:
            slope = self.slope(kind)
            first, second = sorted(range(len(slope)), key=lambda s: slope[s])[:2]
            run = k if own == 0 else min(k, int((slope[second] - slope[first]) / own) + 1)
            self.add(kind, first, run)
            k -= run

    def improve(self, kind: int) -> int:
        """Move groups of the kind between splits while that lowers the cost; the number of groups moved."""
        moved = 0
        for source in range(self.n.shape[1]):
            for target in range(self.n.shape[1]):
                # k groups change the cost by 2 k (slope there - slope here) + 2 k^2 own: the lowest point, whole.
                slope, own = self.slope(kind), self.own[kind]
                if source == target or own == 0:
                    continue
                k = min(int(self.n[kind, source]), round((slope[source] - slope[target]) / (2 * own)))
                if k > 0 and 2 * k * (slope[target] - slope[source]) + 2 * k * k * own < -1e-12:
                    self.add(kind, source, -k)
                    self.add(kind, target, k)
                    moved += k
        return moved


def balance(items: DataFrame) -> DataFrame:
    """Per split of (id, res, grp, split): items, their share, and the number of groups."""
    n = items.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("grp").alias("n_groups"))
    return n.select("split", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("share"), "n_groups")


def balance_report(items: DataFrame, by: list[str]) -> DataFrame:
    """Per (kind, split) of items (id, res, grp, boxes, c0): items and their share of the kind's, boxes, the share of
    one class among them, the share of a source among the items, and groups."""
    n = items.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("boxes").alias("n_boxes"), F.round(F.sum("c0") / F.sum("boxes"), 4).alias("class_share"), F.round(F.avg((F.col("res") == 3).cast("double")), 4).alias("source_share"), F.countDistinct("grp").alias("n_groups"),
    )
    return n.select(*by, "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by[0])), 4).alias("share"), "n_boxes", "class_share", "source_share", "n_groups")


def source_shares(items: DataFrame) -> DataFrame:
    """Share of each source in each split."""
    n = items.groupBy("split", "res").agg(F.count("*").alias("n"))
    return n.select("split", "res", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("split")), 4).alias("share"))


def safe_unlabeled(items: DataFrame, split: DataFrame) -> DataFrame:
    """Unlabeled items (id, grp, labeled) whose group has no labeled item outside train."""
    held = items.where("labeled").join(split, "id").where("split <> 'train'").select("grp").distinct()
    return items.where("not labeled").join(held, "grp", "left_anti").select("id")


def anchors_and_twins(held: DataFrame, most: int = 5, seed: int = 0) -> DataFrame:
    """(id, grp, role, half) of held-out items: in each group of two or more the first by hash order is
    the anchor, the next ``most`` are its twins, others are placebo, as are single items.

    Halves A and B alternate over the anchors by source and number of twins, so that both have like
    sources and, within one a stratum, as many anchors.
    """
    order = Window.partitionBy("grp").orderBy(shuffled(seed, F.col("id")), "id")
    size = F.count("*").over(Window.partitionBy("grp"))
    rows = held.select("id", "grp", "res", F.row_number().over(order).alias("rank"), size.alias("size"))
    role = F.when((F.col("size") > 1) & (F.col("rank") == 1), "anchor").when((F.col("size") > 1) & (F.col("rank") <= most + 1), "twin").otherwise("placebo")
    rows = rows.withColumn("role", role)
    by_source = Window.partitionBy("res").orderBy(F.desc("size"), shuffled(seed, F.col("grp")), "grp")
    half = rows.where("role = 'anchor'").select("grp", F.when(F.row_number().over(by_source) % 2 == 1, "A").otherwise("B").alias("half"))
    return rows.join(half, "grp", "left").select("id", "grp", "role", F.when(F.col("role") != "placebo", F.col("half")).alias("half"))


#: What a half search weighs: a twin of difference between the halves, a box, an anchor.
HALF_WEIGHTS = (10, 1, 5)


def half_key(draw: Column, seed: int) -> Column:
    """Where an anchor stands in the order of its stratum in a draw: the hash of draw and id."""
    return F.xxhash64(F.lit(seed), draw, F.col("id"))


def best_halves(anchors: DataFrame, tries: int = 5000, seed: int = 0) -> DataFrame:
    """(id, half) of anchors (id, res, twins, boxes): halves A and B of the draw whose numbers of twins, boxes
    and anchors differ least, by HALF_WEIGHTS; of equally good draws the first.

    In each of ``tries`` draws every source (a stratum) is halved by a hash order of its anchors. Which
    half gets the odd one alternates over the sources with an odd number, the first of them by the
    draw's parity. A draw is judged by the sums of its strata alone: anchors are expanded by draw, summed
    up by (draw, stratum), and only the best draw's halves are made again. No task holds all anchors.
    """
    places = Window.partitionBy("draw", "res").orderBy("key", "id")
    odd = anchors.groupBy("res").agg(F.count("*").alias("n"))
    odd = odd.select("res", "n", F.sum(F.col("n") % 2).over(Window.orderBy("res").rowsBetween(Window.unboundedPreceding, -1)).alias("turn"))

    def halved(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("key", half_key(F.col("draw"), seed)).withColumn("place", F.row_number().over(places)).join(odd, "res")
        extra = (F.col("n") % 2) * ((F.col("draw") + F.coalesce("turn", F.lit(0))) % 2)
        return placed.withColumn("side", F.when(F.col("place") <= F.floor(F.col("n") / 2) + extra, 1).otherwise(-1))

    draws = anchors.select("id", "res", "twins", "boxes", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("draw"))
    strata = halved(draws).groupBy("draw", "res").agg(*(F.sum(F.col("side") * c).alias(name) for name, c in (("twins", F.col("twins")), ("boxes", F.col("boxes")), ("anchors", F.lit(1)))))
    costs = strata.groupBy("draw").agg(sum(w * F.abs(F.sum(c)) for w, c in zip(HALF_WEIGHTS, ("twins", "boxes", "anchors"))).alias("cost"))
    best = costs.agg(F.min_by("draw", F.struct("cost", "draw")).alias("draw"))
    return halved(anchors.crossJoin(F.broadcast(best)).where("draw is not null")).select("id", F.when(F.col("side") > 0, "A").otherwise("B").alias("half"))


def with_halves(arms: DataFrame, halves: DataFrame) -> DataFrame:
    """arms (id, grp, role, ...) with the halves of their groups' anchors (id, half) in place of their own."""
    anchors = arms.where("role = 'anchor'").select(F.col("id").alias("__anchor"), F.col("grp").alias("__grp"))
    of = anchors.join(halves.select(F.col("id").alias("__anchor"), F.col("half").alias("__half")), "__anchor").select("__grp", "__half")
    met = arms.drop("half").join(of, F.col("grp") == F.col("__grp"), "left")
    return met.withColumn("half", F.when(F.col("role") != "placebo", F.col("__half"))).drop("__grp", "__half")


def stratified_sample(rows: DataFrame, stratum: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each stratum by hash order of id, with code: their place in a common hash order."""
    inside = Window.partitionBy(stratum).orderBy(shuffled(seed, F.col("id")), "id")
    some = rows.withColumn("k", F.row_number().over(inside)).where(F.col("k") <= n).drop("k")
    return some.withColumn("code", F.format_string("Q%03d", F.row_number().over(Window.orderBy(shuffled(f"{seed}c", F.col("id")), "id")) - 1))


def stratified_fill(pool: DataFrame, wanted: DataFrame, stratum: str, seed: int = 0) -> DataFrame:
    """Ids of the pool: of each stratum as many as ``wanted`` (stratum, n) says, by hash order; what a
    stratum lacks is topped up from the rest of the pool, by hash order too. Ranks, within strata and
    over all, are taken in ranges of the order."""
    keyed = pool.withColumn("key", shuffled(seed, F.col("id")))
    sizes = pool.groupBy(stratum).agg(F.count("*").alias("there")).select(stratum, "there", (F.sum("there").over(Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    inside = ranked(keyed, stratum, "key", "id", name="k").join(sizes, stratum).withColumn("k", F.col("k") - F.coalesce("before", F.lit(0)))
    own = inside.join(wanted, stratum, "left").withColumn("own", F.col("k") <= F.coalesce("n", F.lit(0))).select("id", stratum, "key", "own")
    total = wanted.agg(F.sum("n").alias("total"))
    return ranked(own, F.desc("own"), "key", "id", name="place").crossJoin(F.broadcast(total)).where(F.col("place") <= F.col("total")).select("id", stratum, "own")
