"""Audit of pairs by raters, agreement of groupings, weighted leakage, derived figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratum_shares(rated: DataFrame) -> DataFrame:
    """(stratum, n, stratum_size, lower, upper) of rated pairs (stratum, stratum_size, same: '1', '0' or 'u'):
    the share that shows the same, without and with the uncertain ones."""
    n = rated.groupBy("stratum").agg(F.count("*").alias("n"), F.max("stratum_size").alias("stratum_size"), F.count_if(F.col("same") == "1").alias("yes"), F.count_if(F.col("same") == "u").alias("unsure"))
    return n.select("stratum", "n", "stratum_size", (F.col("yes") / F.col("n")).alias("lower"), ((F.col("yes") + F.col("unsure")) / F.col("n")).alias("upper"))


def weighted_precision(shares: DataFrame, prefix: str) -> DataFrame:
    """One row (lower, upper): means over the strata whose name begins with prefix, by the strata's sizes."""
    some = shares.where(F.col("stratum").startswith(prefix))
    mean = lambda c: F.sum(F.col(c) * F.col("stratum_size")) / F.sum("stratum_size")
    return some.agg(mean("lower").alias("lower"), mean("upper").alias("upper"))


def by_strata(counts: DataFrame, shares: DataFrame, bounds: list[str]) -> DataFrame:
    """counts (id, a column for each stratum of shares) with, for each of bounds, the chance that any of an item's edges
    holds: one less the product of 1 - p, p the share of the edge's stratum. shares: one row, <stratum>_<bound>."""
    names = [c for c in counts.columns if c != "id"]
    log = lambda name, c: F.when(F.col(name) > 0, F.col(name) * F.log(1 - F.col(f"{name}_{c}") + F.lit(1e-12))).otherwise(0.0)
    chance = {c: 1 - F.exp(sum(log(name, c) for name in names)) for c in bounds}
    return counts.crossJoin(F.broadcast(shares)).select("id", *(v.alias(c) for c, v in chance.items()))


def weighted_leak(chances: DataFrame, split: DataFrame, bounds: list[str]) -> DataFrame:
    """(split, n, bounds): share of each split's items that an edge leaks to train, from the items' chances (id, bounds).
    Splits without an edge to train have 0."""
    held = split.where("split <> 'train'")
    sums = held.join(chances, "id").groupBy("split").agg(*(F.sum(c).alias(c) for c in bounds))
    n = held.groupBy("split").agg(F.count("*").alias("n"))
    return n.join(sums, "split", "left").select("split", "n", *((F.coalesce(c, F.lit(0.0)) / F.col("n")).alias(c) for c in bounds))


def weighted_prevalence(chances: DataFrame, n_items: DataFrame, bounds: list[str]) -> DataFrame:
    """One row: expected share of items with a partner, from the items' chances (id, bounds). n_items: one row with column all."""
    return chances.agg(*(F.sum(c).alias(c) for c in bounds)).crossJoin(n_items).select(*((F.coalesce(c, F.lit(0.0)) / F.col("all")).alias(c) for c in bounds))


def majority(rows: DataFrame, group: str, cluster: str) -> DataFrame:
    """One row: groups that span clusters, and items outside their group's most frequent cluster (ties to the
    smallest)."""
    joint = rows.groupBy(group, cluster).agg(F.count("*").alias("n"))
    per = joint.groupBy(group).agg(F.count("*").alias("clusters"), F.sum("n").alias("all"), F.max("n").alias("most"))
    return per.agg(F.count_if(F.col("clusters") > 1).alias("spanning"), F.coalesce(F.sum(F.col("all") - F.col("most")), F.lit(0)).alias("outside"))


def partition_agreement(rows: DataFrame, one: str, other: str) -> DataFrame:
    """One row (nmi, ari) of two groupings of the same rows: mutual information over the mean of the
    entropies, and the adjusted Rand index, from joint counts."""
    joint = rows.groupBy(one, other).agg(F.count("*").alias("n"))
    a, b = (joint.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in (one, other))
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    total = joint.agg(F.sum("n").cast("double").alias("all"), F.sum(pairs("n")).alias("together"))
    terms = lambda df, c, name: df.agg(F.sum(F.col(c).cast("double") * F.log(F.col(c))).alias(f"h_{name}"), F.sum(pairs(c)).alias(f"p_{name}"))
    mutual = joint.agg(F.sum(F.col("n").cast("double") * F.log("n")).alias("h"))
    row = total.crossJoin(mutual).crossJoin(terms(a, f"n_{one}", "a")).crossJoin(terms(b, f"n_{other}", "b"))
    n = F.col("all")
    entropy = lambda c: F.log(n) - F.col(c) / n
    shared = entropy("h_a") + entropy("h_b") - entropy("h")
    chance = F.col("p_a") * F.col("p_b") / (n * (n - 1) / 2)
    return row.select(F.try_divide(2 * shared, entropy("h_a") + entropy("h_b")).alias("nmi"), F.try_divide(F.col("together") - chance, (F.col("p_a") + F.col("p_b")) / 2 - chance).alias("ari"))


def two_raters(one: DataFrame, other: DataFrame, sure: bool = False) -> DataFrame:
    """(a, b) of two raters' labels (code, label), joined by code; sure: only those that neither is unsure of."""
    met = one.select("code", F.col("label").alias("a")).join(other.select("code", F.col("label").alias("b")), "code")
    return met.where("a <> 'u' and b <> 'u'" if sure else "true").select("a", "b")


def confusion_summary(pairs: DataFrame, background: int) -> DataFrame:
    """One row of (pred, truth) with a class for background: shares of the truth's boxes that are correct, missed
    (taken for background) and of another class, and the number of detections on background."""
    real = F.col("truth") != background
    n = F.count_if(real)
    share = lambda c: F.count_if(real & c) / n
    return pairs.agg(n.alias("n"), share(F.col("pred") == F.col("truth")).alias("correct"), share(F.col("pred") == background).alias("missed"), share((F.col("pred") != F.col("truth")) & (F.col("pred") != background)).alias("misclassified"), F.count_if(~real & (F.col("pred") != background)).alias("on_background"))


def top_confusions(pairs: DataFrame, background: int, n: int = 5) -> DataFrame:
    """(truth, pred, n) of the most frequent mistakes between classes, ties from the largest classes down."""
    wrong = pairs.where((F.col("pred") != F.col("truth")) & (F.col("pred") != background) & (F.col("truth") != background))
    return wrong.groupBy("truth", "pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("truth"), F.desc("pred")).limit(n)


def class_recall(pairs: DataFrame, order: list[int]) -> DataFrame:
    """(place, c, recall) for the classes in the given order; null for one that the truth lacks."""
    labels = pairs.sparkSession.createDataFrame([*enumerate(order)], "place int, c int")
    hit = pairs.groupBy(F.col("truth").alias("t")).agg(F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("recall"))
    return labels.join(hit, F.col("c") == F.col("t"), "left").select("place", "c", "recall")


def inflation(draws: DataFrame) -> DataFrame:
    """One row of (seed, random, grouped): mean difference, its sample deviation, and the mean relative one."""
    d = F.col("random") - F.col("grouped")
    return draws.agg(F.avg(d).alias("mean_abs"), F.stddev_samp(d).alias("sd"), F.avg(d / F.col("grouped")).alias("mean_rel"))


def over_draws(values: DataFrame, by: list[str], c: str) -> DataFrame:
    """(by, mean, low, high) of a value of each draw."""
    return values.groupBy(*by).agg(F.avg(c).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"))


def sampled(rows: DataFrame, n: int, key: Column) -> DataFrame:
    """n rows by the order of key: a uniform sample if key is a hash."""
    return rows.orderBy(key).limit(n)


def with_sizes(rows: DataFrame, group: str) -> DataFrame:
    """rows with the number of rows of their group."""
    return rows.withColumn("size", F.count("*").over(Window.partitionBy(group)))
