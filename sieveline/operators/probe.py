"""How well a source can be told from vectors: a classifier over stratified folds that keep groups whole."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.scoring import classification
from sieveline.operators.splits import shuffled
from sieveline.storage import cut

#: Groups that one task deals to folds, about.
SLICE_GROUPS = 20_000


def deal(counts, parts: int):
    """The fold of each group, from its rows by class (a matrix): groups whose classes are least even come first, and
    each goes to the fold with which the classes' shares vary least over the folds, then to the smallest one."""
    import numpy as np

    have, total = np.zeros((parts, counts.shape[1])), np.maximum(counts.sum(axis=0), 1)
    out = np.zeros(len(counts), np.int64)
    for g in np.argsort(-counts.std(axis=1), kind="stable"):
        cost = []
        for f in range(parts):
            have[f] += counts[g]
            cost.append((round(float((have / total).std(axis=0).mean()), 12), have[f].sum(), f))
            have[f] -= counts[g]
        out[g] = min(cost)[2]
        have[out[g]] += counts[g]
    return out


def folded(items: DataFrame, parts: int, seed: int = 0, slice_groups: int = SLICE_GROUPS) -> DataFrame:
    """items (id, grp, res, ...) with fold: no group lies in two folds, and the folds' shares of each source are near the
    whole's. Groups are dealt by their numbers of rows by source; of very many groups slices by hash are dealt
    each on its own, as even folds of slices add up to even folds. No group or source may be null."""
    own = items.groupBy("grp", "res").agg(F.count("*").alias("n")).groupBy("grp").agg(F.collect_list(F.struct("res", "n")).alias("by"))
    own = cut(own)
    slices = max(1, -(-own.count() // slice_groups))

    def dealt(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("key").reset_index(drop=True)
        classes = sorted({r["res"] for by in pdf.by for r in by})
        counts = np.zeros((len(pdf), len(classes)))
        for g, by in enumerate(pdf.by):
            for r in by:
                counts[g, classes.index(r["res"])] = r["n"]
        return pd.DataFrame({"g": pdf.grp, "fold": deal(counts, parts)})

    key = shuffled(seed, F.col("grp"))
    kind = dict(items.dtypes)["grp"]
    folds = own.select("grp", "by", key.alias("key"), F.pmod(F.xxhash64("grp"), F.lit(slices)).alias("slice")).groupBy("slice").applyInPandas(dealt, f"g {kind}, fold int")
    return items.join(folds, F.col("grp") == F.col("g")).drop("g")


def predictions(items: DataFrame, parts: int = 5, components: int = 128, seed: int = 0) -> DataFrame:
    """(fold, pred, truth) of items (id, grp, v, res): standardised vectors, up to so many principal components, and a
    logistic regression with sources weighed equally, each fold predicted by the others. A fold without rows, or
    whose other folds have fewer than two sources, is left out."""
    known = items.where("v is not null and res is not null and grp is not null")
    rows = cut(folded(known, parts, seed).select("fold", "res", array_to_vector("v").alias("x")))
    size = known.select(F.size("v").alias("n")).first()
    out = items.sparkSession.createDataFrame([], "fold int, pred int, truth int")
    for fold in range(parts):
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        n = {r["res"]: r["count"] for r in train.groupBy("res").count().collect()}  # a row a source
        if len(n) < 2 or test.isEmpty():
            continue
        total = sum(n.values())
        weight = F.element_at(F.create_map(*(x for k, c in n.items() for x in (F.lit(k), F.lit(total / (len(n) * c))))), F.col("res"))
        steps = [StandardScaler(inputCol="x", outputCol="s", withMean=True), PCA(k=min(components, size["n"]), inputCol="s", outputCol="p"), LogisticRegression(featuresCol="p", labelCol="res", weightCol="w", maxIter=50)]
        model = Pipeline(stages=steps).fit(train.withColumn("w", weight))
        out = out.unionByName(cut(model.transform(test).select(F.lit(fold).alias("fold"), F.col("prediction").cast("int").alias("pred"), F.col("res").cast("int").alias("truth"))))
    return out


def source_probe(items: DataFrame, parts: int = 5, components: int = 128, seed: int = 0) -> DataFrame:
    """(fold, n, accuracy, balanced, macro_f1) of the folds of predictions()."""
    found = predictions(items, parts, components, seed)
    out = items.sparkSession.createDataFrame([], "fold int, n long, accuracy double, balanced double, macro_f1 double")
    for fold in range(parts):
        own = found.where(F.col("fold") == fold)
        if not own.isEmpty():
            out = out.unionByName(classification(own.select("pred", "truth")).crossJoin(own.agg(F.count("*").alias("n"))).select(F.lit(fold).alias("fold"), "n", "accuracy", "balanced", "macro_f1"))
    return out


def source_recalls(items: DataFrame, parts: int = 5, components: int = 128, seed: int = 0) -> DataFrame:
    """(res, n, recall): of each source the share of its rows, over all folds, that is told as it."""
    found = predictions(items, parts, components, seed)
    return found.groupBy(F.col("truth").alias("res")).agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("recall"))
