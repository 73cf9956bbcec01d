"""Detection scores: greedy matching, precision-recall, average precision, sizes, confusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.scalar import area, iou, size_bin
from sieveline.operators.order import ranged
from sieveline.storage import cut


def _assign(dets: DataFrame, truth: DataFrame, least: float, prefer) -> DataFrame:
    """(id, cls, det, preferred): greedy one-to-one matches of detections with boxes at an IoU of ``least``.

    Pairs that overlap enough are found by a plain join and sorted within partitions by item, class,
    confidence, preference and IoU; then one pass over the rows takes each pair whose detection and
    box are both still free. It streams, and remembers one item's class at a time.
    """
    d, g = dets.alias("d"), truth.alias("g")
    met = d.join(g, (F.col("d.id") == F.col("g.id")) & (F.col("d.cls") == F.col("g.cls")))
    met = met.select("d.id", "d.cls", "d.det", "d.conf", F.col("g.k").cast("long").alias("k"), iou("d", "g").alias("iou"), prefer.alias("preferred")).where(F.col("iou") >= least)

    def walk(batches):
        import pyarrow as pa

        at, free_det, taken = None, None, set()
        for batch in batches:
            keep = []
            for i, (item, cls, det, k) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if (item, cls) != at:
                    at, taken, free_det = (item, cls), set(), None
                if det != free_det and k not in taken:
                    taken.add(k)
                    free_det = det  # rows of a detection follow each other: this one has its box
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in (batch.column(j) for j in (0, 1, 2, 4))], names=["id", "cls", "det", "preferred"])

    rows = met.repartition("id", "cls").sortWithinPartitions("id", "cls", F.desc("conf"), "det", F.desc("preferred"), F.desc("iou"), "k")
    return rows.select("id", "cls", "det", "k", "preferred").mapInArrow(walk, "id long, cls int, det long, preferred boolean")


def match(dets: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, cls, det, conf, tp): per item and class, detections by confidence (ties by det) each take the
    unmatched box with the largest IoU of ``least`` or more.
    """
    hits = _assign(dets, truth, least, F.lit(True)).select("id", "cls", "det", F.lit(1).alias("hit"))
    return dets.select("id", "cls", "det", "conf").join(hits, ["id", "cls", "det"], "left").select("id", "cls", "det", "conf", F.coalesce("hit", F.lit(0)).alias("tp"))


def running(tp: DataFrame, positives: DataFrame, by: list[str] = ("cls",), weight: str | None = None) -> DataFrame:
    """tp with range, recall and precision after each detection by confidence down (ties by id, det).
    positives: by, npos; a class without positives has no rows.

    A class isn't one window: the order is cut into ranges, sums of the ranges are added up (a row
    for each class in a range), and only a range's own rows are summed in a task.
    """
    by, w = list(by), F.col(weight) if weight else F.lit(1.0)
    order = [F.desc("conf"), F.asc("id"), F.asc("det")]
    rows = ranged(tp.join(positives.where("npos > 0"), by), *by, *order)
    inside = Window.partitionBy("range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("range", *by).agg(F.sum(w * F.col("tp")).alias("t"), F.sum(w).alias("a"))
    sums = sums.select("range", *by, F.coalesce(F.sum("t").over(before), F.lit(0.0)).alias("t"), F.coalesce(F.sum("a").over(before), F.lit(0.0)).alias("a"))
    rows = rows.withColumn("ctp", F.sum(w * F.col("tp")).over(inside)).withColumn("all", F.sum(w).over(inside)).join(sums, ["range", *by])
    rows = rows.withColumn("ctp", F.col("ctp") + F.col("t")).withColumn("all", F.col("all") + F.col("a")).drop("t", "a")
    return rows.withColumn("recall", F.col("ctp") / F.col("npos")).withColumn("precision", F.when(F.col("all") > 0, F.col("ctp") / F.greatest("all", F.lit(1e-12))).otherwise(0.0))


def pr_curve(tp: DataFrame, positives: DataFrame, by: list[str] = ("cls",), weight: str | None = None) -> DataFrame:
    """running() with the envelope: the largest precision from there on. It is a running maximum over the
    reversed order of a range, and over the maxima of the ranges that follow."""
    by = list(by)
    rows = cut(running(tp, positives, by, weight))
    inside = Window.partitionBy("range", *by).orderBy(F.asc("conf"), F.desc("id"), F.desc("det")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("range", *by).agg(F.max("precision").alias("top"))
    tops = tops.select("range", *by, F.max("top").over(after).alias("later"))
    own = F.max("precision").over(inside)
    return rows.withColumn("envelope", own).join(tops, ["range", *by]).withColumn("envelope", F.greatest("envelope", "later")).drop("later", "range")


def grid_points(recall):
    """How many k from 0 on have k / 100 up to a recall; quotients as on the grid."""
    near = F.floor(recall * 100)
    return (near + F.when((near + 1) / 100.0 <= recall, 2).when(near / 100.0 <= recall, 1).otherwise(0)).cast("int")


def interpolated(levels: DataFrame, by: list[str]) -> DataFrame:
    """(by, ap) from (by, upto, precision): the best precision of the detections whose recall reaches so many
    grid points. At most 102 rows of a class: the best from there on answers for the points up to it."""
    w = Window.partitionBy(*by).orderBy(F.desc("upto"))
    best = levels.where("upto > 0").select(*by, "upto", F.max("precision").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("best"), F.coalesce(F.lead("upto").over(w), F.lit(0)).alias("lower"))
    return best.groupBy(*by).agg((F.sum((F.col("upto") - F.col("lower")) * F.col("best")) / 101).alias("ap"))


def average_precision(curve: DataFrame, positives: DataFrame, by: list[str] = ("cls",)) -> DataFrame:
    """(by, npos, ap): mean over recalls 0, .01, ... 1 of the best precision at that recall or more, 0
    beyond the end; null without positives, 0 without detections. curve: by, recall, precision.

    Detections are first reduced to the best precision for each number of grid points that their
    recall reaches, with partial sums before the shuffle: neither an order nor a grid is joined.
    """
    by = list(by)
    levels = curve.groupBy(*by, grid_points(F.col("recall")).alias("upto")).agg(F.max("precision").alias("precision"))
    return positives.join(interpolated(levels, by), by, "left").select(*by, "npos", F.when(F.col("npos") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"))


def slices_of(slices: DataFrame, boxes: DataFrame, least: int) -> DataFrame:
    """(slice, id) of the slices (slice, id) that have boxes on ``least`` items or more."""
    n = slices.join(boxes.select("id").distinct(), "id", "left_semi").groupBy("slice").agg(F.countDistinct("id").alias("n"))
    return slices.join(n.where(F.col("n") >= least).select("slice"), "slice", "left_semi")


def match_by_size(dets: DataFrame, truth: DataFrame, low: float, high: float, least: float = 0.5) -> DataFrame:
    """match() for boxes with an area in [low, high): a detection prefers boxes in range; one that
    takes a box out of range, or takes none and is out of range itself, is left out."""
    inside = lambda a: (a >= low) & (a < high)
    hits = _assign(dets, truth, least, inside(area("g")))
    d = dets.select("id", "cls", "det", "conf", inside((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("inside"))
    out = d.join(hits, ["id", "cls", "det"], "left").where(F.coalesce("preferred", "inside"))
    return out.select("id", "cls", "det", "conf", F.col("preferred").isNotNull().cast("int").alias("tp"))


def recall_by_size(dets: DataFrame, truth: DataFrame, conf: float = 0.25, least: float = 0.5) -> DataFrame:
    """(size, n, found, recall): boxes that any detection of their class with that confidence meets."""
    g = truth.select("*").alias("g")
    d = dets.where(F.col("conf") >= conf).alias("d")
    hit = g.join(d, (F.col("g.id") == F.col("d.id")) & (F.col("g.cls") == F.col("d.cls")) & (iou("g", "d") >= least), "left_semi").select("id", "k", F.lit(1).alias("hit"))
    sized = g.select("g.id", "g.k", size_bin(area("g")).alias("size")).join(hit, ["id", "k"], "left")
    out = sized.groupBy("size").agg(F.count("*").alias("n"), F.count("hit").alias("found"))
    return out.withColumn("recall", F.round(F.col("found") / F.col("n"), 6))


def confusion(pairs: DataFrame) -> DataFrame:
    """(pred, truth, n, share) from (pred, truth): share of the truth's rows."""
    n = pairs.groupBy("pred", "truth").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("truth")), 6))


def classification(pairs: DataFrame) -> DataFrame:
    """One row: accuracy, balanced accuracy and macro F1 of (pred, truth)."""
    labels = pairs.select(F.explode(F.array("pred", "truth")).alias("c")).distinct()
    per = pairs.select(F.explode(F.array(F.struct(F.col("pred").alias("c"), F.lit(1).alias("p"), F.lit(0).alias("t"), F.lit(0).alias("h")), F.struct(F.col("truth").alias("c"), F.lit(0).alias("p"), F.lit(1).alias("t"), (F.col("pred") == F.col("truth")).cast("int").alias("h")))).alias("x"))
    per = per.groupBy("x.c").agg(F.sum("x.p").alias("p"), F.sum("x.t").alias("t"), F.sum("x.h").alias("h")).join(labels, "c")
    return per.agg(F.round(F.sum("h") / F.sum("t"), 6).alias("accuracy"), F.round(F.avg(F.try_divide(F.col("h"), F.col("t"))), 6).alias("balanced"), F.round(F.avg(2 * F.col("h") / (F.col("p") + F.col("t"))), 6).alias("macro_f1"))


def kappa(pairs: DataFrame) -> DataFrame:
    """One row (n, agreement, kappa) of (a, b) labels by two raters."""
    joint = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = joint.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    one, two = joint.groupBy("a").agg(F.sum("n").alias("na")), joint.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = one.join(two, F.col("a") == F.col("b")).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("c"))
    po, pe = F.col("same") / F.col("all"), F.coalesce("c", F.lit(0.0)) / (F.col("all").cast("double") * F.col("all"))
    return total.crossJoin(chance).select(F.col("all").alias("n"), F.round(po, 6).alias("agreement"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))


def wilson(k, n, z: float = 1.959963984540054):
    """Bounds of the Wilson interval of k of n."""
    p, z2 = k / n, z * z
    centre, half = (p + z2 / (2 * n)) / (1 + z2 / n), F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) * z / (1 + z2 / n)
    return F.round(centre - half, 6), F.round(centre + half, 6)
