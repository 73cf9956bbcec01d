"""Boxes of items: pairs within an item, quality report, filters, labels from text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.scalar import containment, corners, iou


def with_corners(boxes: DataFrame) -> DataFrame:
    """boxes (id, k, cls, cx, cy, w, h) with x1, y1, x2, y2."""
    return boxes.select("*", *corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")))


def box_pairs(boxes: DataFrame) -> DataFrame:
    """(id, k1, k2, c1, c2, iou, ios) of every two boxes of an item, k1 < k2. Pairs that share no
    area have 0 and are left out."""
    b = with_corners(boxes)
    met = b.alias("a").join(b.alias("b"), (F.col("a.id") == F.col("b.id")) & (F.col("a.k") < F.col("b.k")))
    out = met.select(F.col("a.id").alias("id"), F.col("a.k").alias("k1"), F.col("b.k").alias("k2"), F.col("a.cls").alias("c1"), F.col("b.cls").alias("c2"), iou("a", "b").alias("iou"), containment("a", "b").alias("ios"))
    return out.where("iou > 0 or ios > 0")


def overlap_kinds(pairs: DataFrame) -> DataFrame:
    """Pairs with kind: duplicate (same class, IoU > .9), nested (same class, IoS > .9) or cross (other
    class, IoU > .5); others are left out."""
    same = F.col("c1") == F.col("c2")
    kind = F.when(same & (F.col("iou") > 0.9), "duplicate").when(same & (F.col("ios") > 0.9), "nested").when(~same & (F.col("iou") > 0.5), "cross")
    return pairs.withColumn("kind", kind).where("kind is not null")


def flaws(boxes: DataFrame, small: float = 0.005, slack: float = 0.001, huge: float = 0.9, many: int = 15) -> DataFrame:
    """One row: boxes that are degenerate, out of bounds or huge, and items with too many boxes."""
    b = with_corners(boxes)
    outside = (F.least("x1", "y1") < -slack) | (F.greatest("x2", "y2") > 1 + slack)
    flags = b.select("id", ((F.col("w") < small) | (F.col("h") < small)).alias("degenerate"), outside.alias("outside"), (F.col("w") * F.col("h") > huge).alias("huge"))
    per = flags.groupBy("id").agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in ("degenerate", "outside", "huge")))
    return per.agg(*(F.sum(c).alias(c) for c in ("degenerate", "outside", "huge")), F.count_if(F.col("n") > many).alias("many"))


def parse_labels(files: DataFrame, strict: bool = False) -> DataFrame:
    """(id, k, cls, cx, cy, w, h) from (id, value): whole label files. k counts all lines, also the skipped
    ones; a line without exactly five fields is skipped, or is an error if strict."""
    lines = files.select("id", F.posexplode(F.split("value", "\n")).alias("k", "line"))
    parts = lines.select("id", "k", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ").alias("p")).where(F.col("p") != F.array(F.lit("")))
    if strict:
        parts = parts.withColumn("p", F.when(F.size("p") == 5, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("malformed label line of item "), F.col("id").cast("string"))).cast("array<string>")))
    parts = parts.where(F.size("p") == 5)
    return parts.select("id", "k", F.col("p")[0].cast("double").cast("int").alias("cls"), *(F.col("p")[i].cast("double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"), 1)))
