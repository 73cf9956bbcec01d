"""Order over a whole table without a window that one task holds: ranges, ranks, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.storage import cut


def ranged(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with ``range``: tables of equal size, about, that follow each other in the order. The order
    should name a row, so that no value fills a range of its own. Written once, so ranges stay."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))


def ranked(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """rows with their rank from 1 on in the order (columns or ascending and descending expressions).

    Rows are cut into ranges; a range's rows are ranked in its own task, and counts of the ranges
    (one row each) are summed up.
    """
    parts = ranged(rows, *order)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return parts.withColumn(name, inside).join(starts, "range").withColumn(name, F.col("start") + F.col(name)).drop("range", "start")


def with_next(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """rows with next_<column> of the row that follows by ``key``, a number that names a row; null for the last.

    A range's last row takes its values from the first row of the next range that has any.
    """
    parts = ranged(rows, key)
    order = Window.partitionBy("range").orderBy(key)
    own = parts.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns), F.lead(key).over(order).isNull().alias("last"))
    heads = parts.groupBy("range").agg(*(F.min_by(c, key).alias(c) for c in columns))
    heads = heads.select("range", *(F.lead(c).over(Window.orderBy("range")).alias(f"head_{c}") for c in columns))
    out = own.join(heads, "range")
    return out.select(*rows.columns, *(F.when(F.col("last"), F.col(f"head_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in columns))
