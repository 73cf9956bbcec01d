"""Declarative checks: each gives the rows that violate it; a report counts them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(rows: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Keys of rows that aren't in ``there`` (empty: a subset)."""
    return rows.select(key).distinct().join(there.select(key).distinct(), key, "left_anti")


def shared(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keys of both (empty: disjoint)."""
    return rows.select(key).intersect(other.select(key))


def different(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keys of only one of both (empty: equal)."""
    return missing(rows, other, key).unionAll(missing(other, rows, key))


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)


def spanning(rows: DataFrame, group: str, part: str) -> DataFrame:
    """Groups that lie in more than one part."""
    return rows.groupBy(group).agg(F.min(part).alias("a"), F.max(part).alias("b")).where("a <> b").select(group)


def sized(rows: DataFrame, n: int) -> DataFrame:
    """A row if there aren't n rows."""
    return rows.agg(F.count("*").alias("n")).where(F.col("n") != n)


def as_many(rows: DataFrame, other: DataFrame) -> DataFrame:
    """A row if both haven't equally many rows."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(rows, "n").crossJoin(count(other, "m")).where("n <> m")


def looked_up(rows: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """rows with the columns of ``there``, of which each key has one row; a key that isn't there is an error."""
    met = rows.join(there.withColumn("__found", F.lit(True)), key, "left")
    found = F.when(F.col("__found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"no row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(dict(rows.dtypes)[key]))
    return met.withColumn(key, found).drop("__found")


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """(name, violations) of named checks."""
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations")
        out = one if out is None else out.unionByName(one)
    return out
