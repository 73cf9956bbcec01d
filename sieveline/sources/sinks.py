"""Writers: CSV, JSON reports, sorted id lists, partitioned data sets, name-value reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def report(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.write.mode("overwrite").json(path)


def id_list(df: DataFrame, path: str, key: str = "id") -> None:
    """Ids in ascending order over the files, one a line."""
    df.select(F.col(key).cast("long").alias("id")).orderBy("id").select(F.col("id").cast("string")).write.mode("overwrite").text(path)


def datasets(df: DataFrame, path: str) -> dict[tuple[str, str], int]:
    """Ids partitioned by data set and split; gives the counts that were read back, for a check."""
    df.select("dataset", "split", "id").write.mode("overwrite").partitionBy("dataset", "split").parquet(path)
    rows = df.sparkSession.read.parquet(path).groupBy("dataset", "split").count().collect()
    return {(r["dataset"], r["split"]): r["count"] for r in rows}


def checked_datasets(df: DataFrame, path: str) -> None:
    """datasets(), with an error if a count that is read back isn't that of df."""
    want = {(r["dataset"], r["split"]): r["count"] for r in df.groupBy("dataset", "split").count().collect()}
    if (got := datasets(df, path)) != want:
        raise ValueError(f"data sets were written with other counts: {got}, not {want}")


def macros(values: DataFrame, path: str) -> None:
    r"""(name, value) as lines ``\newcommand{\name}{value}``, by name; a null value is a placeholder."""
    value = F.coalesce(F.col("value").cast("string"), F.lit("??"))
    values.orderBy("name").select(F.concat(F.lit("\\newcommand{\\"), "name", F.lit("}{"), value, F.lit("}"))).write.mode("overwrite").text(path)
