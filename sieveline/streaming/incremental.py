"""Incremental near-duplicate detection over arriving signatures.

A batch is joined with itself, and its signatures probe the bands of those seen before; pairs among what
was seen are never looked at again. State is a table in the shared folder, so a restarted stream goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveline.operators.pairs import hamming_between, hamming_pairs


def step(batch: DataFrame, seen: DataFrame | None, most: int) -> DataFrame:
    """(a, b, ham): pairs of the batch with itself and with what was seen, each once. A signature that comes again
    replaces the one seen."""
    batch = batch.select("id", "sig").dropDuplicates(["id"])
    own = hamming_pairs(batch, most)
    if seen is None:
        return own
    before = seen.select("id", "sig").join(batch.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return own.unionByName(hamming_between(batch, before, most))


def run(stream: DataFrame, folder: str, most: int = 3, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start the stream of (id, sig). Pairs go to folder/pairs, signatures to folder/seen; a batch that is
    run again after a failure replaces its own files."""
    spark = stream.sparkSession
    schema = "id long, sig long"

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            seen = spark.read.schema(schema + ", batch long").option("basePath", f"{folder}/seen").parquet(f"{folder}/seen").where(F.col("batch") < number) if number else None
            pairs = step(batch, seen, most)
            pairs.write.mode("overwrite").parquet(f"{folder}/pairs/batch={number}")
            batch.select("id", "sig").write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")
            if then:
                then(pairs, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
