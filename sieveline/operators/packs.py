"""Vectors packed in blocks that meet in a cartesian product without a shuffle, and the nearest means among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.storage import cut, drop

#: Blocks into which vectors are packed: so many, of LEAST_PACK vectors at least and MOST_PACK at most.
PACKS, LEAST_PACK, MOST_PACK = 12, 512, 1 << 16
#: Products that a task holds at a time.
PRODUCTS = 1 << 22


def packed(rows: DataFrame, n: int, label: bool = False) -> DataFrame:
    """(k, ids, v) of vectors (id, v), of which there are n: a row for each block, in the order of ids, ids and vectors
    as bytes. label: with the rows' column label, as bytes too. Vectors are sent and written once."""
    blocks = max(1, min(PACKS, n // LEAST_PACK), -(-n // MOST_PACK))
    keyed = rows.select("id", "v", *(["label"] if label else []), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("k"))

    def pack(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("id")
        out = {"k": [pdf.k.iloc[0]], "ids": [pdf.id.to_numpy("<i8").tobytes()], "v": [np.stack(pdf.v).astype("<f8").tobytes()]}
        return pd.DataFrame(out | ({"label": [pdf.label.to_numpy("<i8").tobytes()]} if label else {}))

    schema = "k int, ids binary, v binary" + (", label binary" if label else "")
    return cut(keyed.repartition(blocks, "k").groupBy("k").applyInPandas(pack, schema))


def met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of left with each of right (its columns with a 2): no row is shuffled."""
    return left.crossJoin(right.select(*(F.col(c).alias(f"{c}2") for c in right.columns)).hint("shuffle_replicate_nl"))


def read_block(row, two: str = ""):
    """(ids, vectors) of a block."""
    import numpy as np

    ids = np.frombuffer(row[f"ids{two}"], "<i8")
    return ids, np.frombuffer(row[f"v{two}"], "<f8").reshape(len(ids), -1)


def each(batches, work):
    """work's frames over the rows of batches, a row at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            columns = [batch.column(c)[i] for c in range(batch.num_columns)]
            yield from work({c: v.as_buffer() if hasattr(v, "as_buffer") else v.as_py() for c, v in zip(batch.schema.names, columns)})


def nearest_means(clusters: DataFrame, n: int, most: float) -> DataFrame:
    """(x, y, d): of each of n clusters (id, v: the mean of unit vectors, stale) that is stale the nearest other one by mean
    distance, which is one less the means' product, if it is at most ``most``; of equally near ones the smallest id."""

    def work(row):
        import numpy as np
        import pyarrow as pa

        ids, x = read_block(row)
        others, y = read_block(row, "2")
        stale = np.frombuffer(row["label"], "<i8") > 0
        ids, x = ids[stale], x[stale]
        step = max(1, PRODUCTS // len(others))
        for at in range(0, len(ids), step):
            sims = x[at : at + step] @ y.T
            home = np.minimum(np.searchsorted(others, ids[at : at + step]), len(others) - 1)
            own = np.flatnonzero(others[home] == ids[at : at + step])
            sims[own, home[own]] = -np.inf
            top = sims.max(axis=1)
            rows = np.flatnonzero(1 - top <= most + 1e-12)
            # Products that are equal but for rounding count as equal.
            y_at = (sims[rows] >= top[rows, None] - 1e-12).argmax(axis=1)
            yield pa.RecordBatch.from_pydict({"x": ids[at + rows], "y": others[y_at], "d": np.round(1 - top[rows], 12)})

    packs = packed(clusters.select("id", "v", F.col("stale").cast("long").alias("label")), n, label=True)
    found = met(packs, packs).mapInArrow(lambda batches: each(batches, work), "x long, y long, d double")
    out = cut(found.groupBy("x").agg(F.min(F.struct("d", "y")).alias("m")).select("x", "m.y", "m.d"))
    drop(packs)
    return out
