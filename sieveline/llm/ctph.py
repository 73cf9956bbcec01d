"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes ends a chunk wherever it falls on a boundary value for
the block size; each chunk gives one letter of the signature. A fingerprint holds the
signatures at a block size and at twice that size, so texts of somewhat different lengths
can be compared at a block size that both have.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import map_rows

#: Bytes that the rolling hash sees; chunks that a signature has, about; smallest block size.
WINDOW, CHUNKS, SMALLEST = 7, 64, 3
#: The 64 letters of a signature.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_LAST = (1 << 63) - 1
_TABLE = np.frombuffer(LETTERS.encode(), np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def rolling(raw: bytes) -> np.ndarray:
    """At each byte a hash of it and the six bytes before it (zeros before the first)."""
    b = np.frombuffer(bytes(WINDOW - 1) + raw, np.uint8).astype(np.uint64)
    out = np.zeros(len(raw), np.uint64)
    for j in range(WINDOW):
        out = out * np.uint64(0x100000001B3) + b[j : j + len(raw)] + np.uint64(1)
    return _mixed(out)


def signature(roll: np.ndarray, block: int) -> str:
    """A letter for each chunk: of the sum of its bytes' rolling hashes. A chunk ends where the
    rolling hash modulo the block size is block - 1; the rest after the last end is a chunk."""
    if not len(roll):
        return ""
    ends = np.flatnonzero(roll % np.uint64(block) == np.uint64(block - 1)) + 1
    starts = np.concatenate([[0], ends])
    starts = starts[starts < len(roll)]
    return _TABLE[(_mixed(np.add.reduceat(roll, starts)) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    """block:signature:signature at twice the block size. The block size is 3 times a power of 2:
    the smallest by which chunks number CHUNKS at most on average, doubled while the text has over
    twice as many (a text that repeats itself can), halved while it has under half as many and
    not too many at the half. An empty or null text is ``3::``."""
    raw = (text or "").encode()
    block = SMALLEST
    while block * CHUNKS < len(raw):
        block *= 2
    roll = rolling(raw)
    one = signature(roll, block)
    while len(one) > 2 * CHUNKS:
        block *= 2
        one = signature(roll, block)
    while len(one) < CHUNKS // 2 and block > SMALLEST and len(half := signature(roll, block // 2)) <= 2 * CHUNKS:
        block, one = block // 2, half
    return f"{block}:{one}:{signature(roll, 2 * block)}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, with a row of the matrix in the bits of two integers."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, dist = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        x = eq | down
        d = ((((eq & up) + up) ^ up) | eq) & full
        over, under = down | (~(d | up) & full), up & d
        dist += 1 if over & top else -1 if under & top else 0
        over, under = over << 1 | 1, under << 1
        up = (under | ~(x | over)) & full
        down = over & x & full
    return dist


def likeness(a: str, b: str) -> float:
    """0 to 1: one less the edit distance by the longer signature, at the best block size that both
    have; 1 for equal fingerprints, 0 if they have no block size in common."""
    if a == b:
        return 1.0
    (ba, a1, a2), (bb, b1, b2) = (x.split(":") for x in (a, b))
    one = {int(ba): a1, 2 * int(ba): a2}
    other = {int(bb): b1, 2 * int(bb): b2}
    scores = [1 - edit_distance(one[k], other[k]) / n for k in one.keys() & other.keys() if (n := max(len(one[k]), len(other[k])))]
    return max(scores, default=0.0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text; a null text counts as empty."""

    def start():
        return lambda cols: [cols[0], [len(t or "") for t in cols[1]], [*map(fingerprint, cols[1])]]

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(kept, start, "doc_id long, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as much of the beginning of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _ranges(keys: np.ndarray, checks: np.ndarray):
    """A column function: how many of the bounds (key, check), ascending, are at most a row's key and check."""

    def find(key: pd.Series, check: pd.Series) -> pd.Series:
        k, c = key.to_numpy(np.int64), check.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, side="left"), np.searchsorted(keys, k, side="right")
        out = low.copy()
        for at in np.unique(low[high > low]):  # keys that are bounds themselves
            some = np.flatnonzero((low == at) & (high > low))
            out[some] += np.searchsorted(checks[at : high[some[0]]], c[some], side="right")
        return pd.Series(out.astype(np.int32))

    return F.pandas_udf(find, "int")


def _bounds(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """About n bounds (key, check) at the quantiles of the keys. A key with more rows than a range has is cut
    further, at even steps of the check, which is a hash."""
    cuts = {min(int(c), _LAST) for c in rows.stat.approxQuantile("key", [i / n for i in range(1, n)], 0.25 / n)}
    out = {(k, -(1 << 63)) for k in cuts}
    total = rows.count()
    for r in rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(2, 2 * total // n)).collect():  # n / 2 at most
        parts = -(-r["n"] * n // total)
        out |= {(r["key"], (i << 64) // parts - (1 << 63)) for i in range(parts)}
    keys, checks = zip(*sorted(out)) if out else ((), ())
    return np.array(keys, np.int64), np.array(checks, np.int64)


def edit_likeness(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every document against its edited text and against the next document by doc_id.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).
    The edited text has its last quarter of code points replaced by the beginning of the next
    document (after the last comes the first). Null texts count as empty. Rows with equal ids
    follow each other by XXH64 of their texts, then by the texts; null ids come last; a single row is its
    own next. An empty table gives an empty result.

    Rows are cut into ranges of that order; a task walks through ranges in order. The row that begins
    a range also goes to the range before, which ends with it. So texts are shuffled once, and no task
    holds more than two of them. Rows of one id, or of none, are cut into ranges like others; only
    rows that repeat id and text stay together.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Null ids order as one more id after the greatest long; that id itself shares their key but not their checks.
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(_LAST))).withColumn("check", F.when(F.col("doc_id") == _LAST, F.lit(-(1 << 63))).otherwise(F.xxhash64("text")))
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = rows.select("key", "check")
    found = _ranges(*_bounds(place, 8 * partitions))
    heads = place.groupBy(found("key", "check").alias("range")).agg(F.min(F.struct("key", "check")).alias("h")).select("h.*").collect()
    if not heads:
        return spark.createDataFrame([], _SCHEMA)
    # Of a range without rows there is no head: the heads become the bounds, one for each range.
    heads = sorted((r["key"], r["check"]) for r in heads)
    found = _ranges(*(np.array(x, np.int64) for x in zip(*heads)))
    rows = rows.withColumn("range", (found("key", "check") - 1).cast("int"))
    head = F.broadcast(spark.createDataFrame([(*h, (i - 1) % len(heads)) for i, h in enumerate(heads)], "k long, c long, before int"))  # a row for each range
    first = rows.join(head, (F.col("key") == F.col("k")) & (F.col("check") == F.col("c"))).groupBy("key", "check", "before").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "text")).alias("t"))
    tails = first.select(F.lit(None).cast("long").alias("doc_id"), F.col("t.text").alias("text"), "key", "check", F.col("before").alias("range"), F.lit(True).alias("tail"))
    met = rows.withColumn("tail", F.lit(False)).unionByName(tails)
    met = met.repartition(partitions, "range").sortWithinPartitions("range", "tail", "key", F.asc_nulls_last("doc_id"), "check", "text")

    def start():
        last: list = [None]

        def run(cols):
            out = []
            for doc_id, text, tail in zip(*cols):
                mine = None if tail and last[0] is None else (doc_id, text, fingerprint(text))
                if last[0] is not None:
                    out.append(_compared(last[0], mine))
                last[0] = None if tail else mine
            return [[x[i] for x in out] for i in range(7)]

        return run

    return map_rows(met.select("doc_id", "text", "tail"), start, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(one, following):
    doc_id, text, own = one
    new = edited(text, following[1])
    changed = own if new == text else fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, following[2])
