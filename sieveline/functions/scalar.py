"""Column functions: vectors, bit signatures, boxes, bins and formats (all built-in expressions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)


def normalise(v: Column) -> Column:
    """v over its length. A zero vector gives nulls, not an error."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.try_divide(x, norm))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit signatures."""
    return F.bit_count(a.bitwiseXOR(b))


def pack_bits(flags: Column) -> Column:
    """A signature from an array of up to 64 booleans, the first as the lowest bit."""
    return F.aggregate(F.transform(flags, lambda f, i: F.when(f, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def unpack_bits(signature: Column, n: int = 64) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(signature, i))


def sign_signature(v: Column) -> Column:
    return pack_bits(F.transform(v, lambda x: x > 0))


def median_signature(v: Column) -> Column:
    """Bit i: v_i above the median of all but the first value, which gets a bit too."""
    rest = F.array_sort(F.slice(v, F.lit(2), F.size(v) - 1))
    n = F.size(rest)
    middle = (F.element_at(rest, F.floor((n + 1) / 2).cast("int")) + F.element_at(rest, (F.floor(n / 2) + 1).cast("int"))) / 2
    return pack_bits(F.transform(v, lambda x: x > middle))


def corners(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    """x1, y1, x2, y2 of a box given by centre and size."""
    return [(cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2")]


def area(b: str) -> Column:
    return (F.col(f"{b}.x2") - F.col(f"{b}.x1")) * (F.col(f"{b}.y2") - F.col(f"{b}.y1"))


def overlap(a: str, b: str) -> Column:
    """Area that two boxes share; 0 if they are apart."""
    side = lambda k: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{k}2"), F.col(f"{b}.{k}2")) - F.greatest(F.col(f"{a}.{k}1"), F.col(f"{b}.{k}1")))
    return side("x") * side("y")


def iou(a: str, b: str) -> Column:
    shared = overlap(a, b)
    return shared / (area(a) + area(b) - shared + F.lit(1e-12))


def containment(a: str, b: str) -> Column:
    return overlap(a, b) / (F.least(area(a), area(b)) + F.lit(1e-12))


def binned(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the bin [edges[i], edges[i + 1]) that x is in; null outside."""
    return reduce(lambda c, i: c.when((x >= edges[i]) & (x < edges[i + 1]), labels[i]), range(len(labels)), F.when(F.lit(False), ""))


def size_bin(a: Column, unit: float = 640.0) -> Column:
    """small, medium or large by relative area, with sides of 32 and 96 pixels of ``unit`` as bounds."""
    return F.when(a < (32 / unit) ** 2, "small").when(a < (96 / unit) ** 2, "medium").otherwise("large")


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)
