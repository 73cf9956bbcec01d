"""Parts that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, the characters U+0020 and U+0009 to U+000D.
#: bytes.split() without arguments separates at just these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; -1 for a null id, which is in no fold."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(-1))


def text_check() -> Column:
    """A hash of the column text, in which null and the empty text differ."""
    return F.xxhash64(F.col("text").cast("string"), F.col("text").isNull())


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes up to which words are hashed together, eight bytes at a time; longer ones one by one.
SHORT = 64
#: The first n of eight bytes, for n of 0 to 8.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(raw: bytes, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word of a text; different seeds give hashes that don't depend on each other.

    Words of one length up to eight bytes have different hashes. Eight bytes at a time are taken into
    the hash, each time scrambled; words of over SHORT bytes are hashed by XXH64.
    """
    inside = np.concatenate([[False], ~SPACE[np.frombuffer(raw, np.uint8)], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))  # the eight bytes from each byte on
    out = mixed((size.astype(np.uint64) + np.uint64(seed << 40)) * np.uint64(0x9E3779B97F4A7C15))
    out = mixed(out ^ (eight[start] & _FIRST[np.minimum(size, 8)]))
    for at in range(8, SHORT, 8):
        some = np.flatnonzero(size > at)
        if not len(some):
            break
        out[some] = mixed(out[some] * np.uint64(0xD1342543DE82EF95) ^ eight[start[some] + at] & _FIRST[np.minimum(size[some] - at, 8)])
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[start[i] : start[i] + size[i]], seed)
    return out


try:
    _trim = ctypes.CDLL(None).malloc_trim  # of the GNU library
except (AttributeError, OSError, TypeError):
    _trim = None


class Lists:
    """A column of lists of numbers, or of structs of such: each row's values as arrays, none for a null."""

    def __init__(self, column: pa.ListArray):
        self.edges, values = column.offsets.to_numpy(), column.values
        kept = [values.field(i) for i in range(values.type.num_fields)] if pa.types.is_struct(values.type) else [values]
        self.fields = [c.to_numpy(zero_copy_only=False) for c in kept]

    def __iter__(self) -> Iterator[list[np.ndarray]]:
        for a, b in zip(self.edges, self.edges[1:]):
            yield [c[a:b] for c in self.fields]


def give_back() -> None:
    """Return what this process has freed to the system; called at a task's end, as Python workers live on and
    would hold on to their largest task's memory beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def map_rows(df: DataFrame, f: Callable[[], Callable[[list], list]], schema: str, rows: int = 512, lists: tuple[str, ...] = ()) -> DataFrame:
    """Run f()(columns of up to ``rows`` rows) -> columns over df in Arrow batches.

    f is called once per task, for set-up. Slices of few rows bound the memory that very
    long texts take. Columns named by lists come as Lists instead of Python values.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = f()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = g([Lists(c) if name in lists else c.to_pylist() for name, c in zip(part.schema.names, part.columns)])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(out, target, strict=True)], schema=target)
        g = batch = part = out = None
        give_back()

    return df.mapInArrow(run, schema)
