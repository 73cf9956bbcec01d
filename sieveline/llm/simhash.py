"""SimHash near-dedup with a segment-popcount embedding.

A fingerprint's 64 bits fall into 32 segments of two bits; the vector of the segments' bit
counts is its embedding. Flipping one bit moves one count by one, so the Manhattan distance
of two embeddings is a lower bound of the Hamming distance, and fingerprints within three
bits lie within three of each other on the grid of the embedding. Of the two halves of the
embedding (16 counts each) at least one then differs by at most one, so a range join over
the grid of each half finds every pair; the bound over all counts and then the exact
Hamming distance verify it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import give_back, map_rows, mixed, text_check
from sieveline.llm.setjoin import Links, shingle_set, sketch
from sieveline.operators.graph import connected_components
from sieveline.storage import cut

#: Bits by which linked fingerprints differ at most; the two halves of the grid rely on 3.
MAX_BITS = 3
#: Rows of a cell that are compared at a time; a fuller cell is cut into tiles of so many.
TILE_ROWS = 2048
#: Different fingerprints from which on the grid's segments have one bit instead of two.
FINE_ROWS = 1 << 23

#: MinHash bands and values in each.
BANDS, BAND_ROWS = 24, 4
#: Bands whose candidates are verified whether or not their ends are connected already.
FIRST_BANDS = 2
#: Texts from whose shingles the frequent ones are learned, and how many frequent ones are held.
SAMPLE_TEXTS, OFTEN = 1 << 14, 1 << 16
#: Words of a shingle of the sets that overlap_links() compares.
SHINGLE = 5
_SEEDS, _FACTORS = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64) | np.uint64(1)

_ODD, _LOW = np.uint64(0x5555555555555555), np.uint64(0xFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half the shingles' XXH64 (seed 42).

    A-Z are lower-cased; words are what blanks and the characters from tab to carriage return
    separate; with fewer words than a shingle has, all of them are one. 0 if there is no word.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    last = max(1, len(words) - shingle + 1)
    hashes = [xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[:last], ends[min(shingle, len(words)) - 1 :])]
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of a very long text
        part = np.array(hashes[at : at + (1 << 16)], ">u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(hashes)).tobytes())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, check, fp long) of every whole text; null ids and repeated rows are kept. check is a
    hash of the text that tells rows with the same id apart."""

    def start():
        def run(cols):
            return [cols[0], cols[2], pa.array(np.array([fingerprint(t) for t in cols[1]], np.uint64).view(np.int64))]

        return run

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_check().alias("check"))
    return map_rows(kept, start, "doc_id long, check long, fp long")


def embedding(fp: np.ndarray) -> np.ndarray:
    """The 32 bit counts, two bits each, packed into 64 bits."""
    return (fp & _ODD) + ((fp >> np.uint64(1)) & _ODD)


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings: at most the fingerprints' Hamming distance.

    Counts are 0 to 2, so with each mapped to 00, 01 and 11 a distance is the number of bits.
    """
    unary = lambda e: e | ((e >> np.uint64(1)) & _ODD)
    return np.bitwise_count(unary(a) ^ unary(b))


def _cells(fp: np.ndarray, width: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) of the grid cells in which fingerprints take part; width: bits of a segment, 1 or 2.

    A cell is a half's number and its 32 / width counts. Each fingerprint is at home in one cell of each
    half. Halves at distance one differ in their sums by one, so only those with an even sum
    also visit the cells next to theirs, and each near pair meets once for each near half.
    """
    e, out = embedding(fp) if width == 2 else fp, []
    top = np.uint64((1 << width) - 1)
    for half in (0, 1):
        own = (e >> np.uint64(32 * half)) & _LOW
        name = np.uint64(half) << np.uint64(32)
        rows = np.arange(len(fp))
        out.append((rows, own | name, np.ones(len(fp), bool)))
        sums = np.bitwise_count(own) if width == 1 else np.bitwise_count(own & np.uint64(0x55555555)) + 2 * np.bitwise_count(own & np.uint64(0xAAAAAAAA))
        even = rows[sums % 2 == 0]
        for s in range(32 // width):
            unit = np.uint64(1 << width * s)
            count = (own[even] >> np.uint64(width * s)) & top
            for some, cell in ((even[count < width], own[even[count < width]] + unit), (even[count > 0], own[even[count > 0]] - unit)):
                out.append((some, cell | name, np.zeros(len(some), bool)))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def _spread(width: int):
    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in part:
            for at in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False)
                row, cell, home = _cells(fp.view(np.uint64), width)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp[row]), pa.array(home)], names=["cell", "fp", "home"])

    return run


def _forest(links: np.ndarray, fp: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of pairs of rows, only those that connect what wasn't connected yet."""
    up = {}

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for a, b in links.tolist():
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            yield fp[a], fp[b]


def _near(fa: np.ndarray, fb: np.ndarray, max_bits: int) -> np.ndarray:
    """Which fingerprints are within max_bits: first by the bound, then exactly."""
    near = bound(embedding(fa), embedding(fb)) <= max_bits
    near[near] = np.bitwise_count(fa[near] ^ fb[near]) <= max_bits
    return near


def _tile_links(fp: np.ndarray, home: np.ndarray, left: np.ndarray, right: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """A forest of the links between a cell's rows: of the left part with the right part (a home row
    with any; both parts are the same rows for a tile on the diagonal)."""
    found = []
    b = np.flatnonzero(right)
    for at in range(0, len(a := np.flatnonzero(left)), 256):
        i, j = (x.reshape(-1) for x in np.broadcast_arrays(a[at : at + 256, None], b[None, :]))
        take = (home[i] | home[j]) & (fp[i] != fp[j])
        i, j = i[take], j[take]
        near = _near(fp[i], fp[j], max_bits)
        found.append(np.stack([i[near], j[near]], axis=1))
        if sum(map(len, found)) > 1 << 20:
            found = [_kept(np.concatenate(found))]
    return _forest(np.concatenate(found), fp) if found else iter(())


def _kept(pairs: np.ndarray) -> np.ndarray:
    return np.array([*_forest(pairs, np.arange(pairs.max() + 1).tolist())], np.int64).reshape(-1, 2)


def _small_links(fp: np.ndarray, home: np.ndarray, group: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Links of many small cells at once; group: sorted cell numbers 0, 1, ... of the rows."""
    size = np.bincount(group)
    end = np.cumsum(size)[group]
    n = len(fp)
    for step in range(1, int(size.max(initial=1))):
        i = np.flatnonzero(np.arange(n) + step < end)
        j = i + step
        take = home[i] | home[j]
        i, j = i[take], j[take]
        near = _near(fp[i], fp[j], max_bits) & (fp[i] != fp[j])
        yield from zip(fp[i[near]].tolist(), fp[j[near]].tolist())


def _linker(max_bits: int):
    """For partitions sorted by (cell, left tile, right tile): forests of the links of every cell."""

    def part_links(key, fp, home, chunk, left, right):
        """Rows with equal keys are a tile."""
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(edge, len(key)))
        small = np.repeat(size <= 16, size)
        if small.any():
            group = np.repeat(np.arange(len(size)), size)[small]
            yield from _small_links(fp[small], home[small], np.unique(group, return_inverse=True)[1], max_bits)
        for a, n in zip(edge[size > 16].tolist(), size[size > 16].tolist()):
            s = slice(a, a + n)
            if home[s].any():
                f = fp[s]
                yield from ((int(x), int(y)) for x, y in _tile_links(f, home[s], chunk[s] == left[s], chunk[s] == right[s], max_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _and_last(batches):
            if batch is not None:
                cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
            if rest is None or not len(rest[0]):
                continue
            cell, left, right, chunk, fp, home = rest
            last = (cell == cell[-1]) & (left == left[-1]) & (right == right[-1])
            whole = len(cell) if batch is None else int(np.argmax(last))
            if not whole:
                continue
            key = np.cumsum(np.concatenate([[0], (cell[1:] != cell[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))[:whole]
            pairs = np.array([*part_links(key, fp.view(np.uint64)[:whole], home[:whole], chunk[:whole], left[:whole], right[:whole])], np.uint64).reshape(-1, 2)
            rest = [x[whole:] for x in rest]
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy().view(np.int64)) for k in (0, 1)], names=["src", "dst"])
        give_back()

    return run


def _and_last(batches):
    yield from batches
    yield None


def links(fps: DataFrame, max_bits: int = MAX_BITS, tile_rows: int = TILE_ROWS, width: int | None = None) -> DataFrame:
    """(src, dst): links between different fingerprints within max_bits, enough of them to connect
    every two fingerprints that a chain of links connects. fps: one column fp, any repeats.

    Of a full cell the rows are cut into chunks by a hash, and each pair of chunks is a tile of
    its own, so a cell that very many near copies share is compared by many tasks, and none
    gives more links than it has rows. Every pair within max_bits is looked at. Segments have two bits,
    and from FINE_ROWS fingerprints on one bit (width), which makes cells hold fewer that aren't near: some
    2^24 cells of a half are in use at two bits, 2^32 at one. The links are the same.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the grid finds links of at most 3 bits")
    fps = cut(fps.select("fp").where("fp is not null").distinct())
    width = width or (2 if fps.count() < FINE_ROWS else 1)
    spread = cut(fps.mapInArrow(_spread(width), "cell long, fp long, home boolean"))
    full = spread.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("any")).where("any and n > 1")
    full = cut(full.select(F.col("cell").alias("c"), F.ceil(F.col("n") / F.lit(tile_rows)).cast("int").alias("tiles")))
    met = spread.join(full, F.col("cell") == F.col("c"))
    met = met.withColumn("chunk", F.when(F.col("tiles") > 1, F.pmod(F.xxhash64("fp"), "tiles").cast("int")).otherwise(0))
    tiles = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("chunk")).alias("left"), F.greatest(t, F.col("chunk")).alias("right")))
    met = met.select("cell", "chunk", "fp", "home", F.explode(tiles).alias("t")).select("cell", "t.left", "t.right", "chunk", "fp", "home")
    return met.repartition("cell", "left", "right").sortWithinPartitions("cell", "left", "right").mapInArrow(_linker(max_bits), "src long, dst long")


def _bands(grams: np.ndarray) -> list[int]:
    """A hash of each band of MinHash values."""
    least = np.full(BANDS * BAND_ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(grams), 4096):  # bounds the table for a very long text
        np.minimum(least, ((grams[at : at + 4096, None] ^ _SEEDS) * _FACTORS).min(axis=0), out=least)
    least = mixed(least).reshape(BANDS, BAND_ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
    return out.view(np.int64).tolist()


def _often(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, ascending, and their places from the rarest to the most frequent."""
    share = texts.count() // SAMPLE_TEXTS + 1
    some = texts.where(F.pmod(F.xxhash64("check", "doc_id"), F.lit(share)) == 0)
    grams = map_rows(some.select("text"), lambda: lambda cols: [[shingle_set(t, SHINGLE).view(np.int64) for t in cols[0]]], "grams array<long>")
    most = grams.select(F.explode("grams").alias("g")).groupBy("g").count().where("count > 2").orderBy(F.desc("count"), "g").limit(OFTEN)
    found = most.select("g").toArrow().column(0).to_numpy()[::-1].view(np.uint64)
    order = np.argsort(found)
    return found[order], order.astype(np.uint64)


def _prefix(grams: np.ndarray, often: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """A set's first shingles in an order that holds for all sets, frequent shingles last: as many as make sure that
    two sets of that similarity share one of them."""
    key = grams >> np.uint64(2)
    if len(often[0]):
        at = np.minimum(np.searchsorted(often[0], grams), len(often[0]) - 1)
        known = often[0][at] == grams
        key[known] = np.uint64(1 << 62) + often[1][at[known]]
    return np.sort(key)[: len(key) + percent * -len(key) // 100 + 1].view(np.int64)


def overlap_links(docs: DataFrame, known: DataFrame, similar: float = 0.8) -> DataFrame:
    """(src, dst): the known links of fingerprints, and those between texts whose five-word shingle sets have a
    Jaccard similarity of ``similar`` (in whole percent) or more, as far as they connect what isn't connected yet.

    First, MinHash bands connect most of a large group of near copies: each set of a band meets the band's
    representative, another one in each band, so a group gives as many candidates as it has rows times bands.
    Candidates of the first bands are looked at first; of the others only those whose ends are still apart. Then
    every pair of that similarity shares a shingle of their prefixes, whatever the bands have missed: sets of one
    such shingle that are still apart are compared within tiles (setjoin.cross_pairs()), so pairs that aren't similar
    never become rows. Sketches rule out most candidates, the exact similarity decides on the rest.
    """
    percent = round(100 * similar)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_check().alias("check")).where("text is not null")
    often = _often(texts)

    def start():
        def run(cols):
            sets = [shingle_set(t, SHINGLE) for t in cols[1]]
            some = lambda f: [f(g) if len(g) else None for g in sets]
            fps = pa.array(np.array([*map(fingerprint, cols[1])], np.uint64).view(np.int64))
            return [fps, some(lambda g: xxhash.xxh128_digest(g.tobytes())), cols[0], cols[2], some(_bands), [len(g) for g in sets], some(lambda g: _prefix(g, often, percent)), some(sketch)]

        return run

    rows = map_rows(texts.select("doc_id", "text", "check"), start, "fp long, s binary, doc_id long, check long, bands array<long>, n long, prefix array<long>, sketch binary").where("s is not null")
    rows = cut(rows.groupBy("s").agg(F.min("fp").alias("fp"), F.max("fp").alias("top"), F.collect_set("fp").alias("fps"), F.min(F.struct("doc_id", "check")).alias("at"), *(F.first(c).alias(c) for c in ("bands", "n", "prefix", "sketch"))))
    band = rows.select("s", F.posexplode("bands").alias("k", "band"))
    rep = band.groupBy("band").agg(F.min(F.struct(F.xxhash64("band", "s").alias("h"), "s")).alias("m"), F.count("*").alias("n")).where("n > 1").select(F.col("band").alias("b"), F.col("m.s").alias("r"))
    met = band.join(rep, F.col("band") == F.col("b")).where("s <> r")
    met = cut(met.groupBy(F.least("s", "r").alias("x"), F.greatest("s", "r").alias("y")).agg(F.min("k").alias("k")))

    same = rows.where("fp <> top").select("fp", F.explode("fps").alias("other")).select(F.col("fp").alias("src"), F.col("other").alias("dst")).where("src <> dst")
    links = Links(texts, rows, SHINGLE, percent, "fp", cut(known.union(same)))
    links.add(met.where(F.col("k") < FIRST_BANDS).select("x", "y"))
    links.add(links.apart(met.where(F.col("k") >= FIRST_BANDS).select("x", "y")))
    links.across(rows.select(F.explode("prefix").alias("group"), "s"))
    return links.links


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, similar: float | None = None) -> DataFrame:
    """(doc_id, check, fp, root, component_id) of every row: component_id is the smallest doc_id that links reach.

    Documents with equal fingerprints are one vertex. Texts without words share fingerprint 0.
    A null doc_id is never the smallest; a component of such rows alone has a null id. Repeated
    rows stay; an empty table gives an empty result; other columns are ignored. root, a fingerprint,
    names the component even where it has no id; check is a hash of the text.
    """
    found = cut(fingerprints(docs))
    linked = links(found, max_bits)
    if similar is not None:
        linked = overlap_links(docs, cut(linked), similar)
    return label(found, cut(connected_components(linked)))


def label(found: DataFrame, components: DataFrame) -> DataFrame:
    """component_id for rows (doc_id, fp), given the components of linked fingerprints."""
    least = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = least.join(components.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = cut(least)
    roots = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of = least.join(roots, "root").select(F.col("fp").alias("f"), "root", "component_id")
    return found.join(of, F.col("fp") == F.col("f"), "left").drop("f")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, similar: float | None = None) -> DataFrame:
    """The rows of docs, all columns, of which one stays for each component: that of the smallest id
    (null last), of those that share it the one of the smallest fingerprint and text hash; of rows that
    repeat it, one. Texts are shuffled once, by the row's own key. With ``similar``, components also follow
    overlap_links()."""
    found = cut(near_duplicates(docs, max_bits, similar))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "check")).alias("at"))
    first = first.select(F.xxhash64("at.doc_id", "at.check").alias("__k"), F.col("at.doc_id").alias("__i"), F.col("at.check").alias("__c"))
    keyed = docs.withColumn("__check", text_check()).withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), "__check"))
    kept = keyed.join(first.hint("shuffle_hash"), (F.col("__key") == F.col("__k")) & (F.col("__check") == F.col("__c")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__i")), "left_semi")
    if not found.groupBy("doc_id", "check").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["__key", "doc_id", "__check"])
    return kept.drop("__check", "__key")
