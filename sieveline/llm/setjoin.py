"""Jaccard self-join of n-gram sets by PartEnum signatures.

Sizes are cut into bands, each so wide that similar sets lie in one band or in two neighbours.
Within a band (and its next one) a Jaccard similarity is a bound k on the elements that differ.
The feature domain is hashed into n1 parts and each of these into n2 pieces, and a signature is
what a set holds of n2 - k2 pieces of a part, for every part and every such choice of pieces:
of n1 = ceil((k + 1) / (k2 + 1)) parts one has at most k2 differing elements, which touch at most
k2 of its pieces, so sets that are similar enough share a signature.

Equal sets are one. Sets that share a signature become candidates in two steps, neither of which
gives all pairs of a group: first each set with the group's least and largest set, which connects
groups of near copies; then, only in groups that still have several components, tiles of sets are
compared in a task by their parity sketches (a lower bound of the elements that differ) and only
pairs that may be similar leave it. Texts' whole sets decide on every candidate.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sieveline.llm.common import give_back, map_rows, mixed, text_check, word_hashes
from sieveline.operators.graph import connected_components
from sieveline.storage import cut, drop

#: Pieces of a part that may differ (k2); a part has 2 * SPARE + 1 pieces.
SPARE = 1
#: Least and most bits of a parity sketch, a power of two from twice the set's size on.
LEAST_BITS, MOST_BITS = 1024, 4096
#: Sets of a signature that are compared at a time; a fuller group is cut into tiles of so many.
TILE_ROWS = 2048
#: Sets that a task remembers, to give the signatures of each once.
SEEN = 1 << 16
#: Rows up to which a table is sent to all executors.
SENT_ROWS = 1 << 17
#: Bytes of shingle sets that one task holds as arrays at a time while it verifies pairs.
PAIR_BYTES = 1 << 24

_edges: dict[int, list[int]] = {}


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Ascending hashes of a text's different runs of ``shingle`` words (of all words, if there are fewer), A-Z in
    lower case; none without words."""
    words = word_hashes((text or "").encode().lower())
    if not len(words):
        return words
    n = min(shingle, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)])
    return np.unique(out)


def band(n: int, percent: int) -> int:
    """The band of a set's size: from each band's first size on to 100/percent times it."""
    edges = _edges.setdefault(percent, [])
    while not edges or edges[-1] < n:
        edges.append(100 * ((edges[-1] if edges else 0) + 1) // percent)
    return bisect_left(edges, n)


def differing(which: int, percent: int) -> int:
    """How many elements similar sets differ in at most, if the smaller one is of this band."""
    least = _edges[percent][which]
    return (least + 100 * least // percent) * (100 - percent) // (100 + percent)


def signatures(grams: np.ndarray, percent: int) -> np.ndarray:
    """The PartEnum signatures of a set (ascending 64-bit hashes): those of its own band and of the band below,
    whose sets are compared with those of the next."""
    if not len(grams):
        return np.zeros(0, np.uint64)
    own, out = band(len(grams), percent), []
    h = mixed(grams)
    high = h >> np.uint64(32)
    for which in (own - 1, own) if own else (0,):
        k = differing(which, percent)
        spare = min(SPARE, k)
        parts, pieces = -(-(k + 1) // (spare + 1)), 2 * spare + 1
        at = (high * np.uint64(parts * pieces) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(parts * pieces, np.uint64)
        np.add.at(sums, at, mixed(h ^ np.uint64(which + 1)))
        sums = sums.reshape(parts, pieces)
        for number, some in enumerate(combinations(range(pieces), pieces - spare)):
            name = mixed(np.arange(parts, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64((which << 8) + number))
            for piece in some:
                name = mixed(name * np.uint64(0x9E3779B97F4A7C15) + sums[:, piece])
            out.append(name)
    return np.concatenate(out)


def sketch(grams: np.ndarray) -> bytes:
    """Bit by bit whether a set has an odd number of elements that hash to it: an element that only one of two sets
    has turns one bit, so sketches of one length differ in no more bits than sets in elements."""
    bits = min(max(LEAST_BITS, 1 << (2 * len(grams)).bit_length()), MOST_BITS)
    at = (mixed(grams ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


class Sketches:
    """The sketches of a column. Two are compared at the shorter one's length, to which the longer one is folded."""

    def __init__(self, column: pa.Array):
        raw = column.to_pylist()
        self.words, self.at = np.array([len(x) // 8 for x in raw], np.int64), {}
        for w in np.unique(self.words).tolist():
            place, parts, n = np.full(len(raw), -1), [], 0
            for v in np.unique(self.words[self.words >= w]).tolist():
                rows = np.flatnonzero(self.words == v)
                place[rows] = np.arange(n, n + len(rows))
                n += len(rows)
                parts.append(np.bitwise_xor.reduce(np.frombuffer(b"".join([raw[i] for i in rows.tolist()]), np.uint64).reshape(len(rows), v // w, w), axis=1))
            self.at[w] = place, np.concatenate(parts)

    def bits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the pairs of rows (i, j) differ."""
        w, out = np.minimum(self.words[i], self.words[j]), np.zeros(len(i), np.int64)
        for words, (place, rows) in self.at.items():
            some = np.flatnonzero(w == words)
            if len(some):
                out[some] = np.bitwise_count(rows[place[i[some]]] ^ rows[place[j[some]]]).sum(axis=1, dtype=np.int64)
        return out


def likely(n: np.ndarray, sketches: Sketches, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (i, j) may be similar, by sizes and sketches, and in how many bits these differ."""
    a, b = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    fit = np.flatnonzero(percent * b <= 100 * a)
    bits = sketches.bits(i[fit], j[fit])
    near = bits * (100 + percent) <= (a + b)[fit] * (100 - percent)
    return fit[near], bits[near]


def rows_of(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, check, s, n, sketch, signatures) of every text. s: a 128-bit hash of its set, null if that is empty;
    check tells texts of one id apart. Of a set that several of the last SEEN sets of a task are, one has its
    signatures, so copies don't send them again and again. texts: doc_id, text."""

    def start():
        seen: dict[bytes, None] = {}

        def signed(s, g):
            if not len(g) or s in seen:
                return None
            seen[s] = None
            if len(seen) > SEEN:
                del seen[next(iter(seen))]
            return signatures(g, percent).view(np.int64)

        def run(cols):
            sets = [shingle_set(t, shingle) for t in cols[1]]
            names = [xxhash.xxh128_digest(g.tobytes()) if len(g) else None for g in sets]
            return [cols[0], cols[2], names, [len(g) for g in sets], [sketch(g) if len(g) else None for g in sets], [signed(s, g) for s, g in zip(names, sets)]]

        return run

    return map_rows(texts.select("doc_id", "text", text_check().alias("check")), start, "doc_id long, check long, s binary, n long, sketch binary, signatures array<long>")


def whole_sets(texts: DataFrame, sets: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(s, grams) of the wanted sets (s), each made again from one of its texts. sets: s, at (doc_id, check)."""
    need = sets.select("s", "at").join(wanted.select(F.col("s").alias("w")).distinct(), F.col("s") == F.col("w"), "left_semi")
    need = cut(need.select("s", F.col("at.doc_id").alias("i"), F.col("at.check").alias("c"), F.xxhash64("at.doc_id", "at.check").alias("k")))
    need = F.broadcast(need) if need.count() <= SENT_ROWS else need.hint("shuffle_hash")
    own = texts.select("doc_id", "text", text_check().alias("check")).withColumn("key", F.xxhash64("doc_id", "check"))
    own = own.join(need, (F.col("key") == F.col("k")) & (F.col("check") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("i")))

    def start():
        return lambda cols: [cols[0], [shingle_set(t, shingle).tobytes() for t in cols[1]]]

    return map_rows(own.select("s", "text").dropDuplicates(["s"]), start, "s binary, grams binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of sets that are similar: 100 times what both have is at least percent times what any has.
    A pair's two sets come in one row; a batch is taken a few rows at a time, PAIR_BYTES or one row."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, size = [], 0
            for i in range(batch.num_rows):
                p, q = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    keep.append(i)
                size += p.nbytes + q.nbytes
                if size > PAIR_BYTES:
                    size = 0
                    give_back()
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))
        batch = p = q = None
        give_back()

    met = pairs.select("x", "y").join(sets.select(F.col("s").alias("x"), F.col("grams").alias("gx")), "x").join(sets.select(F.col("s").alias("y"), F.col("grams").alias("gy")), "y")
    kind = dict(pairs.dtypes)["x"]
    return met.select("x", "y", "gx", "gy").mapInArrow(check, f"x {kind}, y {kind}")


def near_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y) those that sizes and sketches leave. sets: s, n, sketch."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = batch.num_rows
                n = np.concatenate([batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3)])
                both = Sketches(pa.concat_arrays([batch.column(c) for c in (4, 5)]))
                keep, _ = likely(n, both, np.arange(m), np.arange(m) + m, percent)
                yield batch.select([0, 1]).take(pa.array(keep))

    of = lambda c: sets.select(F.col("s").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"k{c}"))
    kind = dict(pairs.dtypes)["x"]
    return pairs.join(of("x"), "x").join(of("y"), "y").select("x", "y", "nx", "ny", "kx", "ky").mapInArrow(check, f"x {kind}, y {kind}")


def _tiles(percent: int, best: bool, target: pa.Schema):
    """For partitions sorted by (group, left, right): pairs of a tile's sets with different roots that may be similar."""

    def pairs_of(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        group, left, right, chunk, n = (table.column(c).to_numpy() for c in range(5))
        sketches, root = Sketches(table.column(5).combine_chunks()), table.column(7).combine_chunks().dictionary_encode().indices.to_numpy()
        new = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
        size = np.diff(np.append(new, len(group)))
        # Many small groups at once: each row with the one so many steps after it.
        small = np.repeat(size <= 64, size)
        rows, end = np.flatnonzero(small), np.repeat(new + size, size)
        for step in range(1, int(size[size <= 64].max(initial=1))):
            i = rows = rows[rows + step < end[rows]]
            i = i[root[i] != root[i + step]]
            keep, _ = likely(n, sketches, i, i + step, percent)
            yield i[keep], i[keep] + step
        for a, m in zip(new[size > 64].tolist(), size[size > 64].tolist()):
            own = np.arange(a, a + m)
            one, two = own[chunk[own] == left[a]], own[chunk[own] == right[a]]
            found = []
            for at in range(0, len(one), max(1, (1 << 15) // max(1, len(two)))):
                part = one[at : at + max(1, (1 << 15) // max(1, len(two)))]
                i, j = (x.reshape(-1) for x in np.broadcast_arrays(part[:, None], two[None, :]))
                take = (root[i] != root[j]) & ((i < j) | (left[a] != right[a]))
                i, j = i[take], j[take]
                keep, bits = likely(n, sketches, i, j, percent)
                found.append(np.stack([i[keep], j[keep], bits]))
                if best:  # of each two components the pair that is likeliest
                    i, j, bits = np.concatenate(found, axis=1)
                    low, high = np.minimum(root[i], root[j]).astype(np.int64), np.maximum(root[i], root[j])
                    order = np.argsort(bits, kind="stable")
                    _, first = np.unique((low * len(root) + high)[order], return_index=True)
                    found = [np.stack([i, j, bits])[:, order[first]]]
            if found:
                i, j, _ = np.concatenate(found, axis=1)
                yield i, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in _and_last(batches):
            if batch is not None:
                rest.append(batch)
                if rest[0].slice(0, 1).select([0, 1, 2]).equals(batch.slice(batch.num_rows - 1).select([0, 1, 2])):
                    continue  # still the first tile
            if not rest:
                continue
            table = pa.Table.from_batches(rest)
            whole = table.num_rows
            if batch is not None:
                last = np.logical_and.reduce([table.column(c).to_numpy() == table.column(c)[-1].as_py() for c in range(3)])
                whole = int(np.argmax(last))
            rest = table.slice(whole).to_batches()
            table = table.slice(0, whole)
            s = table.column(6).combine_chunks()
            for i, j in pairs_of(table):
                if len(i):
                    yield pa.RecordBatch.from_arrays([s.take(pa.array(i)), s.take(pa.array(j))], schema=target)
        table = batch = rest = s = None
        give_back()

    return run


def _and_last(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def cross_pairs(posts: DataFrame, root: DataFrame, sets: DataFrame, percent: int, best: bool, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(x, y): pairs of sets of one group that have different roots and may be similar, x < y, each once. posts: group
    (long), s; root: q, root of every set; sets: s, n, sketch. best: of each two components in
    a large tile only the likeliest pair; at least one where there is any.

    A group's rows are cut into chunks by a hash, and each two chunks are a tile of their own. Rows, not pairs, travel.
    """
    posts = cut(posts.join(root.select(F.col("q").alias("s"), "root"), "s").select("group", "s", "root"))
    several = posts.groupBy("group").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("m")).where("a <> b")
    several = cut(several.select(F.col("group").alias("g"), F.ceil(F.col("m") / F.lit(tile_rows)).cast("int").alias("tiles")))
    kept = posts.join(F.broadcast(several) if several.count() <= SENT_ROWS else several, F.col("group") == F.col("g"))
    kept = kept.join(sets.select(F.col("s").alias("t"), "n", "sketch"), F.col("s") == F.col("t"))
    kept = kept.withColumn("chunk", F.when(F.col("tiles") > 1, F.pmod(F.xxhash64("s"), "tiles").cast("int")).otherwise(0))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("chunk")).alias("left"), F.greatest(t, F.col("chunk")).alias("right")))
    dealt = kept.select("group", F.explode(pairs).alias("t"), "chunk", "n", "sketch", "s", "root").select("group", "t.left", "t.right", "chunk", "n", "sketch", "s", "root")
    kind = dict(posts.dtypes)["s"]
    target = to_arrow_schema(StructType.fromDDL(f"x {kind}, y {kind}"))
    found = dealt.repartition("group", "left", "right").sortWithinPartitions("group", "left", "right").mapInArrow(_tiles(percent, best, target), f"x {kind}, y {kind}")
    out = cut(found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    drop(posts, several)
    return out


class Links:
    """Links between similar sets: enough of them to connect all that chains of links connect.

    sets: s, n, sketch, at (doc_id and check of one text) and the column that names a set's vertex; known: links
    (src, dst) of vertices that are there already. texts: doc_id, text.
    """

    def __init__(self, texts: DataFrame, sets: DataFrame, shingle: int, percent: int, vertex: str = "s", known: DataFrame | None = None):
        self.texts, self.sets, self.shingle, self.percent, self.links = texts, sets, shingle, percent, known
        self.vertex = sets.select(F.col("s").alias("q"), F.col(vertex).alias("v"))

    def add(self, pairs: DataFrame) -> DataFrame:
        """Link the similar ones of pairs (x, y) of sets; gives those that sizes and sketches didn't rule out."""
        near = cut(near_pairs(pairs, self.sets, self.percent))
        whole = cut(whole_sets(self.texts, self.sets, near.select(F.explode(F.array("x", "y")).alias("s")), self.shingle))
        found = verified(near, whole, self.percent)
        for end, name in (("x", "src"), ("y", "dst")):
            found = found.join(self.vertex.select(F.col("q").alias(end), F.col("v").alias(name)), end)
        found = cut(found.select("src", "dst").where("src <> dst"))
        drop(whole)
        self.links = found if self.links is None else self.links.union(found)
        return near

    def roots(self) -> DataFrame:
        """(q, root): the component of every set by now."""
        parts = cut(connected_components(self.links))
        return cut(self.vertex.join(parts, F.col("v") == F.col("node"), "left").select("q", F.coalesce("component", "v").alias("root")))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (x, y) those whose ends aren't connected by now."""
        root = self.roots()
        for end, name in (("x", "rx"), ("y", "ry")):
            pairs = pairs.join(root.select(F.col("q").alias(end), F.col("root").alias(name)), end)
        return pairs.where("rx <> ry").drop("rx", "ry")

    def across(self, posts: DataFrame) -> None:
        """Link similar sets of one group (group, s) that aren't connected by now: of each two components the likeliest
        pair of a group first, then all pairs of those that this leaves apart."""
        found = cross_pairs(posts, self.roots(), self.sets, self.percent, True)
        if not found.isEmpty():
            self.add(found)
            self.add(cross_pairs(posts, self.roots(), self.sets, self.percent, False).join(found, ["x", "y"], "left_anti"))


def groups_of(posts: DataFrame) -> DataFrame:
    """(group, s, low, high): of posts (group, s) the different ones of groups with several sets, and the group's least
    and largest set. Counts by group are combined before the shuffle; posts are joined with those of over one."""
    several = posts.groupBy("group").agg(F.count("*").alias("m")).where("m > 1").select(F.col("group").alias("g"))
    met = cut(posts.join(several.hint("shuffle_hash"), F.col("group") == F.col("g"), "left_semi").distinct())
    ends = met.groupBy("group").agg(F.min("s").alias("low"), F.max("s").alias("high")).where("low <> high").select(F.col("group").alias("g"), "low", "high")
    return met.join(ends, F.col("group") == F.col("g")).select("group", "s", "low", "high")


def jaccard_components(docs: DataFrame, percent: int = 90, shingle: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs: the size of its shingle set and the smallest doc_id that
    links reach, where documents link whose sets have a Jaccard similarity of percent / 100 or more.

    Null and empty texts have an empty set, which nothing is linked with: their component is their own id. A null id
    is never the smallest; a component of such rows alone has a null id. Repeated rows stay and are linked. An
    empty table gives an empty result; other columns are ignored.
    """
    if not 1 <= percent <= 100:
        raise ValueError("a similarity of 1 to 100 percent")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(rows_of(texts, shingle, percent))
    sets = cut(rows.where("s is not null").groupBy("s").agg(F.min(F.struct("doc_id", "check")).alias("at"), *(F.first(c).alias(c) for c in ("n", "sketch"))))
    posts = cut(groups_of(rows.select(F.explode("signatures").alias("group"), "s")))
    links = Links(texts, sets, shingle, percent)
    links.add(posts.select("s", F.explode(F.array("low", "high")).alias("r")).where("s <> r").select(F.least("s", "r").alias("x"), F.greatest("s", "r").alias("y")).distinct())
    links.across(posts.select("group", "s"))
    return label(rows, connected_components(links.links))


def label(rows: DataFrame, components: DataFrame) -> DataFrame:
    """The result for rows (doc_id, s, n), given the components of linked sets."""
    least = rows.where("s is not null").groupBy("s").agg(F.min("doc_id").alias("least"))
    least = cut(least.join(components.select("node", "component"), F.col("s") == F.col("node"), "left").select("s", "least", F.coalesce("component", "s").alias("root")))
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of = least.join(ids, "root").select(F.col("s").alias("of"), "component_id")
    found = rows.join(of, F.col("s") == F.col("of"), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("s").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
