"""Language-model scores from a log-frequency Bloom filter.

The filter holds quantised counts: an n-gram seen c times is put in once for each level up to
floor(log2 c) + 1, so its count is read by probing level after level until one is missing.
It never takes a count for lower than it is, and rarely for higher. The filter grows with the
number of n-grams and holds all of them. Executors build it in blocks and it stays a table:
texts are dealt into buckets, a bucket's different words and pairs travel to the shards of
the filter as packed lists, and only their levels travel back. The counts of the word and of
the pair of words at every place of a text give smoothed probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sieveline.llm.common import SPACE, give_back, mixed, word_hashes
from sieveline.storage import cut, drop

#: Hashes that stand for the edges of a text; no word is known to have them.
END, START = 0x6A09E667F3BCC908, 0xBB67AE8584CAA73B
#: Largest size of the broadcast table of exact word counts.
TABLE_WORDS = 1 << 20
#: Bits an entry of the filter takes, positions it sets, bits of a block.
ENTRY_BITS, PROBES, BLOCK_BITS = 8, 4, 1 << 15
#: Blocks of a shard of the filter, and bytes of text of a bucket, at most; a task's memory goes by these.
SHARD_BLOCKS, BUCKET_BYTES = 256, 8 << 20
#: Least count of a pair of words that is put in, and the pairs' share of a probability: of the shares
#: .1, .2, .3 and .5 those of .2 and .3 gave held-out documents of the test tables the most.
LEAST_PAIR, PAIR_SHARE = 1, 0.25
#: Tokens that a task counts at a time before it passes the counts on.
COMBINED = 4_000_000
#: Bytes of texts whose words are hashed together.
TOGETHER = 1 << 17
#: Rows of a batch of counts; the JVM holds a whole batch outside its heap.
SENT_GRAMS = 1 << 16


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words in lower case (A-Z), then that of its end."""
    return np.append(word_hashes((text or "").encode().lower()), np.uint64(END))


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of texts one after the other, and how many each has. About TOGETHER bytes are hashed at a time, as a
    call for each text costs more than the words of a short one."""
    found, sizes, some, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], 0

    def flush():
        raw = b" ".join(some)
        words = word_hashes(raw)
        inside = ~SPACE[np.frombuffer(raw, np.uint8)]
        begin = np.flatnonzero(inside & np.append(True, ~inside[:-1])[: len(inside)])
        edge = np.cumsum([len(x) + 1 for x in some])
        size = np.diff(np.searchsorted(begin, edge), prepend=0) + 1
        t, word = np.full(len(words) + len(some), np.uint64(END)), np.ones(len(words) + len(some), bool)
        word[np.cumsum(size) - 1] = False
        t[word] = words
        found.append(t)
        sizes.append(size)
        some.clear()

    for text in texts:
        some.append((text or "").encode().lower())
        n += len(some[-1])
        if n >= TOGETHER:
            flush()
            n = 0
    if some:
        flush()
    return np.concatenate(found), np.concatenate(sizes)


def pairs(t: np.ndarray, starts: np.ndarray | int = 0) -> np.ndarray:
    """Hashes of the pairs of tokens that follow each other; a text's first with the start."""
    before = np.concatenate([np.zeros(1, np.uint64), t[:-1]])
    before[starts] = START
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + t)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each n-gram with its count, of COMBINED tokens (or of 256 texts that have more) at a time, SENT_GRAMS to a batch."""
    ones, twos, n = np.empty(COMBINED, np.uint64), np.empty(COMBINED, np.uint64), 0

    def flush():
        for pair, grams in ((False, ones[:n]), (True, twos[:n])):
            grams.sort()  # in its place: a copy of all tokens would be as large again
            edge = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            for at in range(0, len(edge), SENT_GRAMS):
                some, end = edge[at : at + SENT_GRAMS], edge[at + SENT_GRAMS] if at + SENT_GRAMS < len(edge) else n
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), pair)), pa.array(grams[some].view(np.int64)), pa.array(np.diff(some, append=end))], names=["pair", "gram", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            t, size = tokens_of(batch.column(0).slice(at, 256).to_pylist())
            if n and n + len(t) > len(ones):
                yield from flush()
                n = 0
            if len(t) > len(ones):
                ones, twos = np.empty(len(t), np.uint64), np.empty(len(t), np.uint64)
            ones[n : n + len(t)], twos[n : n + len(t)] = t, pairs(t, np.cumsum(size) - size)
            n += len(t)
    if n:
        yield from flush()
    ones = twos = t = None
    give_back()


def level(n: Column) -> Column:
    """floor(log2 n) for n of 1 or more, exactly."""
    return (F.length(F.bin(n)) - 1).cast("int")


@dataclass
class Model:
    """What scoring needs: totals, the filter as a table, exact counts of frequent words, the rest as a table."""

    tokens: int
    words: int
    mass: float  # of all words' own counts: the sum of least counts with one added, and one for all others
    first: tuple[int, int]  # least level held for words and for pairs
    blocks: int  # of the filter
    filter: DataFrame  # block, bits of all blocks that have any
    frequent: tuple[np.ndarray, np.ndarray]  # sorted hashes and counts
    rare: DataFrame  # gram, n of all other words

    @cached_property
    def bits(self) -> np.ndarray:
        """The filter's bytes, gathered; for small models only, score() doesn't do it."""
        return _placed(self.filter.toArrow(), 0, self.blocks)


def _placed(rows: pa.Table, low: int, blocks: int) -> np.ndarray:
    """The bytes of so many blocks from block ``low`` on, of rows with columns block and bits."""
    size = BLOCK_BITS // 8
    bits = np.zeros(blocks * size, np.uint8)
    for at, own in zip(rows.column("block").to_pylist(), rows.column("bits").to_pylist()):
        bits[(at - low) * size : (at - low + 1) * size] = np.frombuffer(own, np.uint8)
    return bits


def block_of(gram: np.ndarray, blocks: int) -> np.ndarray:
    """The block of the filter in which all bits of an n-gram lie; blocks follow the order of n-grams."""
    return ((gram >> np.uint64(33)) * np.uint64(blocks) >> np.uint64(31)).astype(np.int64)


def bit_of(gram: np.ndarray, at: int, j: int) -> np.ndarray:
    """The j-th bit of level ``at`` within a block."""
    h = mixed(gram + np.uint64((at + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return ((h + ((h >> np.uint64(40)) | np.uint64(1)) * np.uint64(j)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


def _build(blocks: int, first: tuple[int, int]):
    """For partitions sorted by block: the bits of each block, sent when the next one begins, so a task holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = -1, np.zeros(BLOCK_BITS, bool)

        def made():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            gram, top, pair = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            gram = gram.view(np.uint64)
            block = block_of(gram, blocks)
            edge = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, int)
            least = np.where(pair, first[1], first[0])
            for a, b in zip(edge.tolist(), np.append(edge[1:], len(block)).tolist()):
                if block[a] != now:
                    if now >= 0:
                        yield made()
                    now, bits = int(block[a]), np.zeros(BLOCK_BITS, bool)
                for at in range(min(first), int(top[a:b].max()) + 1):
                    some = gram[a:b][(top[a:b] >= at) & (least[a:b] <= at)]
                    for j in range(PROBES):
                        bits[bit_of(some, at, j)] = True
        if now >= 0:
            yield made()
        batch = gram = block = bits = some = None
        give_back()

    return run


def train(docs: DataFrame, filter_bytes: int | None = None, table_words: int = TABLE_WORDS, least_pair: int = LEAST_PAIR) -> Model:
    """The model of every text of docs (a null text is empty: its end counts).

    All words and pairs are counted. The filter takes ENTRY_BITS for each level of each n-gram, so
    it grows with the corpus at the same rate of errors, and leaves none out. Only where a caller
    sets filter_bytes, rarer pairs and then rarer words are left out down to that size, a power of
    two at a time, as a histogram of the counts says. Exact counts are broadcast for the most
    frequent words, up to table_words; the rest stay a table.
    """
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts, "pair boolean, gram long, n long")
    counted = counted.groupBy("pair", "gram").agg(F.sum("n").alias("n")).where(~F.col("pair") | (F.col("n") >= least_pair))
    counted = cut(counted.withColumn("level", level(F.col("n"))))
    rows = counted.groupBy("pair", "level").agg(F.count("*").alias("grams"), F.sum("n").alias("n")).collect()
    grams = {(r["pair"], r["level"]): r["grams"] for r in rows}
    total, words = sum(r["n"] for r in rows if not r["pair"]), sum(r["grams"] for r in rows if not r["pair"])
    top = max((lv for _, lv in grams), default=0)

    first = [0, 0]
    held = lambda pair: sum(n * (lv - first[pair] + 1) for (p, lv), n in grams.items() if p == pair and lv >= first[pair])
    while filter_bytes is not None and (held(0) + held(1)) * ENTRY_BITS > filter_bytes * 8:
        first[1 if first[1] <= first[0] + 1 and held(1) else 0] += 1
    blocks = max(1, -(-(held(0) + held(1)) * ENTRY_BITS // BLOCK_BITS))
    own = counted.where(F.col("level") >= F.when(F.col("pair"), first[1]).otherwise(first[0]))
    block = F.shiftright(F.shiftrightunsigned("gram", 33) * F.lit(blocks), 31)
    made = own.select(block.alias("block"), "gram", "level", "pair").repartition("block").sortWithinPartitions("block").select("gram", "level", "pair").mapInArrow(_build(blocks, tuple(first)), "block long, bits binary")
    made = cut(made)

    lowest = next(lv for lv in range(top + 2) if sum(n for (p, k), n in grams.items() if not p and k >= lv) <= table_words)
    ones = cut(counted.where(~F.col("pair")).select("gram", "n", "level"))
    drop(counted)
    often = ones.where(F.col("level") >= lowest).select("gram", "n").toArrow()
    gram, n = (often.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(gram.view(np.uint64))
    # Words that the broadcast table holds count exactly, those that only the filter holds by its levels.
    own = lambda r: r["n"] if r["level"] >= lowest else r["grams"] * 2.0 ** r["level"] if r["level"] >= first[0] else 0
    mass = float(sum(own(r) for r in rows if not r["pair"]) + words + 1)
    return Model(total, words, mass, tuple(first), blocks, made, (gram.view(np.uint64)[order], n[order]), ones.where(F.col("level") < lowest).select("gram", "n"))


#: By one more than the last level held, 0 for what isn't: the least and the largest count that it can stand for.
LEAST = np.array([0.0, *(2.0**k for k in range(64))])
MOST = np.array([0.0, *(2.0 ** (k + 1) - 1 for k in range(64))])


def _levels(bits: np.ndarray, block: np.ndarray, gram: np.ndarray, first: int) -> np.ndarray:
    """One more than the last level held, 0 for n-grams that level ``first`` doesn't hold; block: where in
    bits the n-gram's block is."""
    out, some, at = np.zeros(len(gram), np.uint8), np.arange(len(gram)), first
    base = block * (BLOCK_BITS // 8)
    while len(some) and at < 64:
        for j in range(PROBES):  # most n-grams that aren't there are known by their first bits
            if not len(some):
                break
            bit = bit_of(gram[some], at, j)
            some = some[(bits[base[some] + (bit >> 3)] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0]
        at += 1
        out[some] = at
    return out


def probe(bits: np.ndarray, gram: np.ndarray, first: int) -> np.ndarray:
    """One more than the last level held of each n-gram, 0 for those that level ``first`` doesn't hold."""
    return _levels(bits, block_of(gram, len(bits) * 8 // BLOCK_BITS), gram, first)


def log10_probabilities(model: Model, t: np.ndarray, starts: np.ndarray | int = 0, pair_share: float = PAIR_SHARE) -> np.ndarray:
    """log10 of each token's probability after the one before it; t: tokens of texts that begin at starts.
    Gathers the filter."""
    known = lambda g: _counts_of(g, probe(model.bits, g, model.first[0]), *model.frequent)
    two = LEAST[probe(model.bits, pairs(t, starts), model.first[1])]
    return _interpolated(model.mass, *known(t), two, known(np.array([END], np.uint64))[1][0], starts, pair_share)


def _counts_of(gram: np.ndarray, levels: np.ndarray, names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest count of each word: its exact one, or what its level can stand for."""
    least, most = LEAST[levels], MOST[levels]
    if len(names):
        at = np.minimum(np.searchsorted(names, gram), len(names) - 1)
        hit = names[at] == gram
        least[hit] = most[hit] = counts[at[hit]]
    return least, most


def _interpolated(mass: float, least: np.ndarray, most: np.ndarray, two: np.ndarray, end: float, starts: np.ndarray | int, pair_share: float) -> np.ndarray:
    """log10 of the pair's part of the first word's count and the word's own probability, interpolated.

    The own probability adds one to a word's least count, over the sum of these for all words (mass),
    which counts one more for all words that aren't known: over the vocabulary it sums up to one. A
    pair's least count is divided by the first word's largest count, so over all words that part sums
    up to one at most, and to one where counts are exact and powers of two: the probabilities never
    exceed one in sum. After a word that isn't known the own probability stands alone. two: least counts
    of the pairs, at most the words' largest; end: largest count of the end, as often as a text ends one
    starts.
    """
    before = np.concatenate([np.zeros(1), most[:-1]])
    before[starts] = end
    two = np.minimum(two, np.minimum(before, most))
    own = (least + 1) / mass
    return np.log10(np.where(before > 0, pair_share * two / np.maximum(before, 1) + (1 - pair_share) * own, own))


def _packed(gram: np.ndarray) -> bytes:
    """Ascending n-grams as differences, their bytes by rank, which compress better."""
    return np.diff(gram, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _asks(blocks: int, shards: int):
    """For a bucket's texts: per shard, the different words and the different pairs it is asked for, packed."""

    def run(part: pa.Table) -> pa.Table:
        rows, (t, size) = [], tokens_of(part.column("text").to_pylist())
        for pair, grams in ((True, pairs(t, np.cumsum(size) - size)), (False, t)):
            grams.sort()  # np.unique() goes through a hash table, which takes many times as long
            grams = grams[np.append(True, grams[1:] != grams[:-1])]
            shard, edge = np.unique(block_of(grams, blocks) * shards // blocks, return_index=True)
            rows += [(s, pair, _packed(g)) for s, g in zip(shard.tolist(), np.split(grams, edge[1:]))]
        shard, pair, grams = zip(*rows)
        bucket = np.full(len(rows), part.column("bucket")[0].as_py(), np.int64)
        return pa.table([pa.array(bucket), pa.array(shard, pa.int64()), pa.array(pair), pa.array(grams, pa.binary())], names=["bucket", "shard", "pair", "grams"])

    return run


def _answers(blocks: int, shards: int, first: tuple[int, int]):
    """For a shard's blocks and all that it is asked: the levels, a byte each in the order of the n-grams."""

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows:
            s = asked.column("shard")[0].as_py()
            low, end = -(-s * blocks // shards), -(-(s + 1) * blocks // shards)
            bits = _placed(own, low, end - low)
            for pair, packed in zip(asked.column("pair").to_pylist(), asked.column("grams").to_pylist()):
                gram = _unpacked(packed)
                found.append(_levels(bits, block_of(gram, blocks) - low, gram, first[pair]).tobytes())
        return pa.table([asked.column("bucket"), asked.column("shard"), asked.column("pair"), pa.array(found, pa.binary())], names=["bucket", "shard", "pair", "levels"])

    return run


def _answered(n: int, rows: list[tuple[int, bytes]]) -> np.ndarray:
    """Levels of a bucket's n different n-grams, ascending, from the answers (shard, levels)."""
    got = np.frombuffer(b"".join(levels for _, levels in sorted(rows)), np.uint8)
    if len(got) != n:
        raise ValueError("the rows that are scored differ from those the filter was asked for")
    return got


def score(docs: DataFrame, model: Model, pair_share: float = PAIR_SHARE) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of docs.

    score is the model's log10 probability of the whole text with its end (see _interpolated()). base_score is that of
    single words with exact counts, one added to each: frequent words are looked up where the
    text is read, the others (known or not) are joined with the table of rare words, on a key of
    which by its making no text of the training rows has many. n_known counts the tokens that the
    training rows have. Null and empty texts are their end alone. Repeated rows get equal
    scores, a null id stays null; an empty table gives an empty result. Texts are shuffled once, by
    bucket; every n-gram of every text is looked up in the shard of the filter that holds it.
    """
    spark = docs.sparkSession
    shared, blocks, mass = spark.sparkContext.broadcast(model.frequent), model.blocks, model.mass
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = min(blocks, max(parts, -(-blocks // SHARD_BLOCKS)))
    schema = "doc_id long, key long, gram long, times long, doc boolean, n_tokens long, n_known long, base double, score double"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def scored(part: pa.Table, answers: pa.Table) -> pa.Table:
        names, counts = shared.value
        ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
        t, size = tokens_of(texts)
        starts = np.cumsum(size) - size
        uniq, where = np.unique(t, return_inverse=True)
        uniq2, where2 = np.unique(pairs(t, starts), return_inverse=True)
        came = [[], []]
        for s, pair, levels in zip(*(answers.column(c).to_pylist() for c in ("shard", "pair", "levels"))):
            came[pair].append((s, levels))
        least, most = _counts_of(uniq, _answered(len(uniq), came[0]), names, counts)
        two = LEAST[_answered(len(uniq2), came[1])][where2]
        at = np.minimum(np.searchsorted(names, uniq), max(0, len(names) - 1))
        hit = names[at] == uniq if len(names) else np.zeros(len(uniq), bool)
        logs = np.zeros(len(uniq))
        logs[hit] = np.log10(counts[at[hit]] + 1.0) if hit.any() else 0.0
        logp = _interpolated(mass, least[where], most[where], two, most[np.searchsorted(uniq, np.uint64(END))], starts, pair_share)
        # Per text, each of its other words with the number of times.
        doc = np.repeat(np.arange(len(texts)), size)
        rest = np.flatnonzero(~hit[where])
        rest = rest[np.lexsort((where[rest], doc[rest]))]
        new = np.flatnonzero(np.append(True, (where[rest][1:] != where[rest][:-1]) | (doc[rest][1:] != doc[rest][:-1]))) if len(rest) else np.zeros(0, np.int64)
        of, rare, times = doc[rest][new], t[rest][new].view(np.int64), np.diff(np.append(new, len(rest)))
        key = np.array([xxhash.xxh64_intdigest(x or "", 7) - (1 << 63) for x in texts], np.int64)
        both = lambda a, b: pa.array(np.concatenate([a, b]))
        none, zero = np.zeros(len(of), np.int64), np.zeros(len(of))
        return pa.table([
            pa.array(ids + [ids[i] for i in of.tolist()], pa.int64()), both(key, key[of]), both(key, rare), both(np.zeros(len(ids), np.int64), times), both(np.ones(len(ids), bool), np.zeros(len(of), bool)),
            both(size, none), both(np.add.reduceat(hit[where].astype(np.int64), starts), none), both(np.add.reduceat(logs[where], starts), zero), both(np.add.reduceat(logp, starts), zero),
        ], schema=target)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = max(parts, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    texts = texts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("long")).repartition(buckets, "bucket")
    asked = texts.groupBy("bucket").applyInArrow(_asks(blocks, shards), "bucket long, shard long, pair boolean, grams binary")
    own = model.filter.withColumn("shard", F.expr(f"block * {shards} div {blocks}"))
    answers = own.groupBy("shard").cogroup(asked.repartition(shards, "shard").groupBy("shard")).applyInArrow(_answers(blocks, shards, model.first), "bucket long, shard long, pair boolean, levels binary")
    rows = texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(scored, schema)
    rare = model.rare.select(F.col("gram").alias("g"), F.col("n").alias("c"))
    rows = rows.join(rare, (F.col("gram") == F.col("g")) & ~F.col("doc"), "left").where("doc or c is not null")
    found = rows.groupBy("doc_id", "key").agg(
        F.count_if("doc").alias("copies"), F.max("n_tokens").alias("n_tokens"), F.min("score").alias("score"), F.max("n_known").alias("often"), F.max("base").alias("base"),
        F.sum(F.when(~F.col("doc"), F.col("times")).otherwise(0)).alias("seldom"), F.sum(F.when(~F.col("doc"), F.col("times") * F.log10(F.col("c") + 1.0)).otherwise(0.0)).alias("more"),
    )
    # Rows with the same id and text come as one, with each rare word as often as there are rows.
    norm = float(np.log10(model.tokens + model.words + 1))
    found = found.select(
        "doc_id", "n_tokens", (F.col("often") + F.col("seldom") / F.col("copies")).cast("long").alias("n_known"),
        (F.col("base") + F.col("more") / F.col("copies") - F.col("n_tokens") * norm).alias("base_score"), "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    return found.drop("copy")
