"""Substring dedup by relative Lempel-Ziv parsing against the corpus before.

The corpus, read in the order of doc_id, is the reference. Its windows of ``span`` words are indexed
by 128 bits of hash, each with the first place where it stands, and the index is cut into blocks. A
document is looked up in every block; then it is factored greedily: a factor follows its source,
an earlier place, for as many words as the first places of its windows follow each other, and
windows that cross a factor's end are looked up like all others and begin the next one. All
words of factors are duplicates. Each factor is checked against the words at its source; if any
differs, all is done again with other hashes.

The index needn't hold every window of the corpus. Any window holds an anchor: of its runs of
``gram`` words the one with the least hash. A window that occurs twice has the same anchor at both
places, so windows of an anchor that occurs once are literals, and only the windows of repeated
anchors are indexed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import map_rows, mixed, word_hashes
from sieveline.operators.order import ranked
from sieveline.storage import cut, drop

SPAN, GRAM = 20, 8
#: Blocks of the index, looked up one after the other; they bound what is on disk at a time.
BLOCKS = 4
#: Factors that are checked against one copy of their source's text.
CHECKED = 4096
_LAST = (1 << 63) - 1
#: Bits of a place in the order of anchors; the hash's other bits come first.
_PLACE = 31


def joined(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbours of h, put together from runs of 1, 2, 4, ..., scrambled at each step."""
    out, done, part, wide = None, 0, h, 1
    while True:
        if n & wide:
            m = len(h) - done - wide + 1
            out = part if out is None else mixed(out[:m] * np.uint64(0xAF251AF3B0F025B5) + part[done : done + m])
            done += wide
        if done == n:
            return out[: len(h) - n + 1]
        part = mixed(part[:-wide] * np.uint64(0x9E3779B97F4A7C15) + part[wide:])
        wide *= 2


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n neighbours of x."""
    wide = 1
    while 2 * wide <= n:
        x = np.minimum(x[: len(x) - wide], x[wide:])
        wide *= 2
    return np.minimum(x[: len(x) - (n - wide)], x[n - wide :]) if n > wide else x


def anchors(h: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a text the place of its anchor; and the hash of the run at each place."""
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = joined(h, gram)
    place = np.uint64((1 << _PLACE) - 1)
    # Of equal hashes the leftmost; that is the same one wherever the window stands.
    return (_least((g & ~place) | np.arange(len(g), dtype=np.uint64), span - gram + 1) & place).astype(np.int64), g


def _places(of_window: np.ndarray) -> np.ndarray:
    """The different anchors of a text, by place."""
    return of_window[np.flatnonzero(np.append(True, of_window[1:] != of_window[:-1]))] if len(of_window) else of_window


def _named(key: int) -> np.ndarray:
    """A hash that stands for a document itself."""
    return mixed(np.array([(key * 0xD6E8FEB86659FD93 + 0x589965CC75374CC3) & (1 << 64) - 1], np.uint64))


def _firsts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each window of a text, given by two hashes, the index of the first equal one."""
    order = np.lexsort((b, a))
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])) if len(a) else np.zeros(0, bool)
    out = np.empty(len(a), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # the sort is stable: a run begins with its leftmost
    return out


def parse(place: np.ndarray, source: np.ndarray, offset: np.ndarray, span: int) -> list[tuple[int, int, int, int]]:
    """Factors (start, length, source, offset) from windows with an earlier place: places in any order.

    A factor goes on while the next window stands right after it at the source. One whose words lie
    all in the factors before is left out.
    """
    place, first = np.unique(place, return_index=True)
    source, offset = source[first], offset[first]
    edge = np.flatnonzero(np.append(True, (np.diff(place) != 1) | (np.diff(source) != 0) | (np.diff(offset) != 1))) if len(place) else place
    out, end = [], 0
    for a, b in zip(edge, np.append(edge[1:], len(place)) - 1):
        if (stop := int(place[b]) + span) > end:
            out.append((int(place[a]), stop - int(place[a]), int(source[a]), int(offset[a])))
            end = stop
    return out


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, text) of docs, and the same with one row for each key: key, a number, orders documents by id, null last, and of those that
    share an id by the SHA-256 of the text (a null text is empty); rows equal in both share a key. Without
    repeated ids the key is the id itself."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(_LAST)))
    if docs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs, docs
    docs = docs.select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    named = ranked(docs.select("doc_id", "sha").distinct(), F.asc_nulls_last("doc_id"), F.asc("sha"), name="key").select(F.col("doc_id").alias("i"), F.col("sha").alias("s"), F.col("key").cast("long").alias("key"))
    docs = docs.join(named, (F.col("sha") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("i"))).select("doc_id", "text", "key")
    return docs, docs.dropDuplicates(["key"])


def _literals(docs: DataFrame, span: int, gram: int, seed: int) -> DataFrame:
    """(key, single): places of the anchors that no other place of the corpus has, and the number of all of
    the document's anchors as -1 - n."""

    def start():
        def run(cols):
            keys, at, hashes = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for key, text in zip(*cols):
                of_window, g = anchors(word_hashes(text.encode(), seed), span, gram)
                own = _places(of_window)
                keys.append(np.full(len(own) + 1, key))
                at += [own, [-1 - len(own)]]
                hashes += [g[own], _named(key)]
            return [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(np.concatenate(at).astype(np.int32))]

        return run

    found = map_rows(docs.select("key", "text"), start, "anchor long, key long, place int")
    # One row with the anchor's count is enough: of an anchor that occurs once the least is the only one.
    single = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("place").alias("place")).where("n = 1")
    return single.groupBy("key").agg(F.collect_list("place").alias("single"))


def _with(docs: DataFrame, more: DataFrame, how: str = "left") -> DataFrame:
    """docs with the columns of more, joined by key without sorting the texts."""
    return docs.join(more.withColumnRenamed("key", "k").hint("shuffle_hash"), F.col("key") == F.col("k"), how).drop("k")


def _windows(docs: DataFrame, single: DataFrame, span: int, gram: int, seed: int) -> DataFrame:
    """(one, two, key, place, again) of every window with a repeated anchor: its hashes and place. again is
    the first place of the same window in the document, -1 at that place itself."""

    def start():
        def run(cols):
            none = np.zeros(0, np.int64)
            parts = [(none.view(np.uint64), none.view(np.uint64), none, none, none)]
            for key, text, (single,) in zip(*cols):
                single = single.astype(np.int64)
                own = single[single >= 0]
                if len(own) < len(single) and -1 - single.min() == len(own):
                    continue
                raw = text.encode()
                h = word_hashes(raw, seed)
                of_window, _ = anchors(h, span, gram)
                known = np.zeros(len(h) + 1, bool)
                known[own] = True
                starts = np.flatnonzero(~known[of_window])
                if len(starts):
                    one, two = joined(h, span)[starts], joined(word_hashes(raw, seed + 1), span)[starts]
                    first = _firsts(one, two)
                    again = np.where(first == np.arange(len(starts)), -1, starts[first])
                    parts.append((one, two, np.full(len(starts), key), starts, again))
            one, two, keys, at, again = (np.concatenate(x) for x in zip(*parts))
            return [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(keys), pa.array(at.astype(np.int32)), pa.array(again.astype(np.int32))]

        return run

    return map_rows(_with(docs.select("key", "text"), single).select("key", "text", "single"), start, "one long, two long, key long, place int, again int", lists=("single",))


def _sources(windows: DataFrame, blocks: int) -> DataFrame:
    """(key, place, source, offset): windows that stand earlier, with the first place.

    The index's blocks are hash ranges. In each, first places come from an aggregation with partial sums;
    only windows of two or more documents stay in it, and meet the documents' windows in a plain
    equi-join, which adaptive execution can split where very many documents share a window.
    """
    out = windows.where("again >= 0").select("key", "place", F.col("key").alias("source"), F.col("again").alias("offset"))
    for block in range(blocks):
        own = windows.where((F.col("again") < 0) & (F.pmod(F.shiftright("one", 40), F.lit(blocks)) == block)).drop("again")
        first = own.groupBy("one", "two").agg(F.count("*").alias("n"), F.min("key").alias("source"), F.min_by("place", "key").alias("offset")).where("n > 1")
        first = first.select(F.col("one").alias("o"), F.col("two").alias("t"), "source", "offset")
        met = own.join(first, (F.col("one") == F.col("o")) & (F.col("two") == F.col("t")) & (F.col("key") != F.col("source")))
        out = out.unionByName(cut(met.select("key", "place", "source", "offset")))
    return out


def _parsed(docs: DataFrame, sources: DataFrame, span: int) -> DataFrame:
    """Every row with its factors, what is left of it, and a digest of each factor's words."""
    hits = sources.groupBy("key").agg(F.collect_list(F.struct("place", "source", "offset")).alias("hits"))

    def start():
        def run(cols):
            out = []
            for text, (place, source, offset) in zip(cols[1], cols[2]):
                every, words, at, removed, found = text.encode().split(), [], 0, 0, []
                if len(place):
                    for a, n, s, o in parse(place, source, offset, span):
                        found.append({"start": a, "length": n, "source": s, "offset": o, "digest": _digest(every[a : a + n])})
                        words += every[at:a]
                        removed += a + n - max(a, at)
                        at = a + n
                words += every[at:]
                out.append((len(every), found, removed, hashlib.sha256(b" ".join(words)).hexdigest()))
            return [cols[0], *([x[i] for x in out] for i in range(4))]

        return run

    factor = "start:int,length:int,source:long,offset:int,digest:binary"
    return map_rows(_with(docs, hits).select("doc_id", "text", "hits"), start, f"doc_id long, n_words long, factors array<struct<{factor}>>, n_removed long, kept_sha256 string", lists=("hits",))


def _differ(docs: DataFrame, parsed: DataFrame) -> bool:
    """Whether any factor's words aren't those at its source. Factors are made distinct first, so copies ask
    once; a source that very many ask for is read in several tasks."""
    asked = parsed.select(F.explode("factors").alias("f")).select("f.source", "f.offset", "f.length", "f.digest").distinct()
    asked = cut(asked)
    slots = asked.groupBy("source").agg(F.ceil(F.count("*") / F.lit(CHECKED)).alias("slots")).withColumnRenamed("source", "s")
    asked = asked.join(slots, F.col("source") == F.col("s")).withColumn("slot", F.pmod(F.xxhash64("offset", "length", "digest"), "slots"))
    lists = asked.groupBy(F.col("source").alias("key"), "slot").agg(F.collect_list(F.struct("offset", "length", "digest")).alias("asked"))

    def start():
        def run(cols):
            out = []
            for text, asked in zip(*cols):
                words = text.encode().split()
                out.append(any(_digest(words[a["offset"] : a["offset"] + a["length"]]) != a["digest"] for a in asked))
            return [out]

        return run

    return not map_rows(_with(docs.select("key", "text"), lists, "inner").select("text", "asked"), start, "bad boolean", rows=64).where("bad").isEmpty()


def factors(docs: DataFrame, span: int = SPAN, gram: int = GRAM, blocks: int = BLOCKS, seed: int = 0) -> DataFrame:
    """(doc_id, n_words, factors array<struct<start,length,source,offset>>, n_removed, kept_sha256) of every row.

    A factor is a run of words that also stands at ``offset`` of the document ``source``, earlier: in a
    smaller doc_id, or before in the same document. n_removed counts the words in factors, which are
    those of all windows of ``span`` words that also start earlier; kept_sha256 is of the others, joined
    by blanks. Windows are judged on the input.

    A null text has no words; texts of under span words have no factor. Rows that repeat id and
    text are one document and get equal results. Rows that share an id with different texts are
    ordered by the SHA-256 of the text; a null id comes after all others (see keyed(); there, source is
    the place of a document in that order instead of its id). An empty table gives an empty result. Texts
    are shuffled by key, which no group shares; windows and anchors by hash, after a partial
    aggregation, so a passage that very many documents share is no hot key.
    """
    rows, once = keyed(docs)
    single = cut(_literals(once, span, gram, seed))
    windows = cut(_windows(once, single, span, gram, seed))
    drop(single)
    found = _sources(windows, blocks)
    parsed = cut(_parsed(rows, found, span))
    drop(found)
    if _differ(once, parsed):
        return factors(docs, span, gram, blocks, seed + 2)
    bare = F.transform("factors", lambda f: F.struct(*(f[c].alias(c) for c in ("start", "length", "source", "offset"))))
    return parsed.withColumn("factors", bare)
