import random

import numpy as np
import xxhash

from sieveline.llm import simhash


def plain(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[top(b)] = top(a)
    low = {}
    for i, f in rows:
        if i is not None:
            low[top(f)] = min(low.get(top(f), i), i)
    return sorted(((i, f, low.get(top(f))) for i, f in rows), key=str)


def near_fps(rnd, n):
    out = []
    for _ in range(n // 8):
        f = rnd.getrandbits(64)
        for _ in range(8):
            out.append(f)
            for b in rnd.sample(range(64), rnd.randrange(5)):
                f ^= 1 << b
    dense = rnd.getrandbits(64)
    return out + [dense ^ sum(1 << b for b in set(rnd.sample(range(64), rnd.randrange(6)))) for _ in range(n)]


def test_fingerprint():
    rnd = random.Random(1)
    for t in [None, "", " \n", "A", "a B", "a b c", "É é É x", "x  y\tz w"] + [" ".join(rnd.choice("abCDéÉ") for _ in range(rnd.randrange(40))) for _ in range(50)]:
        assert simhash.fingerprint(t) == plain(t)
    assert simhash.fingerprint("w " * 200_000) == plain("w w w")


def test_bound_is_below_hamming():
    rnd = np.random.default_rng(2)
    a = rnd.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rnd.integers(0, 64, 4000, dtype=np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 4000, dtype=np.uint64))
    low = simhash.bound(simhash.embedding(a), simhash.embedding(b))
    assert (low <= np.bitwise_count(a ^ b)).all()
    counts = lambda x: np.array([[bin(int(v) >> 2 * s & 3).count("1") for s in range(32)] for v in x[:200]])
    assert (np.abs(counts(a) - counts(b)).sum(axis=1) == low[:200]).all()


def test_links_find_every_component(spark):
    rnd = random.Random(5)
    rows = [(i, f) for i, f in enumerate(near_fps(rnd, 700))]
    rows += [(5000 + i, rows[i][1]) for i in range(100)] + [(None, rows[3][1]), (None, 12345)]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    found = spark.createDataFrame([(i, signed(f)) for i, f in rows], "doc_id long, fp long")
    from sieveline.operators.graph import connected_components

    for tile, width in ((2048, 2), (20, 2), (20, 1)):
        got = simhash.label(found, connected_components(simhash.links(found, tile_rows=tile, width=width)))
        assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got.collect()), key=str) == brute(rows)


def test_table(spark):
    rows = [(3, "a b c d", 1), (9, "A b  c D", 1), (4, None, 1), (2, "", 1), (5, "other words stand here now", 1), (5, "other words stand here now", 1), (None, "a b c d", 1), (8, "long " * 300_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute([(i, plain(t)) for i, t, _ in rows])
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_query(spark, sf):
    from sieveline.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in QUERIES["op4_simhash"](spark, sf).collect()), key=str)
    assert got == brute([(i, plain(t)) for i, t in rows])


def test_keep_one(spark):
    rows = [(3, "a b c d", 1), (9, "A b  c D", 2), (4, None, 3), (2, "", 4), (5, "other words stand here now", 5), (5, "other words stand here now", 5), (None, "a b c d", 6), (None, "q r s t u", 7), (None, "q r s t u", 7), (5, "x y z z y", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(map(tuple, simhash.keep_one(docs).collect()), key=str)
    assert got == sorted([rows[0], rows[3], rows[4], rows[7], rows[9]], key=str)
    assert simhash.keep_one(docs.limit(0)).collect() == []


def test_every_pair_of_similar_sets_is_linked(spark):
    """Groups of near copies around the threshold, in which the bands' representatives leave some pairs apart."""
    rnd, rows = random.Random(1), []
    for _ in range(12):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([60, 100, 160]))]
        for _ in range(25):
            t = [*base]
            for i in rnd.sample(range(len(t)), max(1, len(t) // 50)):
                t[i] = f"x{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    fps = [plain(t) for _, t in rows]
    up = [*range(len(rows))]

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similar=0.8).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, top(i)) for i in range(len(rows))]


#: Names of inner columns of any stage; a table may have columns of all these names.
CLASHING = "k i c s copies rows key check __check fp root component component_id least of size target at n prefix sketch bands group blob path u f hit t w src dst node x y"


def with_clashes(df, *own):
    from pyspark.sql import functions as F

    return df.select(*own, *(F.lit(f"#{name}").alias(name) for name in CLASHING.split() if not name.startswith("__")))


def test_extra_columns_of_any_name(spark):
    """Every stage and table operator passes extra columns through, or ignores them."""
    import datetime

    import corpus_pipeline as cp
    from sieveline.llm import urlfilter

    rows = [(1, "the cat sat on the mat and it was that of the house", "en", "a", 1), (2, "the cat sat on the mat and it was that of the house", "en", "b", 1), (3, None, "en", None, 1), (None, "", None, "a", 1)]
    plain_docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = with_clashes(plain_docs, *plain_docs.columns)
    for name, stage in cp.STAGES:
        out, alone = stage(spark, docs, ""), stage(spark, plain_docs, "")
        assert out.columns == (alone.columns if name == "bpe" else docs.columns)
        assert sorted(map(str, out.select(*alone.columns).collect())) == sorted(map(str, alone.collect()))
    captures = spark.createDataFrame([(1, "http://a.b/c", datetime.date(2023, 5, 1))], "id long, url string, fetched date")
    entries = spark.createDataFrame([("a.b", datetime.date(2023, 1, 1), "block")], "pattern string, at date, action string")
    found = urlfilter.verdicts(with_clashes(captures, "id", "url", "fetched"), entries)
    assert found.collect() == urlfilter.verdicts(captures, entries).collect()
