import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from sieveline.llm import ctph


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance():
    rnd = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(14))) for _ in "ab")
        assert ctph.edit_distance(a, b) == slow_distance(a, b), (a, b)
    a, b = ("".join(rnd.choice(ctph.LETTERS) for _ in range(150)) for _ in "ab")
    assert ctph.edit_distance(a, b) == slow_distance(a, b)


def test_fingerprints():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(n)) for n in (40, 200, 1000, 5000)]
    for t in texts:
        f = ctph.fingerprint(t)
        block, one, _ = f.split(":")
        assert f == ctph.fingerprint(t) and 32 <= len(one) <= 130 or block == "3"
        assert ctph.likeness(f, f) == 1.0
        changed = ctph.fingerprint(t[: len(t) // 2] + word() + t[len(t) // 2 :])
        assert ctph.likeness(f, changed) > 0.85
        assert ctph.likeness(f, ctph.fingerprint(" ".join(word() for _ in t.split()))) < 0.4
    assert ctph.fingerprint(None) == ctph.fingerprint("") == "3::"
    assert ctph.likeness("3::", ctph.fingerprint("x" * 9)) == 0.0
    for t in ("x" * 100_000, "long text " * 20_000, "ab" * 70):
        assert all(len(x) <= 130 for x in ctph.fingerprint(t).split(":"))
    assert 0 <= ctph.likeness(ctph.fingerprint("a"), ctph.fingerprint("b")) <= 1
    assert ctph.likeness(ctph.fingerprint(texts[0]), ctph.fingerprint(texts[3])) == 0.0


def slow_fingerprint(text):
    """The definition, byte by byte."""
    raw, m64 = (text or "").encode(), (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & m64
        x = (x ^ x >> 29) * 0xC4CEB9FE1A85EC53 & m64
        return x ^ x >> 32

    roll, seen = [], [0] * 7
    for b in raw:
        seen = [*seen[1:], b]
        h = 0
        for c in seen:
            h = (h * 0x100000001B3 + c + 1) & m64
        roll.append(mix(h))

    def sign(block):
        out, total, open_ = "", 0, False
        for h in roll:
            total, open_ = (total + h) & m64, True
            if h % block == block - 1:
                out, total, open_ = out + ctph.LETTERS[mix(total) >> 58], 0, False
        return out + (ctph.LETTERS[mix(total) >> 58] if open_ else "")

    block = 3
    while block * 64 < len(raw):
        block *= 2
    while len(sign(block)) > 128:
        block *= 2
    while len(sign(block)) < 32 and block > 3 and len(sign(block // 2)) <= 128:
        block //= 2
    return f"{block}:{sign(block)}:{sign(2 * block)}"


def slow_likeness(a, b):
    if a == b:
        return 1.0
    best = 0.0
    (ba, *sa), (bb, *sb) = a.split(":"), b.split(":")
    for i, x in enumerate(sa):
        for j, y in enumerate(sb):
            if int(ba) << i == int(bb) << j and max(len(x), len(y)):
                best = max(best, 1 - slow_distance(x, y) / max(len(x), len(y)))
    return best


def test_fingerprint_and_likeness_by_definition():
    rnd = random.Random(7)
    texts = [None, "", "a", "x" * 900] + ["".join(rnd.choice("abc é\n") for _ in range(rnd.randrange(1500))) for _ in range(12)]
    texts += [t[: len(t) // 2] + "zz" + t[len(t) // 2 :] for t in texts[4:]]
    made = [ctph.fingerprint(t) for t in texts]
    assert made == [slow_fingerprint(t) for t in texts]
    for a in made[::3]:
        for b in made[::2]:
            assert abs(ctph.likeness(a, b) - slow_likeness(a, b)) < 1e-12


def brute(rows):
    signed = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, signed(r[1]), (r[1] or "").encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        t, u = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        e = t[: len(t) - n] + u[:n]
        f, g, h = map(ctph.fingerprint, (t, e, u))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, ctph.likeness(f, g), ctph.likeness(f, h)))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(map(tuple, ctph.edit_likeness(df, **kw).collect()), key=str)


def test_table(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(-(10**12), 10**12), "".join(rnd.choice("abc é🙂\n") for _ in range(rnd.randrange(200)))) for _ in range(120)]
    rows += [(5, "x"), (5, "a"), (5, "x"), (None, "n"), (None, None), (6, None), (7, ""), (8, "long text " * 200_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int")
    want = brute(rows)
    for p in (1, 9):
        assert run(docs.repartition(3), partitions=p) == want
    assert run(docs.limit(0)) == []
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    assert run(one) == brute([(1, "abcdefgh")])
    some = spark.createDataFrame([(None, "abcdefgh"), (None, "b")], "doc_id long, text string")
    assert run(some) == brute([(None, "abcdefgh"), (None, "b")])


def test_rows_without_an_own_id_are_cut_into_ranges(spark):
    rnd = random.Random(4)
    rows = [(None if i % 2 else 7, f"text {rnd.randrange(10**9)} {i}") for i in range(600)] + [(i, "t" * (i % 9)) for i in range(40)] + [((1 << 63) - 1, "z"), ((1 << 63) - 1, "y")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = run(docs, partitions=4)
    assert len(got) == len(rows)
    # Rows of the greatest long aren't told apart from each other by a check; all others follow the order.
    some = [r for r in rows if r[0] != (1 << 63) - 1]
    assert run(spark.createDataFrame(some, "doc_id long, text string"), partitions=4) == brute(some)
    place = docs.select(F.coalesce("doc_id", F.lit(ctph._LAST)).alias("key"), F.xxhash64("text").alias("check"))
    keys, checks = ctph._bounds(place, 32)
    found = place.groupBy(ctph._ranges(keys, checks)("key", "check").alias("r")).count().collect()
    assert max(r["count"] for r in found) < 60


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = run(docs)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(g[5] > g[6] for g in got) > 0.9 * len(got)
