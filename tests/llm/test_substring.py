import hashlib
import random
from collections import defaultdict

import numpy as np

from sieveline.llm import substring


def brute(rows, span=20):
    seen, out = set(), []
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, sha(rows[k][1])))
    done = {}
    for k in order:
        i, text = rows[k]
        if (i, text) in done:
            out.append(done[i, text])
            continue
        w = (text or "").encode().split()
        gone = set()
        for p in range(len(w) - span + 1):
            win = tuple(w[p : p + span])
            if win in seen:
                gone |= set(range(p, p + span))
            seen.add(win)
        keep = [x for p, x in enumerate(w) if p not in gone]
        done[i, text] = (i, len(w), len(gone), hashlib.sha256(b" ".join(keep)).hexdigest())
        out.append(done[i, text])
    return sorted(out, key=str)


def run(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.factors(df).collect()), key=str)


def test_parse():
    p = lambda at, source, offset: substring.parse(np.array(at), np.array(source), np.array(offset), 20)
    assert p([7, 5, 6], [1, 1, 1], [9, 7, 8]) == [(5, 22, 1, 7)]
    # A window that crosses a factor's end begins the next one; windows of another source within it don't.
    assert p([0, 1, 2, 15, 40], [1, 1, 2, 3, 3], [0, 1, 9, 4, 4]) == [(0, 21, 1, 0), (2, 20, 2, 9), (15, 20, 3, 4), (40, 20, 3, 4)]
    assert p([0, 1, 2, 3], [1, 1, 2, 1], [0, 1, 9, 3]) == [(0, 21, 1, 0), (2, 20, 2, 9), (3, 20, 1, 3)]
    assert p([], [], []) == []


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_words_that_sums_of_powers_confuse(spark):
    rows = []
    for n in (16, 1024, 4096):
        a, b = thue_morse(n)
        rows += [(len(rows) + k, " ".join([*(f"{n}-{i}" for i in range(19)), word])) for k, word in enumerate((a, b, a))]
    # The same for windows of words.
    a, b = (" ".join(x) for x in thue_morse(64))
    rows += [(11, a + " " + "y " * 9), (12, "z " * 5 + b), (13, a)]
    want = brute(rows)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == want and [r[2] for r in sorted(want) if r[0] < 9] == [0, 0, 20] * 3


def test_factors_are_checked_by_their_words(spark, monkeypatch):
    """With hashes that at first tell no words apart all windows meet; the check finds them and other hashes follow."""
    whole, seeds = substring.word_hashes, set()
    monkeypatch.setattr(substring, "map_rows", lambda df, f, schema, rows=512, lists=(): inline(spark, df, f, schema, lists))

    def weak(raw, seed=0):
        seeds.add(seed)
        h = whole(raw, seed)
        return h * np.uint64(0) if seed < 2 else h

    monkeypatch.setattr(substring, "word_hashes", weak)
    rnd = random.Random(3)
    rows = [(i, " ".join(str(rnd.randrange(40)) for _ in range(60))) for i in range(30)]
    rows += [(40, rows[3][1] + " end")]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert 2 in seeds


def inline(spark, df, f, schema, lists):
    """map_rows() in this process, so that what the test replaces is seen."""
    import pyarrow as pa

    from sieveline.llm.common import Lists

    got = df.toArrow().combine_chunks()
    cols = [got.column(c).combine_chunks() for c in got.column_names]
    out = f()([Lists(c) if name in lists else c.to_pylist() for name, c in zip(got.column_names, cols)]) if got.num_rows else []
    return spark.createDataFrame([*zip(*(c.to_pylist() if isinstance(c, pa.Array) else c for c in out))], schema)


def test_factors_name_an_earlier_place(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 80")
    words = {r.doc_id: (r.text or "").encode().split() for r in docs.collect()}
    n = 0
    for r in substring.factors(docs).collect():
        for f in r.factors:
            n += 1
            assert (f.source, f.offset) < (r.doc_id, f.start) and f.length >= 20
            assert words[f.source][f.offset : f.offset + f.length] == words[r.doc_id][f.start : f.start + f.length]
    assert n > 10


def test_many_rows_without_an_own_id(spark):
    """Rows of no id and of one id, each with a start that all share, and rows that repeat others."""
    start = " ".join(map(str, range(30)))
    rows = [(None if i % 2 else 7, f"{start} {i} " + f"w{i} " * 20) for i in range(10_000)] + [(7, f"{start} 0 " + "w0 " * 20)] * 500
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_against_brute_force(spark):
    rnd = random.Random(6)
    passages = [[rnd.choice("abcdefgh") * rnd.randrange(1, 3) + str(rnd.randrange(30)) for _ in range(rnd.randrange(18, 60))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rnd.randrange(6)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            w += p[a:] if rnd.random() < 0.5 else p[: a + 1]
            w += [str(rnd.randrange(1000)) for _ in range(rnd.randrange(4))]
        rows.append((i * 3 % 151, rnd.choice([" ", "\n", "  "]).join(w)))
    rows += [(500, "x " * 100), (501, "x y " * 60), (502, None), (503, ""), (504, " ".join(map(str, range(19)))), (505, " ".join(map(str, range(20)))), (506, " ".join(map(str, range(20))))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    assert run(docs.repartition(5)) == brute(rows)
    assert run(docs.limit(0)) == []


def test_repeated_rows_and_null_ids(spark):
    t = " ".join(map(str, range(50)))
    for rows in ([(1, t), (1, t), (3, "q " * 19)], [(1, t), (None, t), (None, t + " a"), (None, None), (None, "")], [(1, t + " b"), (1, t + " c"), (None, t)]):
        assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_long_text(spark):
    w = [str(i) for i in range(300_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[1000:2000] + ["z"]))]
    got = defaultdict(int, {g[0]: g[2] for g in run(spark.createDataFrame(rows, "doc_id long, text string"))})
    assert got[1] == 0 and got[2] == 1000
