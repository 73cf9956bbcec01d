import inspect
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sieveline.llm import lm
from sieveline.llm.common import fold, word_hashes
from sieveline.llm.queries import QUERIES


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["\n"]


def base(rows, train):
    c = Counter(w for _, t in train for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in ((i, words(t)) for i, t in rows)), key=str), n


def draw(rnd, n):
    return " ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 4) if rnd.random() < 0.8 else str(rnd.randrange(500)) for _ in range(n))


def got(df):
    return sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in df.collect()), key=str)


def test_table(spark):
    rnd = random.Random(3)
    rows = [(i, draw(rnd, rnd.randrange(60))) for i in range(200)] + [(7, "A aa\tb"), (7, "A aa\tb"), (7, "A aa\tb"), (7, "other 77777"), (None, "x y 3"), (900, None), (901, ""), (902, "a b " * 100_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    train = [r for r in rows if r[0] is None or r[0] % 3]
    part = docs.where("doc_id is null or doc_id % 3 <> 0")
    want, n = base(rows, train)
    for table_words in (1 << 20, 20, 0):
        m = lm.train(part, table_words=table_words)
        assert m.tokens == n and got(lm.score(docs, m)) == want
    assert lm.score(docs.limit(0), m).collect() == []
    empty = lm.train(docs.limit(0))
    assert got(lm.score(docs, empty)) == base(rows, [])[0]


def test_filter_never_counts_too_low(spark):
    rnd = random.Random(4)
    texts = [draw(rnd, 80) for _ in range(150)]
    m = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), least_pair=1)
    ones, twos = Counter(), Counter()
    for t in texts:
        h = lm.tokens(t)
        ones.update(h.tolist())
        twos.update(lm.pairs(h).tolist())
    for counts, first in ((ones, m.first[0]), (twos, m.first[1])):
        g = np.array([*counts], np.uint64)
        est = lm.probe(m.bits, g, first)
        level = np.array([c.bit_length() for c in counts.values()])
        assert (est >= level).all() and (est == level).mean() > 0.9
        assert all(lm.LEAST[x] <= c <= lm.MOST[x] for x, c in zip(level, counts.values()))
    other = np.array([rnd.getrandbits(64) for _ in range(20000)], np.uint64)
    assert (lm.probe(m.bits, other, 0) > 0).mean() < 0.05


def test_filter_is_bounded(spark):
    rnd = random.Random(5)
    docs = spark.createDataFrame([(draw(rnd, 80),) for _ in range(150)], "text string")
    m = lm.train(docs, filter_bytes=1 << 12)
    assert len(m.bits) <= 1 << 12 and max(m.first) > 0
    t = lm.tokens("a b c")
    assert np.isfinite(lm.log10_probabilities(m, t)).all()


def test_every_word_and_pair_is_held_and_scored(spark):
    rnd = random.Random(6)
    texts = [draw(rnd, 80) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    m = lm.train(docs, least_pair=1)
    assert m.first == (0, 0) and m.blocks > 1
    each = [lm.tokens(t) for t in texts]
    for t in each:
        assert (lm.probe(m.bits, t, 0) > 0).all() and (lm.probe(m.bits, lm.pairs(t), 0) > 0).all()
    # The joined shards answer as the gathered filter does.
    want = {i: lm.log10_probabilities(m, t).sum() for i, t in enumerate(each)}
    found = {r.doc_id: r.score for r in lm.score(docs, m).collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[i], want[i], rel_tol=1e-9) for i in want)
    # The filter has no fixed size: it grows with the rows.
    assert inspect.signature(lm.train).parameters["filter_bytes"].default is None
    more = [(draw(rnd, 80),) for _ in range(600)]
    grown = lm.train(spark.createDataFrame(more, "text string"), least_pair=1)
    assert grown.first == (0, 0) and grown.blocks > m.blocks


def test_pairs_seen_once_are_held(spark):
    m = lm.train(spark.createDataFrame([("some words follow each other once",)], "text string"))
    t = lm.tokens("some words follow each other once")
    assert (lm.probe(m.bits, lm.pairs(t), m.first[1]) > 0).all()


def brute_model(train, table_words=10**9, share=lm.PAIR_SHARE):
    """log10 probability of a text under counts of which pairs are rounded down to powers of two, in plain Python."""
    ones, twos = Counter(w for t in train for w in words(t)), Counter()
    for t in train:
        w = ["<s>", *words(t)]
        twos.update(zip(w, w[1:]))
    lowest = next(k for k in range(64) if sum(c >= 2**k for c in ones.values()) <= table_words)
    exact = lambda c: c.bit_length() - 1 >= lowest
    least = {w: c if exact(c) else 2 ** (c.bit_length() - 1) for w, c in ones.items()}
    most = {w: c if exact(c) else 2 ** c.bit_length() - 1 for w, c in ones.items()}
    mass = sum(least.values()) + len(ones) + 1

    def p(before, w):
        own, ctx = (least.get(w, 0) + 1) / mass, most.get("\n" if before == "<s>" else before, 0)
        two = twos[before, w] and 2 ** (twos[before, w].bit_length() - 1)
        return share * min(two, ctx, most.get(w, 0)) / ctx + (1 - share) * own if ctx else own

    return p, [*ones]


@pytest.fixture
def faultless(monkeypatch):
    """A filter so sparse that it gives no n-gram that it doesn't hold."""
    monkeypatch.setattr(lm, "ENTRY_BITS", 256)


def test_score_against_brute_force(spark, faultless):
    rnd = random.Random(11)
    texts = [draw(rnd, rnd.randrange(1, 60)) for _ in range(120)] + ["a b c " * 40, "", None]
    rows = [*enumerate(texts)] + [(500, "never 99999 seen a b"), (501, None), (502, "a never b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for table_words in (1 << 20, 15, 0):
        m = lm.train(docs.where("doc_id < 100"), table_words=table_words)
        p, _ = brute_model(texts[:100], table_words)
        want = {i: sum(math.log10(p(a, b)) for a, b in zip(["<s>", *words(t)], words(t))) for i, t in rows}
        got = {r.doc_id: r.score for r in lm.score(docs, m).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-9) for i in want)


def sums(m, vocabulary, contexts):
    """For each word before: the sum of the probabilities of all known words, the end and all others as one."""
    h = {w: np.uint64(lm.END) if w == "\n" else lm.tokens(w)[0] for w in vocabulary}
    h["unseen"] = lm.tokens("unseen-99999")[0]
    out = {}
    for c in contexts:
        before = lm.tokens(c)[0]
        out[c] = sum(10 ** lm.log10_probabilities(m, np.array([before, x], np.uint64))[1] for x in h.values())
    return out


def test_probabilities_sum_to_one(spark, faultless):
    # Each pair was seen once, twice or four times: nothing is rounded.
    texts = ["a b c d", "a c b d", "e f e f", "b a g", "g a h"] * 4
    m = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    _, known = brute_model(texts)
    got = sums(m, known, [w for w in known if w != "\n"] + ["unknown"])
    assert all(abs(s - 1) < 1e-6 for s in got.values()), got


def test_probabilities_never_exceed_one_in_sum(spark, faultless):
    rnd = random.Random(12)
    texts = [draw(rnd, 50) for _ in range(60)]
    for table_words in (1 << 20, 5):
        m = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), table_words=table_words)
        _, known = brute_model(texts)
        got = sums(m, known, rnd.sample([w for w in known if w != "\n"], 25))
        assert all(0.7 < s < 1 + 1e-6 for s in got.values()), got


def test_hashes_tell_words_apart(spark):
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, a.translate(str.maketrans("ab", "ba")))]
    m = lm.train(spark.createDataFrame(rows[:1], "doc_id long, text string"))
    assert {r.doc_id: r.n_known for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()} == {1: 2, 2: 1}
    rnd = random.Random(2)
    some = {bytes(rnd.choice(b"ab\x00\xff") for _ in range(n)) for n in range(1, 80) for _ in range(300)}
    raw = b" ".join(some)
    for seed in (0, 1):
        assert len(set(word_hashes(raw, seed).tolist())) == len(some)
    assert [int(word_hashes(w)[0]) for w in some] == word_hashes(raw).tolist()
    assert not (word_hashes(raw) == word_hashes(raw, 1)).any() and len(word_hashes(b"")) == len(word_hashes(b" \n")) == 0


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want, n = base(docs, [d for d in docs if not held(d[0])])
    rows = QUERIES["op1_bloom_lm"](spark, sf)
    assert got(rows) == want
    for r in rows.collect():
        assert r.held_out == held(r.doc_id) and r.train_tokens == n and r.score < 0 and math.isfinite(r.score)
    assert spark.createDataFrame([(None,)], "doc_id long").select(fold("doc_id", 7)).first()[0] == -1
