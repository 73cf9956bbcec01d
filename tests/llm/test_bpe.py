import hashlib
import random

import pytest

from sieveline.llm import bpe
from sieveline.llm.queries import vocabulary


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return bpe.ForcedBoundaryBpe(vocabulary()), Tokenizer.from_file(vocabulary())


def same(both, text):
    own, lib = both
    want = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want, text[:200]
    assert own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_texts(both):
    for t in ["", " ", "a", "it's we'll  x\n\n y", "!'s", "x  　 y", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "é́ß漢字🙂" * 9, "\x00\x1c\x1f\x85​᠎", "ab" * 3000, "a" * 20001, "՘x1\U000323b0", "=" * 999 + " " * 999]:
        same(both, t)


def test_random_texts(both):
    rnd = random.Random(5)
    signs = "abcdeTHE  \n\t'sre0123!?.,-_éß漢🙂͸\x85<|endoftext|>"
    for _ in range(1500):
        same(both, "".join(rnd.choice(signs) for _ in range(rnd.randrange(60))))
        same(both, "".join(chr(c) for c in (rnd.randrange(0x110000) for _ in range(8)) if not 0xD800 <= c < 0xE000))


def test_long_fragment_by_heap(both):
    rnd = random.Random(1)
    for _ in range(200):
        same(both, "".join(rnd.choice("ethnsi") for _ in range(rnd.randrange(25, 90))))


def test_cuts_are_certain(both):
    own, _ = both
    for f in own.fragments(b"abc\xff\x00zz9q "):
        assert all(pair in own.inside for pair in zip(f, f[1:]))


def test_without_the_compiled_function(both):
    own = bpe.ForcedBoundaryBpe(vocabulary())
    own._native = None
    for t in ["therntndoning Éréier 漢字" * 3, "x" * 50, "its thhaherble " * 5]:
        same((own, both[1]), t)


def test_tables(spark, both, sf):
    lib = both[1]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (None, "c", 7), (4, None, None), (5, "", 7)], "doc_id long, text string, ids int")
    got = sorted(map(tuple, bpe.digest(docs, vocabulary()).collect()), key=str)
    want = []
    for i, t in [(1, "a b"), (1, "a b"), (None, "c"), (4, ""), (5, "")]:
        ids = lib.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t)))
    assert got == sorted(want, key=str)
    assert bpe.digest(docs.limit(0), vocabulary()).collect() == []
    rows = bpe.encode(spark.read.parquet(f"{sf}/documents.parquet"), vocabulary()).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in rows:
        assert r.ids == lib.encode(texts[r.doc_id], add_special_tokens=False).ids and r.decoded == texts[r.doc_id]
