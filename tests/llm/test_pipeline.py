import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from sieveline.llm import langid, secrets
from sieveline.llm.queries import vocabulary
from tests.llm.test_simhash import brute as groups
from tests.llm.test_simhash import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    more = [(10_001, "12 34 !?", "en", "src0", 8), (10_002, None, "en", None, None), (10_003, "", None, "x", 0), (None, "the and of that in the", "en", "src1", 22)]
    real = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    return real.unionByName(spark.createDataFrame(more, SCHEMA)).repartition(3).cache()


def test_stages_against_brute_force(spark, docs, sf):
    rows = [tuple(r) for r in docs.collect()]
    counts = {}
    for _, text, lang, *_ in rows:
        if lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(langid.words(text))
    model = langid.Model(counts)
    found = {r: model.predict(r[1]) for r in rows}
    kept = [r for r in rows if found[r][0] != "und" and found[r][1] >= 0.5]
    one = cp.language(spark, docs, sf)
    assert one.columns == docs.columns and Counter(map(tuple, one.collect())) == Counter(kept)
    assert {r[0] for r in rows} - {r[0] for r in kept} >= {10_001, 10_002, 10_003}

    label = {(i, f): c for i, f, c in groups([(r[0], plain(r[1])) for r in kept])}
    best = [r for r in kept if label[r[0], plain(r[1])] == r[0] and r[0] is not None]
    two = cp.near_copies(spark, spark.createDataFrame(kept, SCHEMA), sf)
    alone = [r for r in kept if r[0] is None and label[None, plain(r[1])] is None]
    assert two.columns == docs.columns and Counter(map(tuple, two.collect())) == Counter(best + alone)

    clean = []
    for i, t, lang, source, n in best:
        new = secrets.redact(t, secrets.scan_text(t))
        clean.append((i, new, lang, source, n if new == t else len(new)))
    three = cp.redacted(spark, spark.createDataFrame(best, SCHEMA), sf)
    assert three.columns == docs.columns and Counter(map(tuple, three.collect())) == Counter(clean)
    assert all(not secrets.scan_text(r[1], secrets.BASE) for r in clean)

    frame = spark.createDataFrame(clean + clean[:2], SCHEMA)
    four = cp.mixed(spark, frame, sf)
    copies = Counter()
    for r in cp.mixing.mix(frame).collect():
        copies[r.doc_id] += r.copies
    got = Counter(map(tuple, four.collect()))
    assert four.columns == docs.columns and set(got) <= set(clean)
    assert {r[0]: n for r, n in got.items()} == {i: n for i, n in copies.items() if n}

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    want = Counter((r[0], tuple(lib.encode(r[1], add_special_tokens=False).ids), hashlib.sha256(r[1].encode()).hexdigest()) for r in clean)
    five = cp.encoded(spark, spark.createDataFrame(clean, SCHEMA), sf).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in five) == want and all(r.n_tokens == len(r.ids) for r in five)


def test_near_copies_by_five_words(spark, docs, sf):
    rnd = random.Random(8)
    rows, apart = [], 0
    for i in range(0, 60, 2):
        a = [rnd.choice("abcdefghijklmnop") * rnd.randrange(1, 9) for _ in range(120)]
        b = [*a]
        b[40] = b[80] = "other"
        apart += (plain(" ".join(a)) ^ plain(" ".join(b))).bit_count() > 3
        rows += [(i, " ".join(a), "en", "s", 1), (i + 1, " ".join(b), "en", "s", 1)]
    assert apart > 5
    kept = cp.near_copies(spark, spark.createDataFrame(rows, SCHEMA), sf)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 60, 2)]


def test_empty(spark, docs, sf):
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == []
