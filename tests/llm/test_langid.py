import zlib

import pytest
from pyspark.sql import functions as F

from sieveline.llm import langid
from sieveline.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    from collections import Counter

    return langid.Model({"en": Counter(langid.words("the house of the king and the queen the the")), "de": Counter(langid.words("der könig und die königin der der und schloss"))})


def test_words():
    assert langid.words("Ab1c_d-é\nÜ") == ["ab", "c", "d", "é", "ü"]
    assert [len(w) for w in langid.words("x" * 95)] == [40, 40, 15]


def test_letters_are_the_categories_l():
    import unicodedata

    for c in map(chr, range(0x110000)):
        assert bool(langid.words(c)) == unicodedata.category(c).startswith("L") or len(c.lower()) > 1, c
    assert langid.words("a²b Ⅷx") == ["a", "b", "x"]


def slow_tables(counts):
    """Log frequencies of words and of n-grams of every length, by language."""
    import math

    langs = sorted(counts)
    tables = []
    for k in range(langid.ORDER + 1):
        per = {lang: {} for lang in langs}
        for lang in langs:
            for w, c in counts[lang].items():
                marked = w if k == 1 else f" {w} "
                for g in [w] if not k else [marked[i : i + k] for i in range(len(marked) - k + 1)]:
                    per[lang][g] = per[lang].get(g, 0) + c
        every = {g for lang in langs for g in per[lang] if k == 1 or sum(per[x].get(g, 0) for x in langs) >= langid.KNOWN}
        tables.append({g: [math.log((per[lang].get(g, 0) + 0.5) / (sum(per[lang].values()) + 0.5 * (len(every) + 1))) for lang in langs] for g in every})
    return langs, tables


def slow_predict(counts, text):
    """Word-first backoff from the definition, in plain Python."""
    return slow_score(*slow_tables(counts), text)


def slow_score(langs, tables, text):
    import math

    total, n = [0.0] * len(langs), 0
    for w in ["".join(c) for c in __import__("re").findall(r"[^\W\d_]+", text.lower())]:
        n += 1
        own = [tables[0][w]] if w in tables[0] else []
        for k in range(langid.ORDER, 0, -1):
            marked = w if k == 1 else f" {w} "
            own = own or [tables[k][g] for g in (marked[i : i + k] for i in range(len(marked) - k + 1)) if g in tables[k]]
        if own:
            total = [t + sum(x[i] for x in own) / len(own) for i, t in enumerate(total)]
    best = max(range(len(langs)), key=lambda i: (total[i], -i))
    return langs[best], 1 / sum(math.exp((t - total[best]) * min(1, 50 / n)) for t in total)


def test_against_brute_force(spark, sf):
    from collections import Counter

    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text]
    counts = {}
    for r in docs[:60]:
        if r.lang:
            counts.setdefault(r.lang, Counter()).update(langid.words(r.text[:800]))
    m = langid.Model(counts)
    for r in docs[60:140]:
        lang, score = m.predict(r.text[:500])
        want, p = slow_predict(counts, r.text[:500])
        assert lang == want and abs(score - p) < 1e-9


def test_sample_is_bounded_by_characters(spark):
    docs = spark.createDataFrame([(None, f"word{chr(97 + i % 26)} " * 50, "en") for i in range(400)], "doc_id long, text string, lang string")
    whole = sum(langid.learn(docs, F.lit(True))["en"].values())
    part = sum(langid.learn(docs.withColumn("text", F.concat("text", F.rand(1).cast("string"))), F.lit(True), sample_chars=400 * 300 // 10)["en"].values())
    assert whole == 400 * 50 and 0 < part < whole / 4


def test_word_first_then_shorter_grams(model):
    the = model.rows[model.row["the"]]
    assert the.tolist() == list(model.tables[0]["the"]) and the[1] > the[0]
    assert "queene" not in model.tables[0]
    four = [g for g in langid.grams("königen", 4) if g in model.tables[4]]
    assert four and model.unseen("königen") == pytest.approx([sum(model.tables[4][g][i] for g in four) / len(four) for i in (0, 1)])
    assert model.unseen("漢") == [0.0, 0.0]
    assert model.predict("königen")[0] == "de" and model.predict("queene")[0] == "en"


def test_no_letters(model):
    for t in (None, "", "12 !? _", "\n", "½ ²", "①", "Ⅷ ⅔ ㊈", "٣"):
        assert model.predict(t) == ("und", 0.0)
    assert langid.Model({}).predict("abc") == ("und", 0.0)
    assert model.predict("漢") == ("de", 0.5)


def test_table(spark):
    rows = [(1, "the king of the house", "en", 1), (2, "der könig und das schloss", "de", 1), (None, "und der", None, 1), (4, None, "de", 1), (5, "", "en", 1), (6, "the " * 400_000, None, 1), (1, "the king of the house", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    m = langid.Model(langid.learn(docs, F.lit(True)))
    got = sorted(map(tuple, langid.identify(docs, m).collect()), key=str)
    assert got == sorted([(i, *m.predict(t)) for i, t, _, _ in rows], key=str)
    assert all(0 <= r[2] <= 1 for r in got)
    assert langid.learn(docs.limit(0), F.lit(True)) == {}
    assert langid.identify(docs.limit(0), langid.Model({})).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_langid"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert len(rows) == len(docs) and sum(out) / len(out) > 0.98


def test_query_against_brute_force(spark, sf):
    """The whole query: folds by checksum, what is learned, and every document's language and score."""
    import re
    import zlib
    from collections import Counter

    from sieveline.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    counts = {}
    for r in rows:
        if not held[r.doc_id] and r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(re.findall(r"[^\W\d_]+", r.text.lower()))
    langs, tables = slow_tables(counts)
    found = {r.doc_id: r for r in QUERIES["op8_langid"](spark, sf).collect()}
    assert found.keys() == held.keys() and len(rows) == len(found)
    for r in rows:
        got = found[r.doc_id]
        assert got.held_out == held[r.doc_id]
        if re.search(r"[^\W\d_]", r.text or ""):
            want, p = slow_score(langs, tables, r.text)
            assert got.lang_pred == want and abs(got.score - p) < 1e-9
        else:
            assert (got.lang_pred, got.score) == ("und", 0.0)
