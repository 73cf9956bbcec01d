"""The audit of filters against one that runs every order over every document."""

import random
from collections import Counter
from itertools import permutations

import pytest

from sieveline.llm import filters

DOCS = "doc_id long, text string, source string, n long, first long, words string, past_all string, f int, of string"


def slow_audit(docs, labels):
    """(part, order, step) -> numbers, by running each order."""
    rows = []
    for doc_id, text, source, *_ in docs:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            fails.add("C")
        if set(text) & set("#$%&*|"):
            fails.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in docs):
            fails.add("E")
        own = [(q, t) for i, q, t in labels if i is not None and i == doc_id]
        rows.append((source or "", fails, any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    out, total = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left, gone = [r for r in rows if r[0] == part], []
            for step, f in enumerate(order, 1):
                hit = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [len(left), len(hit), sum(f in r[1] for r in gone), sum(r[0] == part and r[1] == {f} for r in rows), sum(r[2] for r in hit), sum(r[3] for r in hit)]
                gone += hit
                total[part, f] += len(hit)
    return {(p, o, s): (*v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def told(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def random_docs(seed, n):
    r = random.Random(seed)
    texts = [None, "", " \t\n", "A#b", "äöü" * 300, "Long " * 250, "x%y " * 3 + "z " * 400] + [" ".join(f"w{r.randrange(600)}" for _ in range(r.choice((5, 199, 200, 260)))) + r.choice(("", " AB", "$", " A" * 9)) for _ in range(8)]
    docs = [(r.choice((None, *range(n // 2))), r.choice(texts), r.choice((None, "", "a", "b")), r.randrange(9), 1, "w", "p", 2, "o") for _ in range(n)]
    return docs + docs[: n // 4]  # repeated rows


@pytest.mark.parametrize("seed", range(3))
def test_audit_against_every_order(spark, seed):
    docs = random_docs(seed, 60)
    r = random.Random(seed)
    labels = [(r.choice((None, *range(30))), r.choice((None, 0, 1, 2)), r.choice((None, 0, 1))) for _ in range(40)]
    found = filters.audit_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert told(found) == slow_audit(docs, labels)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert dict(found.dtypes)["step"] == "int" and {t for c, t in found.dtypes[3:]} == {"bigint"}


def test_empty_tables_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit_documents(spark.createDataFrame([], DOCS), labels).count() == 0
    docs = [(1, "a", "s", 0, 0, "", "", 0, "")]
    assert told(filters.audit_documents(spark.createDataFrame(docs, DOCS), labels)) == slow_audit(docs, [])


def test_other_filters(spark):
    """Any one to six flags; the values of all filters sum up to what all orders remove."""
    rows = spark.createDataFrame([("p", n, *map(int, f"{n % 8:03b}"), 0, 1) for n in range(1, 40)], "part string, n long, X int, Y int, Z int, good int, toxic int")
    found = filters.audit(rows, "XYZ").collect()
    assert len(found) == 6 * 3
    removed = sum(n for n in range(1, 40) if n % 8)
    by_letter = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in found}
    assert sum(by_letter.values()) == 6 * removed
    assert {r["kept"] for r in found if r["step"] == 3} == {sum(range(1, 40)) - removed}
    with pytest.raises(ValueError):
        filters.audit(rows, "")
