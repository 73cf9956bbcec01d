"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language. An unseen word falls back to
its character n-grams: to the longest order of which any n-gram is known, down to single
characters. Scores are added up over a text's words; the language with the highest sum wins.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import give_back, map_rows

#: Rows a language of which the model learns, about: a hashed share of its labelled rows, each
#: row's fate depending on its own id and the language's count alone. With this many rows the
#: tables hold a few hundred thousand entries, however large the corpus is.
SAMPLE_ROWS = 4_000
#: Characters of text a language of which the model learns, about; where rows are long, fewer are taken.
SAMPLE_CHARS = 40_000_000
#: Longest n-gram of the backoff; a word or n-gram counts as known from so many times on.
ORDER, KNOWN = 4, 2
#: Characters of a word that are looked at; a longer one is taken in pieces of so many.
PIECE = 40

#: What \w takes without being a letter: numbers of other categories than the decimal digits.
_NUMBERS = {c: " " for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
_LETTERS = re.compile(r"[^\W\d_]+")
_CACHED = 300_000
UNKNOWN = "und"


def words(text: str) -> list[str]:
    """Lower-case runs of letters (Unicode's categories L), cut into pieces of PIECE characters."""
    low = text.lower()
    if not low.isascii() and not _NUMBERS.keys().isdisjoint(low):
        low = low.translate(str.maketrans(_NUMBERS))
    found = _LETTERS.findall(low)
    if any(len(w) > PIECE for w in found):
        found = [w[i : i + PIECE] for w in found for i in range(0, len(w), PIECE)]
    return found


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its edges marked; single characters without the marks."""
    marked = word if n == 1 else f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Per-language log frequencies of words and n-grams."""

    def __init__(self, counts: dict[str, Counter], order: int = ORDER, known: int = KNOWN):
        self.langs, self.order = sorted(counts), order
        n = len(self.langs)
        self.tables: list[dict[str, tuple[float, ...]]] = []
        by_order = [Counter({}) for _ in range(order + 1)]
        per = [[Counter() for _ in self.langs] for _ in range(order + 1)]
        for i, lang in enumerate(self.langs):
            per[0][i] = counts[lang]
            for word, c in counts[lang].items():
                for k in range(1, order + 1):
                    for g in grams(word, k):
                        per[k][i][g] += c
        for k in range(order + 1):
            for c in per[k]:
                by_order[k].update(c)
            there = [w for w, c in by_order[k].items() if c >= known or k == 1]
            total = np.array([sum(c.values()) for c in per[k]], float)
            m = np.array([[c[w] for c in per[k]] for w in there], float).reshape(len(there), n)
            # Half a count for what a language lacks, so that no word decides by itself.
            logs = np.log((m + 0.5) / (total + 0.5 * (len(there) + 1))) if n else m
            self.tables.append(dict(zip(there, map(tuple, logs.tolist()))))
        self.start()

    def start(self) -> None:
        """Lay out the words' scores as a matrix with a row for each word met, the known ones first."""
        known = self.tables[0]
        self.rows = np.zeros((len(known) + _CACHED, len(self.langs)))
        if known:
            self.rows[: len(known)] = [*known.values()]
        self.row = _Rows(zip(known, range(len(known))), self)

    def unseen(self, w: str) -> list[float]:
        """Log scores of a word that isn't known; zeros if no character of it is."""
        for k in range(self.order, 0, -1):
            table = self.tables[k]
            if found := [table[g] for g in grams(w, k) if g in table]:
                return [sum(of) / len(found) for of in zip(*found)]
        return [0.0] * len(self.langs)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its score: its share of the languages' likelihoods by the mean word,
        to the power of at most 50 words, so that long texts don't all score 1. ``und`` and 0 if
        the text is null or has no letter, or if no language was learned. Of equal languages the
        first by code point is taken."""
        found = words(text or "")
        if not found or not self.langs:
            return UNKNOWN, 0.0
        n, total = len(found), np.zeros(len(self.langs))
        for at in range(0, n, _CACHED // 2):
            if len(self.row) > len(self.rows) - _CACHED // 2:
                self.start()
            part = found[at : at + _CACHED // 2]
            total += self.rows[np.fromiter(map(self.row.__getitem__, part), np.int64, len(part))].sum(axis=0)
        best = int(total.argmax())
        e = np.exp((total - total[best]) * min(1.0, 50 / n))
        return self.langs[best], float(1 / e.sum())


class _Rows(dict):
    """Row of each word in the model's matrix; a word met for the first time gets the next one."""

    def __init__(self, known, model: Model):
        super().__init__(known)
        self.model = model

    def __missing__(self, w: str) -> int:
        at = self[w] = len(self)
        self.model.rows[at] = self.model.unseen(w)
        return at


def learn(docs: DataFrame, fit: Column, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> dict[str, Counter]:
    """Word counts by language of the rows with ``fit``, a text and a lang.

    A language with more than sample_rows such rows, or sample_chars of text, gives a hashed share of
    about that many; the counts come to the driver, bounded by the number of languages and these two. A
    row's fate depends on its id and text, so rows without an id are sampled like others.
    """
    rows = docs.where(fit & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("at"))
    n = {r["lang"]: min(1.0, sample_rows / r["n"], sample_chars / max(1, r["chars"])) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars")).collect()}
    if not n:
        return {}
    share = F.create_map(*chain.from_iterable((F.lit(lang), F.lit(int(part * (1 << 30)))) for lang, part in n.items()))
    taken = rows.where(F.col("at") < share[F.col("lang")])

    def start():
        def run(cols):
            counts: dict[str, Counter] = {}
            for lang, text in zip(*cols):
                counts.setdefault(lang, Counter()).update(words(text))
            out = [(lang, w, c) for lang, of in counts.items() for w, c in of.items()]
            return [[x[i] for x in out] for i in range(3)]

        return run

    found: dict[str, Counter] = {lang: Counter() for lang in n}
    counted = map_rows(taken.select("lang", "text"), start, "lang string, word string, n long", rows=10_000)
    # A word seen once anywhere is unknown to the model; its n-grams are learned with the others'.
    for batch in counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for lang, w, c in zip(*(col.to_pylist() for col in batch.columns)):
            found[lang][w] = c
    return found


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text of docs.

    The model's size is bounded by the sample it was learned from; it goes to the workers once.
    Only the text is looked at. Repeated rows are each predicted, equal texts alike; an empty
    table gives an empty result; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.order, model.tables))

    def start():
        m = Model({})
        m.langs, m.order, m.tables = shared.value
        m.start()

        def run(cols):
            out = [*map(m.predict, cols[1])]
            return [cols[0], [x[0] for x in out], [x[1] for x in out]]

        return run

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(kept, start, "doc_id long, lang_pred string, score double")


def accept(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text has a language: not those without any letter, and not
    those of which the best language scores under least_score. One narrow pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.order, model.tables))
    at = docs.columns.index("text")

    def run(batches):
        m = Model({})
        m.langs, m.order, m.tables = shared.value
        m.start()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = [*map(m.predict, part.column(at).to_pylist())]
                yield part.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in found], pa.bool_()))
        m = batch = part = found = None
        give_back()

    return docs.mapInArrow(run, docs.schema)
