"""What each of a row of filters removes, in whatever order they run: inclusion-exclusion.

For every set of filters the documents that fail all of them are counted (sums of products of
flags: one aggregation, 2^n numbers a part). Möbius inversion turns these joint failures into
the survivors of every set of filters; what a filter removes after others, what it removes
that others had removed, what it alone fails and its Shapley value (from Harsanyi dividends)
are differences and sums of those numbers. No document is looked at again for any order.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import WORD

#: The five filters of the query. Under LEAST_WORDS words; under LEAST_DISTINCT percent different
#: words; over MOST_CAPITALS percent capitals; a mark of MARKS; a text that a smaller id has.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"
FILTERS = "ABCDE"


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, A, B, C, D): each document's part (its source; null: empty), a SHA-256 of its text
    (null: empty) and, as 0 or 1, which of the first four filters it fails."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    fails = {
        "A": F.size("words") < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * F.size("words"),
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > MOST_CAPITALS * F.length("text"),
        "D": F.col("text").rlike(MARKS),
    }
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.cast("long").alias(k) for k, c in fails.items()))


def with_repeats(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, part, digest, ...) with equal ones counted (n) and the flag E: a smaller id has the text.

    Rows that repeat an id and its text are all first; an id of null is smaller than none and larger than none.
    The first id of each text is an aggregation; it is joined on text and id together, so the join has no
    hot key even if a third of all rows share a text.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first")).select(F.col("digest").alias("of"), "first")
    found = counted.join(first, (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("first")), "left")
    return found.select(*rows.columns, "n", (F.col("doc_id").isNotNull() & F.col("first").isNull()).cast("long").alias("E"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with 0 or 1 for good and toxic: whether any label of the id says quality 1 or toxic 1; 0 without a label.
    Ids of null have no label and are dealt by their text, so that they don't meet in one task."""
    of = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("q"), F.max((F.col("toxic") == 1).cast("long")).alias("t"))
    met = rows.withColumn("at", F.coalesce("doc_id", F.xxhash64("digest"))).join(of, (F.col("at") == F.col("id")) & F.col("doc_id").isNotNull(), "left")
    return met.select(*rows.columns, F.coalesce("q", F.lit(0)).alias("good"), F.coalesce("t", F.lit(0)).alias("toxic"))


def joint_failures(rows: DataFrame, filters: str = FILTERS, measures: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """(part, all, *measures): arrays over the sets of filters, the one of filters i, j, ... at 2^i + 2^j + ...: how
    many documents fail all of a set, and how many of them have the measure. rows: part, n (how often the row
    counts), 0 or 1 for every filter and measure. Sums are combined before the shuffle, so a part may be of any size."""
    whole = {m: [] for m in ("all", *measures)}
    for mask in range(1 << len(filters)):
        product = reduce(lambda a, b: a * b, (F.col(f) for i, f in enumerate(filters) if mask >> i & 1), F.col("n"))
        for m, sums in whole.items():
            sums.append(F.sum(product if m == "all" else product * F.col(m)).alias(f"{m}_{mask}"))
    sums = rows.groupBy("part").agg(*(s for of in whole.values() for s in of))
    return sums.select("part", *(F.array(*(f"{m}_{mask}" for mask in range(1 << len(filters)))).alias(m) for m in whole))


def survivors(joint: str, n: int) -> Column:
    """How many pass each set of n filters: the Möbius inversion of an array of joint failures."""
    inside = lambda mask: [s for s in range(mask + 1) if s & mask == s]
    sign = lambda c, s: -c if s.bit_count() % 2 else c
    return F.array(*(reduce(lambda a, b: a + b, (sign(F.col(joint)[s], s) for s in inside(mask))) for mask in range(1 << n)))


def shapley(joint: str, n: int) -> Column:
    """Of each of n filters, what it removes, summed over all orders: a set's Harsanyi dividend (its joint failures,
    negative for even sets) is shared equally by its filters."""
    dividend = lambda s: F.col(joint)[s] * (factorial(n) // s.bit_count() * (1 if s.bit_count() % 2 else -1))
    return F.array(*(reduce(lambda a, b: a + b, (dividend(s) for s in range(1 << n) if s >> f & 1)) for f in range(n)))


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row a part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley. rows: as joint_failures() takes them; filters: one letter a filter, up to six.

    An empty table gives an empty result; a part has all its rows, zeros included.
    """
    n, full = len(filters), (1 << len(filters)) - 1
    if not 0 < n <= 6:
        raise ValueError("one to six filters can be audited")  # 6! orders a part
    parts = joint_failures(rows, filters)
    parts = parts.select("part", "all", *(survivors(m, n).alias(f"past_{m}") for m in ("all", "good", "toxic")), shapley("all", n).alias("values"))
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(filters))))
    steps = parts.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    run = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    steps = steps.withColumn("f", F.instr(F.lit(filters), letter) - 1).withColumn("before", reduce(lambda a, b: a + b, (F.when(F.instr(run, F.lit(f)) > 0, 1 << i).otherwise(0) for i, f in enumerate(filters))))
    bit = F.element_at(F.array(*(F.lit(1 << i) for i in range(n))), F.col("f") + 1)
    steps = steps.withColumn("bit", bit).withColumn("after", F.col("before") + F.col("bit"))
    lost = lambda m: F.get(f"past_{m}", F.col("before")) - F.get(f"past_{m}", F.col("after"))
    return steps.select(
        "part", "filter_order", "step", F.get("past_all", F.col("after")).alias("kept"), lost("all").alias("removed"), (F.get("all", F.col("bit")) - lost("all")).alias("redundant"),
        (F.get("past_all", F.lit(full) - F.col("bit")) - F.get("past_all", F.lit(full))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("values", F.col("f")).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over documents: see audit(), judged(), with_repeats() and with_labels()."""
    return audit(with_labels(with_repeats(judged(docs)), labels))


SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
marked AS (SELECT doc_id, part,
  CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
  + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask FROM worded),
labelled AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM marked LEFT JOIN labelled USING (doc_id) GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(l, b)),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1]) AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)),
told AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (coalesce(earlier, 0)::BIGINT | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & coalesce(earlier, 0)::BIGINT = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & coalesce(earlier, 0)::BIGINT > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & coalesce(earlier, 0)::BIGINT = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & coalesce(earlier, 0)::BIGINT = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM told
"""
