"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected ``ratio`` times (target over size). Along an order of
the source's documents the expected copies are summed up, one random offset is added, and a
document is emitted once for every integer boundary its share crosses. The order goes from
the largest size down, so the words taken stay within about one document of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import WORD, text_check
from sieveline.storage import cut

#: Fixed point of the expected copies: 2^24 steps a copy, so that sums are exact integers.
SCALE = 24
#: Rows of a hashed bucket, about; a bucket is what one task orders at a time.
BUCKET_ROWS = 20_000


def words(text: Column) -> Column:
    """Number of words of a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, size, target) from (source, size), one row a source.

    Sources by code point, null last, weigh as ``weights`` says, repeating. They share the sum
    of all sizes; a target stops at ``most`` times its size, and what is over goes to the others
    by weight until none is above. Sources reach their bound in the order of size by weight, so
    the level at which it ends is found with running sums over the sources, without a loop.
    One row a source is what the windows hold, never the documents.
    """
    everything = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.select("source", "size").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int")))
    by_bound = Window.orderBy(F.col("size").cast("double") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    run = ranked.select(
        "source", "size", "weight", F.sum("size").over(whole).alias("all"), F.sum("weight").over(whole).alias("all_weight"),
        F.sum(F.col("size") * most).over(by_bound.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.sum("weight").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)).alias("weight_before"),
    )
    # If all with a smaller bound stop at it, this is what a unit of weight gets. It rises while
    # bounds are exceeded and falls afterwards, so its largest value is the level.
    level = (F.col("all") - F.coalesce("before", F.lit(0))).cast("double") / (F.col("all_weight") - F.coalesce("weight_before", F.lit(0)))
    run = run.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("size") * F.lit(float(most)))
    run = run.withColumn("end", F.max(F.when(F.col("fits"), F.col("level"))).over(whole))
    bound = F.col("size") * F.lit(float(most))
    return run.select("source", "size", F.least(bound, F.coalesce(F.col("end") * F.col("weight"), bound)).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 1, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, check, source, size, source_size, target, copies) of every document of docs.

    copies: how often the mix takes the document, at most ``most`` times. Documents without
    words (null or empty texts) are taken no words of, whatever their copies. A null source is a
    source of its own; rows that repeat an id are ordered by size, and alike rows are
    interchangeable. An empty table gives an empty result. The same rows and seed give the same
    copies, whatever the partitions.

    Ranks within a source are worked out without gathering it: counts by (source, size class,
    hashed bucket) are summed up over few rows, and only a bucket's rows are ordered in a task.
    """
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), text_check().alias("check"))
    # Sixteen classes an octave, the largest sizes first.
    step = (F.lit(0) - F.floor(F.log2(F.col("size") + F.lit(1.0)) * 16)).cast("int")
    rows = cut(rows.withColumn("class", step).withColumn("key", key))
    n = rows.count()
    rows = rows.withColumn("bucket", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % max(1, -(-n // bucket_rows)))
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("name")  # a key that is never null
    small = rows.groupBy(name, "source", "class", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    classes = small.groupBy("name", "source", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    by_class = Window.partitionBy("name").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    class_start = classes.select("name", "class", F.coalesce(F.sum("n").over(by_class), F.lit(0)).alias("start"))
    goals = targets(classes.groupBy("source").agg(F.sum("words").alias("size")), weights, most)
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), name).cast("binary")), 1, 6), 16, 10).cast("long")
    goals = goals.select(name, F.col("size").alias("source_size"), "target", F.floor(ratio * F.lit(float(1 << SCALE))).cast("long").alias("share"), offset.alias("offset"))
    by_bucket = Window.partitionBy("name", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = small.select("name", "class", "bucket", F.coalesce(F.sum("n").over(by_bucket), F.lit(0)).alias("before"))
    starts = starts.join(class_start, ["name", "class"]).join(goals, "name").withColumn("start", F.col("start") + F.col("before")).drop("before")
    inside = Window.partitionBy("name", "class", "bucket").orderBy(F.desc("size"), "key", F.col("doc_id").isNull(), "doc_id")
    ranked = rows.select("doc_id", "check", "source", "size", "key", name, "class", "bucket").withColumn("rank", F.row_number().over(inside).cast("long"))
    end = (F.col("start") + F.col("rank")) * F.col("share") + F.col("offset")
    return ranked.join(starts, ["name", "class", "bucket"]).select("doc_id", "check", "source", "size", "source_size", "target", (F.shiftright(end, SCALE) - F.shiftright(end - F.col("share"), SCALE)).alias("copies"))


def apply(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, all columns, each as often as mix() takes it. Of rows that repeat
    id, source and text the copies are added up, and one of them is repeated so often. Texts are
    shuffled once, by the row's own key, and not sorted."""
    mixed = cut(mix(docs, **options).groupBy("doc_id", "source", "check").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows")))
    some = mixed.where("copies > 0").select(F.xxhash64("doc_id", "source", "check").alias("__k"), F.col("doc_id").alias("__i"), F.col("source").alias("__s"), F.col("check").alias("__c"), F.col("copies").alias("__copies"))
    keyed = docs.withColumn("__check", text_check()).withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), "__check"))
    same = (F.col("__key") == F.col("__k")) & (F.col("__check") == F.col("__c")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__i")) & F.col("source").cast("string").eqNullSafe(F.col("__s"))
    out = keyed.join(some.hint("shuffle_hash"), same)
    if not mixed.where("rows > 1").isEmpty():
        out = out.dropDuplicates(["__key", "doc_id", "source", "__check"])
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


#: The query's result in DuckDB SQL, with the production parameters.
SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat('1/', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS key
  FROM documents),
buckets AS (
  SELECT *, -CAST(floor(log2(size + 1.0) * 16) AS INTEGER) AS class,
         CAST(concat('0x', substr(key, 1, 8)) AS BIGINT) % greatest(1, (SELECT (count(*) + 19999) // 20000 FROM rows)) AS bucket
  FROM rows),
sizes AS (SELECT source, sum(size)::BIGINT AS size FROM rows GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sizes),
running AS (
  SELECT *, sum(size) OVER () AS whole, sum(weight) OVER () AS whole_weight,
         coalesce(sum(3 * size) OVER w, 0) AS before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM weighed
  WINDOW w AS (ORDER BY size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (whole - before)::DOUBLE / (whole_weight - weight_before)::DOUBLE AS level FROM running),
goals AS (
  SELECT source, size AS source_size,
         least(3.0::DOUBLE * size, coalesce(max(level) FILTER (WHERE level * weight <= 3.0::DOUBLE * size) OVER () * weight, 3.0::DOUBLE * size)) AS target,
         CAST(concat('0x', substr(md5(concat('1/', coalesce(concat('s', source), 'null'))), 1, 6)) AS BIGINT) AS shift
  FROM levels),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, bucket, size DESC, key, doc_id NULLS LAST) AS rank FROM buckets),
shares AS (
  SELECT r.doc_id, r.size, g.source_size, g.target, r.rank, g.shift,
         CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size * 16777216) AS BIGINT) ELSE 0 END AS share
  FROM ranked r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       CAST((((rank * share + shift) >> 24) - (((rank - 1) * share + shift) >> 24)) * size AS BIGINT) AS taken
FROM shares
"""
