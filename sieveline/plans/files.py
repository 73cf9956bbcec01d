"""Queries that write files to the shared folder and read them back: readers, writers, text functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sieveline.functions import scalar as V
from sieveline.operators import boxes as B
from sieveline.plans import fixtures as X
from sieveline.plans.leakage import W
from sieveline.plans.book import query
from sieveline.sources import files, sinks
from sieveline.storage import shared_dir, table


def place(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer")
def csv_round_trip(spark, sf):
    """A table written as CSV with a header and read by a declared schema."""
    at = place(spark)
    sinks.csv(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")), at)
    return files.csv(spark, at, "id long, name string, nation int, balance double")


@query("csv_strings", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def csv_strings(spark, sf):
    """A CSV file read as strings; blanks around its column names go."""
    at = place(spark)
    sinks.csv(table(spark, sf, "nation").select(F.col("n_nationkey").alias(" key"), F.col("n_name").alias("name "), F.col("n_regionkey").alias(" region ")), at)
    return files.csv(spark, at)


@query("epoch_history", "SELECT event_type, max(event_id) AS last, count(*) AS n, round(max(value), 6) AS best FROM (SELECT event_id, event_type, round(value, 6) AS value FROM events) GROUP BY event_type")
def epoch_history(spark, sf):
    """A history written with blanks in its header, read by schema and summed up."""
    at = place(spark)
    sinks.csv(table(spark, sf, "events").select(F.col("event_id").alias("  event_id"), F.col("event_type").alias(" event_type"), F.round("value", 6).alias("value ")), at)
    rows = files.csv(spark, at, "`  event_id` long, ` event_type` string, `value ` double")
    return rows.groupBy("event_type").agg(F.max("event_id").alias("last"), F.count("*").alias("n"), F.round(F.max("value"), 6).alias("best"))


@query("json_report", "SELECT s_nationkey AS nation, count(*) AS n, round(avg(s_acctbal), 6) AS balance FROM supplier GROUP BY s_nationkey")
def json_report(spark, sf):
    """A report written as JSON and read again."""
    at = place(spark)
    sinks.report(table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 6).alias("balance")), at)
    return files.json_lines(spark, at, "nation int, n long, balance double")


@query("id_list", "SELECT p_partkey AS id FROM part")
def id_list(spark, sf):
    """A sorted list of ids, read with the check that none is repeated."""
    at = place(spark)
    sinks.id_list(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), at)
    return files.ids(spark, at, unique=True)


@query("data_sets", f"""{W}{X.ITEMS}, {X.split_cte('s0', 0)}, {X.split_cte('s1', 1)} SELECT dataset, split, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT 'e0' AS dataset, * FROM s0 UNION ALL SELECT 'e1', * FROM s1) GROUP BY 1, 2""")
def data_sets(spark, sf):
    """Splits written as a tree by data set and split, their counts checked, and read from the tree."""
    rows = None
    for seed in range(2):
        one = X.split_of(spark, sf, seed).select(F.lit(f"e{seed}").alias("dataset"), "split", "id")
        rows = one if rows is None else rows.unionByName(one)
    at = place(spark)
    sinks.checked_datasets(rows, at)
    return spark.read.parquet(at).groupBy("dataset", "split").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("split_from_tree", f"{W}{X.ITEMS}, {X.split_cte()} SELECT id, split FROM split")
def split_from_tree(spark, sf):
    """The split that a tree of directories stands for: one for each split, the item's id in its files' paths."""
    at = place(spark)
    X.split_of(spark, sf).select("split", "id", F.lit("0 .5 .5 .1 .1").alias("value")).repartition("split").write.partitionBy("split").csv(at)
    return files.split_of_tree(spark, at)


@query("report_macros", "SELECT concat('\\newcommand{\\', n_name, '}{', CASE WHEN n_nationkey % 5 = 0 THEN '??' ELSE CAST(n_regionkey AS VARCHAR) END, '}') AS line FROM nation")
def report_macros(spark, sf):
    """Names and values as lines of macros; a missing value is a placeholder."""
    at = place(spark)
    sinks.macros(table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_regionkey")).alias("value")), at)
    return spark.read.text(at).select(F.col("value").alias("line"))


LINES = """lines AS (SELECT id, k - 1 AS k, cls, cx, cy, w, h, p FROM boxes WHERE p % 10 <> 3)"""


def label_texts(spark, sf):
    """(id, value): every item's boxes as the text of a label file, of which one line in ten is malformed."""
    number = lambda c: F.format_string("%.6f", c)
    line = F.when(F.col("p") % 10 == 3, F.concat(F.col("cls").cast("string"), F.lit(" .5 .5 .1"))).otherwise(F.concat_ws(" ", F.concat(F.lit(" "), F.col("cls").cast("string"), F.lit(".0")), number("cx"), number("cy"), F.concat(F.lit(" "), number("w")), number("h")))
    lines = X.boxes(spark, sf).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))).alias("x"))
    return lines.select("id", F.concat(F.array_join("x.line", "\n"), F.lit("\n")).alias("value"))


@query("parsed_labels", f"{W}{X.BOXES}, {LINES} SELECT id, CAST(k AS INTEGER) AS k, cls, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h FROM lines")
def parsed_labels(spark, sf):
    """Label files parsed: malformed lines are passed over and still counted."""
    rows = B.parse_labels(label_texts(spark, sf))
    return rows.select("id", "k", "cls", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")))


@query("parsed_corners", f"{W}{X.BOXES}, {LINES} SELECT id, CAST(k AS INTEGER) AS k, cls, round(cx - w / 2, 6) AS x1, round(cy - h / 2, 6) AS y1, round(cx + w / 2, 6) AS x2, round(cy + h / 2, 6) AS y2 FROM lines")
def parsed_corners(spark, sf):
    """Label files parsed to corners, strictly: the lines that are no boxes are taken out before."""
    clean = label_texts(spark, sf).withColumn("value", F.array_join(F.filter(F.split("value", "\n"), lambda s: F.size(F.split(F.trim(s), r"\s+")) == 5), "\n"))
    rows = B.with_corners(B.parse_labels(clean, strict=True))
    kept = X.boxes(spark, sf).where("p % 10 <> 3").select("id", "k").withColumn("n", F.expr("row_number() over (partition by id order by k)") - 1)
    named = rows.withColumnRenamed("k", "n").join(kept, ["id", "n"])
    return named.select("id", (F.col("k") - 1).cast("int").alias("k"), "cls", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("text_functions", """SELECT p_partkey AS id, split_part(p_type, ' ', 1) AS first, lower(trim(p_name)) AS name, starts_with(p_name, 'p') AS prefixed, replace(p_brand, '#', '-') AS brand,
round(ln(p_retailprice), 6) AS log, round(exp(p_size / 50.0::DOUBLE), 6) AS exp, round(sqrt(p_retailprice), 6) AS root, abs(p_size - 25) AS off, least(greatest(p_size, 10), 40) AS clipped, round_even(p_size / 2.0::DOUBLE, 0) AS even FROM part""")
def text_functions(spark, sf):
    """Text and number functions by category."""
    p = table(spark, sf, "part")
    r = lambda c, name: F.round(c, 6).alias(name)
    size, price = F.col("p_size"), F.col("p_retailprice")
    return p.select(
        F.col("p_partkey").alias("id"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("first"), F.lower(F.trim("p_name")).alias("name"), F.startswith("p_name", F.lit("p")).alias("prefixed"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("brand"),
        r(F.log(price), "log"), r(F.exp(size / 50.0), "exp"), r(F.sqrt(price), "root"), F.abs(size - 25).alias("off"), F.least(F.greatest(size, F.lit(10)), F.lit(40)).alias("clipped"), F.bround(size / 2.0).alias("even"),
    )


@query("formats", "SELECT n_nationkey AS id, printf('%.1f%%', n_nationkey / 7.0::DOUBLE * 100) AS percent, format('{:,}', n_nationkey * 123457) AS thousands FROM nation")
def formats(spark, sf):
    """Per cent and thousands as a report prints them."""
    key = F.col("n_nationkey")
    return table(spark, sf, "nation").select(key.alias("id"), V.percent(key / 7.0).alias("percent"), V.thousands(key * 123457).alias("thousands"))


@query("unit_vectors", f"{W}{X.ITEMS}, n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM items) SELECT id, round(s, 6) AS length, round(v[1] / s, 6) AS first, round(v[64] / s, 6) AS last FROM n")
def unit_vectors(spark, sf):
    """Vectors over their lengths."""
    v = X.items(spark, sf).select("id", F.col("v"), V.normalise(F.col("v")).alias("u"))
    return v.select("id", F.round(F.sqrt(V.dot(F.col("v"), F.col("v"))), 6).alias("length"), F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.get("u", F.lit(63)), 6).alias("last"))


@query("shared_ids", "SELECT doc_id AS id FROM documents INTERSECT SELECT doc_id FROM labels")
def shared_ids(spark, sf):
    from sieveline.operators.constraints import shared

    return shared(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id")


#: Ids whose lines one file of the tree holds.
FILE_IDS = 1000


@query("tree_check", f"""WITH dirs AS (SELECT DISTINCT concat('lang=', coalesce(lang, 'none'), '/source=', coalesce(source, 'none'), '/part=', doc_id // {FILE_IDS}) AS file, coalesce(source, 'none') AS source, lang FROM documents)
SELECT file, CASE source WHEN 'src3' THEN 'digest' WHEN 'src5' THEN 'size' ELSE 'missing' END AS kind FROM dirs WHERE source IN ('src3', 'src5', 'src7')
UNION SELECT concat('lang=', coalesce(lang, 'none'), '/source=new/part=0'), 'extra' FROM dirs""")
def tree_check(spark, sf):
    """Files that differ from a list of sizes and digests: a tree of document digests by language, source and
    range of ids is written with some files spoilt, left out or added, and held against what it should be."""
    docs = table(spark, sf, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), F.floor(F.col("doc_id") / FILE_IDS).alias("part"), "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("line"))
    names = ["lang", "source", "part"]
    file = F.concat(F.lit("lang="), "lang", F.lit("/source="), "source", F.lit("/part="), F.col("part").cast("string"))
    whole = F.concat(F.array_join(F.sort_array(F.collect_list(F.struct("doc_id", "line"))).getField("line"), "\n"), F.lit("\n"))
    want = docs.groupBy(*names).agg(whole.alias("whole")).select(file.alias("file"), F.octet_length("whole").cast("long").alias("bytes"), F.sha2(F.col("whole").cast("binary"), 256).alias("digest"))
    spoilt = F.when(F.col("source") == "src3", F.reverse("line")).when(F.col("source") == "src5", F.concat("line", F.lit("+"))).otherwise(F.col("line"))
    added = docs.select("lang").distinct().select("lang", F.lit("new").alias("source"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("doc_id"), F.lit("x").alias("line"))
    rows = docs.where("source <> 'src7'").withColumn("line", spoilt).unionByName(added)
    at = place(spark)
    rows.repartition(*names).sortWithinPartitions(*names, "doc_id").select(*names, "line").write.partitionBy(*names).text(at)
    found = files.manifest(spark, at).withColumn("file", F.regexp_extract("path", r"(lang=[^/]*/source=[^/]*/part=[^/]*)/[^/]*$", 1)).where("file <> ''")
    return files.compared(found, want, "file").select("file", "kind")


@query("json_document", "SELECT n_regionkey AS region, count(*) AS nations FROM nation GROUP BY 1 UNION ALL SELECT NULL, NULL")
def json_document(spark, sf):
    """A report of one JSON document over several lines, and one that was never written: a row of nulls."""
    counts = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("nations"))
    whole = counts.agg(F.to_json(F.collect_list(F.struct("region", "nations")), {"pretty": "true"}).alias("value"))
    at, schema = place(spark), "region int, nations long"
    whole.write.text(at)
    return files.json_or_null(spark, at, schema).unionByName(files.json_or_null(spark, place(spark), schema))
