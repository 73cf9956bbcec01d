"""The workload's concepts over the input tables: items, pairs, edges, splits, boxes, detections.

Each comes as a DataFrame and as the DuckDB CTE that says the same, for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.functions.scalar import cosine, hamming, sign_signature
from sieveline.operators import edges, pairs, splits
from sieveline.storage import cut, table

#: Parameters of the queries: the input's vectors are near random, so thresholds are lower than
#: for image embeddings.
CANDIDATE = 0.30
T = edges.Thresholds(accept_count=46, accept_sim=0.38, strong_count=48, strong_sim=0.42, support=1, cap=8)


def items(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("res"), (F.col("vec_id") % 5 != 0).alias("labeled"))


def signatures(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("id", sign_signature(F.col("v")).alias("sig"))


def sim_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(a, b, sim, n_inl): candidate pairs with the verifier's stand-in, coordinates of equal sign."""
    return cut(pairs.cosine_pairs(items(spark, sf).select("id", "v"), CANDIDATE, counts=True))


def edge_table(spark: SparkSession, sf: str, among: DataFrame | None = None) -> DataFrame:
    """Accepted pairs of sim_pairs(), chosen where they are found; among: of these pairs (a, b) alone, by joins."""
    rows = items(spark, sf).select("id", "v")
    if among is None:
        found = pairs.cosine_pairs(rows, CANDIDATE, counts=True, accept=(T.accept_sim, T.accept_count))
    else:
        at = lambda end: rows.select(F.col("id").alias(end), F.col("v").alias(f"v{end}"))
        same = (64 - hamming(sign_signature(F.col("va")), sign_signature(F.col("vb")))).cast("long")
        found = among.join(at("a"), "a").join(at("b"), "b").select("a", "b", cosine(F.col("va"), F.col("vb")).alias("sim"), same.alias("n_inl")).where(F.col("sim") >= CANDIDATE)
    return edges.accepted(cut(found), T)


def split_of(spark: SparkSession, sf: str, seed: int = 0) -> DataFrame:
    return splits.random_split(items(spark, sf).where("labeled"), seed)


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, k, cls, cx, cy, w, h, p, s) from order lines."""
    li = table(spark, sf, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    hundredth = lambda c: c.cast("double") / 100.0
    return li.select(
        F.col("l_orderkey").alias("id"), F.row_number().over(order).alias("k"), (p % 5).cast("int").alias("cls"),
        hundredth(33 + 11 * (p % 4)).alias("cx"), hundredth(33 + 11 * (s % 4)).alias("cy"),
        F.when(p % 97 == 0, 0.004).otherwise(hundredth(13 + 12 * (p % 6))).alias("w"), hundredth(7 + 13 * (s % 5)).alias("h"), p.alias("p"), s.alias("s"),
    )


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """(id, k, cls, x1, y1, x2, y2, p, s): the boxes by their corners."""
    from sieveline.functions.scalar import corners

    return boxes(spark, sf).select("id", "k", "cls", "p", "s", *corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")))


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """(id, cls, det, conf, x1..y2): boxes shifted a little, one in ten missed, some of another class."""
    b = truth(spark, sf)
    shift = (F.col("p") % 7 - 3).cast("double") / 200.0
    cls = F.when(F.col("p") % 13 == 0, (F.col("cls") + 1) % 5).otherwise(F.col("cls")).cast("int")
    conf = ((F.col("p") * 7919 + F.col("k")) % 1000).cast("double") / 1000.0
    return b.where(F.col("s") % 10 != 0).select("id", cls.alias("cls"), F.col("k").cast("long").alias("det"), conf.alias("conf"), (F.col("x1") + shift).alias("x1"), F.col("y1"), (F.col("x2") + shift).alias("x2"), F.col("y2"))


def flagged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Detections with tp given by a rule (for the order-sensitive part, apart from matching), and positives."""
    b = boxes(spark, sf)
    conf = ((F.col("p") * 7919 + F.col("k")) % 1000).cast("double") / 1000.0
    tp = b.select("id", "cls", F.col("k").cast("long").alias("det"), conf.alias("conf"), (F.col("s") % 3 != 0).cast("int").alias("tp"))
    return tp, b.groupBy("cls").agg(F.count("*").cast("double").alias("npos"))


ITEMS = "items AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label AS res, vec_id % 5 <> 0 AS labeled FROM embeddings)"
PAIRS = f"""{ITEMS}, pairs AS (
  SELECT a, b, sim, CAST(list_sum(list_transform(list_zip(va, vb), lambda p: CASE WHEN (p[1] > 0) = (p[2] > 0) THEN 1 ELSE 0 END)) AS BIGINT) AS n_inl
  FROM (SELECT a.id AS a, b.id AS b, a.v AS va, b.v AS vb, list_cosine_similarity(a.v, b.v) AS sim FROM items a JOIN items b ON a.id < b.id)
  WHERE sim >= 0.3)"""
EDGES = f"""{PAIRS}, edges AS (SELECT *, (n_inl >= 48 OR sim >= 0.42) AS strong FROM pairs WHERE n_inl >= 46 OR sim >= 0.38),
ends AS (SELECT a, b, sim, n_inl, strong FROM edges UNION ALL SELECT b, a, sim, n_inl, strong FROM edges)"""


def split_cte(name: str = "split", seed: int = 0) -> str:
    return f"""{name} AS (
  SELECT id, CASE WHEN rk <= round_even(0.7::DOUBLE * n, 0) THEN 'train' WHEN rk <= round_even(0.7::DOUBLE * n, 0) + round_even(0.15::DOUBLE * n, 0) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT id, row_number() OVER (ORDER BY md5(concat('{seed}-', id)), id) AS rk, count(*) OVER () AS n FROM items WHERE labeled))"""


SUPPORT = f"""{EDGES}, deg AS (SELECT a, count(*) AS d FROM ends GROUP BY a),
support AS (
  SELECT e.*, (SELECT count(*) FROM ends x JOIN ends y ON x.b = y.b WHERE x.a = e.a AND y.a = e.b) AS tri, p.d AS deg_a, q.d AS deg_b
  FROM edges e JOIN deg p ON p.a = e.a JOIN deg q ON q.a = e.b),
used AS (SELECT *, (strong OR tri >= 1 OR least(deg_a, deg_b) = 1) AS used FROM support)"""


def groups_cte(where: str = "used") -> str:
    return f"""links AS (SELECT a, b FROM used WHERE {where} UNION ALL SELECT b, a FROM used WHERE {where}),
reach(id, r) AS (SELECT id, id FROM items UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
groups AS (SELECT id, min(r) AS grp FROM reach GROUP BY id)"""


BOXES = """boxes AS (
  SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS k,
         CAST(l_partkey % 5 AS INTEGER) AS cls, (33 + 11 * (l_partkey % 4))::DOUBLE / 100.0::DOUBLE AS cx, (33 + 11 * (l_suppkey % 4))::DOUBLE / 100.0::DOUBLE AS cy,
         CASE WHEN l_partkey % 97 = 0 THEN 0.004::DOUBLE ELSE (13 + 12 * (l_partkey % 6))::DOUBLE / 100.0::DOUBLE END AS w, (7 + 13 * (l_suppkey % 5))::DOUBLE / 100.0::DOUBLE AS h,
         l_partkey AS p, l_suppkey AS s
  FROM lineitem),
truth AS (SELECT id, k, cls, p, s, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2, w, h FROM boxes),
dets AS (
  SELECT id, CASE WHEN p % 13 = 0 THEN (cls + 1) % 5 ELSE cls END AS cls, k AS det, ((p * 7919 + k) % 1000)::DOUBLE / 1000.0::DOUBLE AS conf,
         x1 + (p % 7 - 3)::DOUBLE / 200.0::DOUBLE AS x1, y1, x2 + (p % 7 - 3)::DOUBLE / 200.0::DOUBLE AS x2, y2
  FROM truth WHERE s % 10 <> 0)"""
FLAGGED = f"""{BOXES}, tp AS (SELECT id, cls, k AS det, ((p * 7919 + k) % 1000)::DOUBLE / 1000.0::DOUBLE AS conf, CASE WHEN s % 3 <> 0 THEN 1 ELSE 0 END AS tp FROM boxes),
pos AS (SELECT cls, count(*)::DOUBLE AS npos FROM boxes GROUP BY cls)"""
SHARED = """greatest(0.0::DOUBLE, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0::DOUBLE, least(a.y2, b.y2) - greatest(a.y1, b.y1))"""
AREA_A, AREA_B = "((a.x2 - a.x1) * (a.y2 - a.y1))", "((b.x2 - b.x1) * (b.y2 - b.y1))"
IOU = f"(({SHARED}) / ({AREA_A} + {AREA_B} - ({SHARED}) + 1e-12::DOUBLE))"
IOS = f"(({SHARED}) / (least({AREA_A}, {AREA_B}) + 1e-12::DOUBLE))"
