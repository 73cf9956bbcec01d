"""Queries over vectors, edges, groups and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveline.functions.scalar import binned, hamming
from sieveline.operators import core as K
from sieveline.operators import edges as E
from sieveline.operators import pairs as P
from sieveline.operators import splits as S
from sieveline.operators.order import with_next
from sieveline.operators.quantiles import quantiles
from sieveline.plans import fixtures as X
from sieveline.plans.book import query
from sieveline.storage import cut

W = "WITH RECURSIVE "
SPLIT = X.split_cte()


@query("leak_rate_random", f"""{W}{X.EDGES}, {SPLIT},
hit AS (SELECT p.split, count(DISTINCT e.a) AS n_leaked FROM ends e JOIN split p ON p.id = e.a JOIN split q ON q.id = e.b WHERE p.split <> 'train' AND q.split = 'train' GROUP BY 1)
SELECT s.split, count(*) AS n, CAST(coalesce(any_value(h.n_leaked), 0) AS BIGINT) AS n_leaked, round(coalesce(any_value(h.n_leaked), 0)::DOUBLE / count(*), 6) AS rate
FROM split s LEFT JOIN hit h USING (split) WHERE s.split <> 'train' GROUP BY s.split""")
def leak_rate_random(spark, sf):
    return E.leak_rates(X.edge_table(spark, sf), X.split_of(spark, sf))


@query("pair_similarity", f"{W}{X.PAIRS} SELECT a, b, round(sim, 6) AS sim FROM pairs")
def pair_similarity(spark, sf):
    return P.cosine_pairs(X.items(spark, sf).select("id", "v"), X.CANDIDATE).select("a", "b", F.round("sim", 6).alias("sim"))


@query("knn_candidates", f"""{W}{X.PAIRS}, ends AS (SELECT a, b, sim FROM pairs UNION ALL SELECT b, a, sim FROM pairs),
top AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM ends)
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, round(sim, 6) AS sim FROM top WHERE r <= 3""")
def knn_candidates(spark, sf):
    return P.nearest(X.sim_pairs(spark, sf), 3).select("a", "b", F.round("sim", 6).alias("sim"))


@query("knn_candidates_15")
def knn_candidates_15(spark, sf):
    """With the reference's number of neighbours; the SQL of knn_candidates has three."""
    return P.nearest(X.sim_pairs(spark, sf), 15).select("a", "b", F.round("sim", 6).alias("sim"))


@query("nn_quantiles", f"""{W}{X.PAIRS}, best AS (SELECT a, max(sim) AS s FROM (SELECT a, sim FROM pairs UNION ALL SELECT b, sim FROM pairs) GROUP BY a)
SELECT p, round(CASE p WHEN 0.05 THEN quantile_cont(s, 0.05) WHEN 0.5 THEN quantile_cont(s, 0.5) ELSE quantile_cont(s, 0.95) END, 6) AS q
FROM best, (VALUES (0.05::DOUBLE), (0.5), (0.95)) AS t(p) GROUP BY p""")
def nn_quantiles(spark, sf):
    return quantiles(P.nearest_one(X.sim_pairs(spark, sf)), "sim", [0.05, 0.5, 0.95]).select("p", F.round("q", 6).alias("q"))


@query("nearest_partner", f"""{W}{X.PAIRS}, ends AS (SELECT a, b, sim FROM pairs UNION ALL SELECT b, a, sim FROM pairs)
SELECT a, b, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM ends) WHERE r = 1""")
def nearest_partner(spark, sf):
    return P.nearest_one(X.sim_pairs(spark, sf)).select("a", "b", F.round("sim", 6).alias("sim"))


@query("threshold_sweep", f"""{W}{X.PAIRS}, ends AS (SELECT a, sim FROM pairs UNION ALL SELECT b, sim FROM pairs), best AS (SELECT a, max(sim) AS s FROM ends GROUP BY a),
t AS (SELECT unnest([0.30, 0.34, 0.38, 0.42, 0.46])::DOUBLE AS t)
SELECT t, (SELECT count(*) FROM pairs WHERE sim >= t) AS n_pairs, (SELECT count(*) FROM best WHERE s >= t) AS n_items FROM t""")
def threshold_sweep(spark, sf):
    pairs, steps = X.sim_pairs(spark, sf), (0.30, 0.34, 0.38, 0.42, 0.46)
    count = lambda name: [F.count_if(F.col("sim") >= t).alias(f"{name}{i}") for i, t in enumerate(steps)]
    row = pairs.agg(*count("p")).crossJoin(P.nearest_one(pairs).agg(*count("i")))
    out = F.array(*(F.struct(F.lit(t).alias("t"), F.col(f"p{i}").alias("n_pairs"), F.col(f"i{i}").alias("n_items")) for i, t in enumerate(steps)))
    return row.select(F.explode(out).alias("x")).select("x.*")


SIGS = """sigs AS (SELECT id, list_transform(v, lambda x: x > 0) AS bits FROM items),
med AS (SELECT id, list_transform(v, lambda x: x > list_median(v[2:])) AS bits FROM items)"""
DIFFER = "list_sum(list_transform(list_zip(a.bits, b.bits), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END))"


@query("hamming_pairs", f"{W}{X.ITEMS}, {SIGS} SELECT a.id AS a, b.id AS b, CAST({DIFFER} AS INTEGER) AS ham FROM sigs a JOIN sigs b ON a.id < b.id WHERE {DIFFER} <= 17")
def hamming_pairs(spark, sf):
    return P.hamming_pairs(X.signatures(spark, sf), 17)


@query("median_signature_pairs", f"{W}{X.ITEMS}, {SIGS} SELECT a.id AS a, b.id AS b, CAST({DIFFER} AS INTEGER) AS ham FROM med a JOIN med b ON a.id < b.id WHERE {DIFFER} <= 16")
def median_signature_pairs(spark, sf):
    return P.hamming_pairs(P.median_signatures(X.items(spark, sf)), 16)


@query("consecutive_distance", f"""{W}{X.ITEMS}, {SIGS}
SELECT CAST(avg(d) AS DOUBLE) AS mean_ham, count(*) FILTER (WHERE d <= 24) AS n_near, round(avg(CASE WHEN same THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS same_res FROM (
  SELECT a.id, CAST({DIFFER} AS DOUBLE) AS d, x.res = y.res AS same FROM sigs a JOIN items x USING (id)
  JOIN (SELECT id, lead(id) OVER (ORDER BY id) AS nxt FROM items) n ON n.id = a.id JOIN sigs b ON b.id = n.nxt JOIN items y ON y.id = b.id)""")
def consecutive_distance(spark, sf):
    sig = X.signatures(spark, sf).join(X.items(spark, sf).select("id", "res"), "id")
    step = with_next(sig, "id", "sig", "res").select(hamming(F.col("sig"), F.col("next_sig")).alias("d"), (F.col("res") == F.col("next_res")).alias("same")).where("d is not null")
    return step.agg(F.avg("d").alias("mean_ham"), F.count_if(F.col("d") <= 24).alias("n_near"), F.round(F.avg(F.col("same").cast("double")), 6).alias("same_res"))


@query("edge_support", f"{W}{X.SUPPORT} SELECT a, b, n_inl, strong, tri, deg_a, deg_b, used FROM used")
def edge_support(spark, sf):
    return E.with_support(X.edge_table(spark, sf), X.T).drop("sim")


@query("two_hop", f"{W}{X.SUPPORT} SELECT count(*) FILTER (WHERE tri > 0) AS n_with, count(*) FILTER (WHERE tri = 0) AS n_without FROM used")
def two_hop(spark, sf):
    return E.common_neighbours(X.edge_table(spark, sf)).agg(F.count_if(F.col("tri") > 0).alias("n_with"), F.count_if(F.col("tri") == 0).alias("n_without"))


@query("degree_histogram", f"{W}{X.EDGES}, deg AS (SELECT a, count(*) AS d FROM ends GROUP BY a) SELECT d AS degree, count(*) AS n FROM deg GROUP BY d")
def degree_histogram(spark, sf):
    return E.degree(X.edge_table(spark, sf)).groupBy("degree").agg(F.count("*").alias("n"))


@query("adjacency", f"{W}{X.EDGES} SELECT a, array_to_string(list(b ORDER BY b), ',') AS partners FROM ends GROUP BY a")
def adjacency(spark, sf):
    near = P.both_ways(X.edge_table(spark, sf)).groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("x"))
    return near.select("a", F.array_join(F.col("x").cast("array<string>"), ",").alias("partners"))


@query("prevalence_strong", f"""{W}{X.EDGES}
SELECT kind, count(DISTINCT id) AS n, round(count(DISTINCT id)::DOUBLE / (SELECT count(*) FROM items), 6) AS share FROM (
  SELECT 'all' AS kind, a AS id FROM ends UNION ALL SELECT 'strong', a FROM ends WHERE strong) GROUP BY kind""")
def prevalence_strong(spark, sf):
    e = X.edge_table(spark, sf)
    ids = E.touched(e).withColumn("kind", F.lit("all")).unionAll(E.touched(e.where("strong")).withColumn("kind", F.lit("strong")))
    total = X.items(spark, sf).agg(F.count("*").alias("all"))
    return ids.groupBy("kind").agg(F.count("*").alias("n")).crossJoin(total).select("kind", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


PROB = "CASE WHEN sim >= 0.42 THEN 0.9::DOUBLE WHEN strong THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END"


@query("noisy_or_leak", f"""{W}{X.EDGES}, {SPLIT}
SELECT split, round(sum(w), 6) AS weight FROM (
  SELECT p.split, e.a, 1 - exp(sum(ln(1 - {PROB} + 1e-12::DOUBLE))) AS w FROM ends e JOIN split p ON p.id = e.a JOIN split q ON q.id = e.b
  WHERE p.split <> 'train' AND q.split = 'train' GROUP BY 1, 2) GROUP BY split""")
def noisy_or_leak(spark, sf):
    p = F.when(F.col("sim") >= 0.42, 0.9).when(F.col("strong"), 0.6).otherwise(0.3)
    return E.noisy_or(X.edge_table(spark, sf).withColumn("p", p), X.split_of(spark, sf))


@query("plain_components", f"""{W}{X.SUPPORT}, {X.groups_cte('true')} SELECT id, grp FROM groups""")
def plain_components(spark, sf):
    return K.plain_groups(X.items(spark, sf), X.T, X.CANDIDATE)


def core_groups(spark, sf):
    e = cut(E.with_support(X.edge_table(spark, sf), X.T))
    return cut(E.groups(X.items(spark, sf), e.where("used"))), e


def core_of(spark, sf):
    """The groups of core_groups() alone, for which no pair becomes a row."""
    return cut(K.core_groups(X.items(spark, sf), X.T, X.CANDIDATE))


CORE = f"{W}{X.SUPPORT}, {X.groups_cte()}"


@query("components", f"{CORE} SELECT id, grp FROM groups")
def components(spark, sf):
    return core_of(spark, sf)


@query("group_histogram", f"{CORE} SELECT CAST(least(n, 21) AS BIGINT) AS size, count(*) AS n_groups FROM (SELECT grp, count(*) AS n FROM groups GROUP BY grp) GROUP BY 1")
def group_histogram(spark, sf):
    size = core_of(spark, sf).groupBy("grp").agg(F.count("*").alias("n"))
    return size.groupBy(F.least("n", F.lit(21)).cast("long").alias("size")).agg(F.count("*").alias("n_groups"))


@query("mixed_groups", f"""{CORE}, g AS (SELECT grp, bool_or(labeled) AS l, bool_or(NOT labeled) AS u, count(*) FILTER (WHERE NOT labeled) AS n FROM groups JOIN items USING (id) GROUP BY grp)
SELECT count(*) AS n_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_unlabeled FROM g WHERE l AND u""")
def mixed_groups(spark, sf):
    g = core_of(spark, sf).join(X.items(spark, sf), "id").groupBy("grp").agg(F.bool_or("labeled").alias("l"), F.bool_or(~F.col("labeled")).alias("u"), F.count_if(~F.col("labeled")).alias("n"))
    return g.where("l and u").agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_unlabeled"))


@query("groups_by_source", f"""{CORE}, s AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM groups JOIN items USING (id))
SELECT res, count(*) AS n_items, count(DISTINCT grp) AS n_groups, round(avg(CASE WHEN n > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_multi, max(n) AS largest FROM s GROUP BY res""")
def groups_by_source(spark, sf):
    s = core_of(spark, sf).join(X.items(spark, sf), "id").withColumn("n", F.count("*").over(Window.partitionBy("grp")))
    return s.groupBy("res").agg(F.count("*").alias("n_items"), F.countDistinct("grp").alias("n_groups"), F.round(F.avg((F.col("n") > 1).cast("double")), 6).alias("share_multi"), F.max("n").alias("largest"))


@query("largest_components", f"""{CORE}, r AS (SELECT grp, count(*) AS size, count(*) FILTER (WHERE labeled) AS n_labeled, count(DISTINCT res) AS n_sources FROM groups JOIN items USING (id) GROUP BY grp)
SELECT rank, grp, size, n_sources, round(n_labeled::DOUBLE / size, 6) AS labeled FROM (SELECT *, row_number() OVER (ORDER BY size DESC, grp) AS rank FROM r) WHERE rank <= 4""")
def largest_components(spark, sf):
    r = core_of(spark, sf).join(X.items(spark, sf), "id").groupBy("grp").agg(F.count("*").alias("size"), F.count_if("labeled").alias("n_labeled"), F.countDistinct("res").alias("n_sources"))
    top = r.orderBy(F.desc("size"), "grp").limit(4).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "grp")).cast("long"))
    return top.select("rank", "grp", "size", "n_sources", F.round(F.col("n_labeled") / F.col("size"), 6).alias("labeled"))


@query("capped_groups")
def capped_groups(spark, sf):
    core, e = core_groups(spark, sf)
    return E.capped_union(core, e.where("not used").select("a", "b", "n_inl"), X.T.cap)[0]


SWEEP = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS t, id, min(r) AS grp FROM r{i} GROUP BY id" for i, t in enumerate((0.38, 0.40, 0.42)))
REACH = ", ".join(f"r{i}(id, r) AS (SELECT id, id FROM items UNION SELECT r{i}.id, l.b FROM r{i} JOIN (SELECT a, b, sim FROM pairs UNION ALL SELECT b, a, sim FROM pairs) l ON l.a = r{i}.r AND l.sim >= {t})" for i, t in enumerate((0.38, 0.40, 0.42)))


@query("component_sweep", f"""{W}{X.PAIRS}, {REACH}, g AS ({SWEEP})
SELECT t, count(*) AS n_groups, count(*) FILTER (WHERE n > 1) AS n_multi, max(n) AS largest FROM (SELECT t, grp, count(*) AS n FROM g GROUP BY t, grp) GROUP BY t""")
def component_sweep(spark, sf):
    p, items, out = X.sim_pairs(spark, sf), X.items(spark, sf), None
    for t in (0.38, 0.40, 0.42):
        size = E.groups(items, p.where(F.col("sim") >= t)).groupBy("grp").agg(F.count("*").alias("n"))
        row = size.agg(F.count("*").alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_multi"), F.max("n").alias("largest")).withColumn("t", F.lit(t))
        out = row if out is None else out.unionByName(row)
    return out


@query("max_sim_to_train", f"""{W}{X.ITEMS}, {SPLIT}, m AS (
  SELECT s.split, e.id, max(list_cosine_similarity(e.v, t.v)) AS s FROM items e JOIN split s USING (id), items t JOIN split u ON u.id = t.id WHERE s.split <> 'train' AND u.split = 'train' GROUP BY 1, 2)
SELECT split, count(*) AS n, round(median(s), 6) AS median_sim, round(avg(CASE WHEN s >= 0.38 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share FROM m GROUP BY split""")
def max_sim_to_train(spark, sf):
    items = X.items(spark, sf).select("id", "v").join(X.split_of(spark, sf), "id")
    out, train = items.where("split <> 'train'"), items.where("split = 'train'").select("id", "v")
    met = P.max_sims(out.select("id", "v"), train).withColumnRenamed("sim", "s")
    met = cut(met.join(out.select(F.col("id").alias("a"), "split"), "a"))
    mid = quantiles(met, "s", [0.5], "split").select("split", F.round("q", 6).alias("median_sim"))
    return met.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg((F.col("s") >= 0.38).cast("double")), 6).alias("share")).join(mid, "split").select("split", "n", "median_sim", "share")


@query("safe_unlabeled", f"""{CORE}, {SPLIT}
SELECT g.id FROM groups g JOIN items i USING (id) WHERE NOT i.labeled AND g.grp NOT IN (SELECT grp FROM groups JOIN split USING (id) WHERE split <> 'train')""")
def safe_unlabeled(spark, sf):
    items = X.items(spark, sf).select("id", "labeled").join(core_of(spark, sf), "id")
    return S.safe_unlabeled(items, X.split_of(spark, sf))


@query("leaky_clean", f"""{W}{X.EDGES}, {SPLIT}
SELECT id, CASE WHEN id IN (SELECT e.a FROM ends e JOIN split q ON q.id = e.b WHERE q.split = 'train') THEN 'leaky' ELSE 'clean' END AS kind FROM split WHERE split = 'test'""")
def leaky_clean(spark, sf):
    split = X.split_of(spark, sf)
    hit = E.leaked(X.edge_table(spark, sf), split).select("id", F.lit("leaky").alias("kind"))
    return split.where("split = 'test'").select("id").join(hit, "id", "left").select("id", F.coalesce("kind", F.lit("clean")).alias("kind"))


@query("split_balance", f"""{CORE}, {SPLIT}
SELECT split, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM split), 4) AS share, count(DISTINCT grp) AS n_groups FROM split JOIN groups USING (id) GROUP BY split""")
def split_balance(spark, sf):
    return S.balance(X.split_of(spark, sf).join(core_of(spark, sf), "id"))


@query("source_shares", f"""{W}{X.ITEMS}, {SPLIT}, n AS (SELECT split, res, count(*) AS n FROM split JOIN items USING (id) GROUP BY 1, 2)
SELECT split, res, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY split), 4) AS share FROM n""")
def source_shares(spark, sf):
    return S.source_shares(X.split_of(spark, sf).join(X.items(spark, sf).select("id", "res"), "id"))


RES = "".join(f", count(*) FILTER (WHERE res = {r})::DOUBLE AS r{r}" for r in range(10))
TERMS = " + ".join(f"{w} * pow(({c} - sh * sum({c}) OVER ()) / greatest(sum({c}) OVER (), 1), 2)" for c, w in [("n", 4), *((f"r{r}", 1) for r in range(10))])


@query("split_cost", f"""{W}{X.ITEMS}, {SPLIT}, f AS (SELECT split, CASE WHEN split = 'train' THEN 0.7::DOUBLE ELSE 0.15::DOUBLE END AS sh, count(*)::DOUBLE AS n{RES} FROM split JOIN items USING (id) GROUP BY split)
SELECT round(sum(t), 9) AS cost FROM (SELECT {TERMS} AS t FROM f)""")
def split_cost(spark, sf):
    rows = X.split_of(spark, sf).join(X.items(spark, sf).select("id", "res"), "id").withColumn("grp", F.col("split"))
    f = S.features(rows, list(range(10))).withColumnRenamed("grp", "split")
    return S.split_cost(f, ["n", *(f"res_{r}" for r in range(10))]).select(F.round("cost", 9).alias("cost"))


@query("balanced_group_split")
def balanced_group_split(spark, sf):
    rows = X.items(spark, sf).where("labeled").select("id", "res").join(core_of(spark, sf), "id")
    return S.balanced_split(rows, list(range(10)))


@query("rule_agreement", f"""{W}{X.EDGES}, rules AS (SELECT 'count' AS rule, a, b FROM pairs WHERE n_inl >= 44 UNION ALL SELECT 'cosine', a, b FROM pairs WHERE sim >= 0.36 UNION ALL SELECT 'both', a, b FROM pairs WHERE sim >= 0.36 AND n_inl >= 44)
SELECT r.rule, count(*) AS n, round(avg(CASE WHEN e.a IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS precision, round(count(e.a)::DOUBLE / (SELECT count(*) FROM edges), 6) AS recall
FROM rules r LEFT JOIN edges e ON e.a = r.a AND e.b = r.b GROUP BY r.rule""")
def rule_agreement(spark, sf):
    p = X.sim_pairs(spark, sf)
    e = E.accepted(p, X.T).select("a", "b", F.lit(1).alias("ok"))
    rules = {"count": "n_inl >= 44", "cosine": "sim >= 0.36", "both": "sim >= 0.36 and n_inl >= 44"}
    hit = p.select("a", "b", F.explode(F.filter(F.array(*(F.when(F.expr(c), F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())).alias("rule"))
    out = hit.join(e, ["a", "b"], "left").groupBy("rule").agg(F.count("*").alias("n"), F.count("ok").alias("ok"))
    return out.crossJoin(e.agg(F.count("*").alias("all"))).select("rule", "n", F.round(F.col("ok") / F.col("n"), 6).alias("precision"), F.round(F.col("ok") / F.col("all"), 6).alias("recall"))


SPLITS = ", ".join(X.split_cte(f"s{k}", k) for k in range(3))


@query("rule_comparison", f"""{W}{X.EDGES}, {SPLITS}, s AS (SELECT 0 AS seed, * FROM s0 UNION ALL SELECT 1, * FROM s1 UNION ALL SELECT 2, * FROM s2),
r AS (SELECT 'all' AS rule, a, b FROM ends UNION ALL SELECT 'strong', a, b FROM ends WHERE strong UNION ALL SELECT 'cosine', a, b FROM ends WHERE sim >= 0.42),
hit AS (SELECT r.rule, p.seed, count(DISTINCT r.a) AS n FROM r JOIN s p ON p.id = r.a JOIN s q ON q.id = r.b AND q.seed = p.seed WHERE p.split = 'test' AND q.split = 'train' GROUP BY 1, 2),
rate AS (SELECT rule, n::DOUBLE / (SELECT count(*) FROM s0 WHERE split = 'test') AS x FROM hit)
SELECT rule, round(avg(x), 6) AS mean, round(min(x), 6) AS low, round(max(x), 6) AS high FROM rate GROUP BY rule""")
def rule_comparison(spark, sf):
    e = X.edge_table(spark, sf)
    s = None
    for seed in range(3):
        one = X.split_of(spark, sf, seed).withColumn("seed", F.lit(seed))
        s = one if s is None else s.unionByName(one)
    s = cut(s)
    rules = F.filter(F.array(F.lit("all"), F.when(F.col("strong"), F.lit("strong")), F.when(F.col("sim") >= 0.42, F.lit("cosine"))), lambda r: r.isNotNull())
    ends = P.both_ways(e.select("a", "b", F.explode(rules).alias("rule")), "rule")
    test, train = s.where("split = 'test'").select(F.col("id").alias("a"), "seed"), s.where("split = 'train'").select(F.col("id").alias("b"), "seed")
    hit = ends.join(test, "a").join(train, ["b", "seed"]).groupBy("rule", "seed").agg(F.countDistinct("a").alias("n"))
    rate = hit.join(s.where("split = 'test'").groupBy("seed").agg(F.count("*").alias("all")), "seed").select("rule", (F.col("n") / F.col("all")).alias("x"))
    return rate.groupBy("rule").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.min("x"), 6).alias("low"), F.round(F.max("x"), 6).alias("high"))


@query("split_overlap", f"""{W}{X.ITEMS}, {SPLITS}, t AS (SELECT 0 AS seed, id FROM s0 WHERE split = 'test' UNION ALL SELECT 1, id FROM s1 WHERE split = 'test' UNION ALL SELECT 2, id FROM s2 WHERE split = 'test')
SELECT x.seed AS seed_a, y.seed AS seed_b, count(*) AS n_shared, round(count(*)::DOUBLE / (SELECT count(*) FROM t WHERE seed = 0), 6) AS share FROM t x JOIN t y ON x.id = y.id AND x.seed < y.seed GROUP BY 1, 2""")
def split_overlap(spark, sf):
    t = None
    for seed in range(3):
        one = X.split_of(spark, sf, seed).where("split = 'test'").select(F.lit(seed).alias("seed"), "id")
        t = one if t is None else t.unionAll(one)
    t = cut(t)
    met = t.select(F.col("seed").alias("seed_a"), "id").join(t.select(F.col("seed").alias("seed_b"), "id"), "id").where("seed_a < seed_b").groupBy("seed_a", "seed_b").agg(F.count("*").alias("n_shared"))
    return met.join(t.groupBy(F.col("seed").alias("seed_a")).agg(F.count("*").alias("n")), "seed_a").select("seed_a", "seed_b", "n_shared", F.round(F.col("n_shared") / F.col("n"), 6).alias("share"))


@query("group_composition", f"""{CORE}, {SPLIT}, g AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM groups JOIN split USING (id))
SELECT split, round(avg(CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS single, round(avg(CASE WHEN n >= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS large, max(n) AS largest, count(DISTINCT grp) AS n_groups FROM g GROUP BY split""")
def group_composition(spark, sf):
    g = X.split_of(spark, sf).join(core_of(spark, sf), "id").withColumn("n", F.count("*").over(Window.partitionBy("grp")))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return g.groupBy("split").agg(share(F.col("n") == 1).alias("single"), share(F.col("n") >= 5).alias("large"), F.max("n").alias("largest"), F.countDistinct("grp").alias("n_groups"))


@query("pair_crosstab", f"""{W}{X.PAIRS}, b AS (SELECT CASE WHEN sim >= 0.42 THEN 'high' WHEN sim >= 0.36 THEN 'mid' ELSE 'low' END AS sim_bin, CASE WHEN n_inl < 36 THEN 'n0' WHEN n_inl < 42 THEN 'n36' WHEN n_inl < 48 THEN 'n42' ELSE 'n48' END AS n FROM pairs)
SELECT sim_bin, count(*) FILTER (WHERE n = 'n0') AS n0, count(*) FILTER (WHERE n = 'n36') AS n36, count(*) FILTER (WHERE n = 'n42') AS n42, count(*) FILTER (WHERE n = 'n48') AS n48 FROM b GROUP BY sim_bin""")
def pair_crosstab(spark, sf):
    sim = binned(F.col("sim"), [0.3, 0.36, 0.42, 1.1], ["low", "mid", "high"])
    n = binned(F.col("n_inl"), [0, 36, 42, 48, 65], ["n0", "n36", "n42", "n48"])
    return X.sim_pairs(spark, sf).select(sim.alias("sim_bin"), n.alias("n")).groupBy("sim_bin").pivot("n", ["n0", "n36", "n42", "n48"]).count().fillna(0)


@query("pair_summary", f"""{W}{X.PAIRS} SELECT count(*) AS n, round(avg(sim), 6) AS mean, round(stddev_samp(sim), 6) AS sd, round(min(sim), 6) AS low, round(quantile_cont(sim, 0.25), 6) AS q1, round(median(sim), 6) AS mid, round(quantile_cont(sim, 0.75), 6) AS q3, round(max(sim), 6) AS high FROM pairs""")
def pair_summary(spark, sf):
    found = K.summary(X.items(spark, sf), X.CANDIDATE, [0.25, 0.5, 0.75])
    row = [found["n"], found["mean"], found["sd"], found["low"], *found["q"], found["high"]]
    names = ["mean", "sd", "low", "q1", "mid", "q3", "high"]
    out = spark.createDataFrame([row], "n long, " + ", ".join(f"{c} double" for c in names))
    return out.select("n", *(F.round(c, 6).alias(c) for c in names))


@query("signal_disagreement", f"""{W}{X.PAIRS}, {X.split_cte()} SELECT count(*) FILTER (WHERE sim >= 0.40 AND n_inl < 40) AS sim_only, count(*) FILTER (WHERE sim < 0.34 AND n_inl >= 46) AS count_only,
count(*) FILTER (WHERE x.res <> y.res) AS cross_source, round(max(n_inl::DOUBLE / greatest(sim * 64, 1)), 6) AS top_ratio FROM pairs p JOIN items x ON x.id = p.a JOIN items y ON y.id = p.b""")
def signal_disagreement(spark, sf):
    at = lambda end: X.items(spark, sf).select(F.col("id").alias(end), F.col("res").alias(f"res_{end}"))
    p = X.sim_pairs(spark, sf).join(at("a"), "a").join(at("b"), "b")
    return p.agg(F.count_if((F.col("sim") >= 0.40) & (F.col("n_inl") < 40)).alias("sim_only"), F.count_if((F.col("sim") < 0.34) & (F.col("n_inl") >= 46)).alias("count_only"), F.count_if(F.col("res_a") != F.col("res_b")).alias("cross_source"), F.round(F.max(F.col("n_inl") / F.greatest(F.col("sim") * 64, F.lit(1.0))), 6).alias("top_ratio"))


HELD = f"""{CORE}, {SPLIT}, held AS (SELECT id, grp, res FROM split JOIN groups USING (id) JOIN items USING (id) WHERE split <> 'train'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(concat('0-', id)), id) AS rk, count(*) OVER (PARTITION BY grp) AS size FROM held),
roles AS (SELECT *, CASE WHEN size > 1 AND rk = 1 THEN 'anchor' WHEN size > 1 AND rk <= 6 THEN 'twin' ELSE 'placebo' END AS role FROM ranked),
half AS (SELECT grp, CASE WHEN row_number() OVER (PARTITION BY res ORDER BY size DESC, md5(concat('0-', grp)), grp) % 2 = 1 THEN 'A' ELSE 'B' END AS half FROM roles WHERE role = 'anchor')"""


def held_out(spark, sf, core=None):
    """(id, grp, res) of items outside train; core: their groups, if they are made already."""
    split = X.split_of(spark, sf).where("split <> 'train'")
    return split.join(core if core is not None else core_of(spark, sf), "id").join(X.items(spark, sf).select("id", "res"), "id").select("id", "grp", "res")


@query("crossover_arms", f"{HELD} SELECT id, grp, role, CASE WHEN role <> 'placebo' THEN half END AS half FROM roles LEFT JOIN half USING (grp)")
def crossover_arms(spark, sf):
    return S.anchors_and_twins(held_out(spark, sf))


@query("placebo_singletons", f"{HELD} SELECT id FROM ranked WHERE size = 1")
def placebo_singletons(spark, sf):
    return held_out(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("grp"))).where("n = 1").select("id")


def anchors_of(spark, sf, arms):
    """(id, res, twins, boxes) of the anchors of arms (id, grp, role)."""
    n = arms.where("role = 'twin'").groupBy("grp").agg(F.count("*").alias("twins"))
    anchors = arms.where("role = 'anchor'").select("id", "grp").join(n, "grp").join(X.items(spark, sf).select("id", "res"), "id")
    return anchors.select("id", "res", "twins", (F.col("id") % 7).alias("boxes"))


@query("crossover_halves")
def crossover_halves(spark, sf):
    return S.best_halves(anchors_of(spark, sf, S.anchors_and_twins(held_out(spark, sf))))


@query("stratified_sample", f"""{W}{X.PAIRS}, p AS (SELECT a * 1000000 + b AS id, CASE WHEN sim >= 0.42 THEN 'high' WHEN sim >= 0.36 THEN 'mid' ELSE 'low' END AS stratum FROM pairs),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('0-', id)), id) AS k FROM p) WHERE k <= 20)
SELECT id, stratum, printf('Q%03d', row_number() OVER (ORDER BY md5(concat('0c-', id)), id) - 1) AS code FROM s""")
def stratified_sample(spark, sf):
    sim = binned(F.col("sim"), [0.3, 0.36, 0.42, 1.1], ["low", "mid", "high"])
    rows = X.sim_pairs(spark, sf).select((F.col("a") * 1000000 + F.col("b")).alias("id"), sim.alias("stratum"))
    return S.stratified_sample(rows, "stratum", 20)


@query("stratified_fill", f"""{W}{X.ITEMS}, pool AS (SELECT id, res, row_number() OVER (PARTITION BY res ORDER BY md5(concat('0-', id)), id) AS k FROM items WHERE labeled),
w AS (SELECT res, count(*) * 2 AS n FROM items WHERE NOT labeled AND res % 2 = 0 GROUP BY res),
r AS (SELECT id, pool.res, k <= coalesce(n, 0) AS own FROM pool LEFT JOIN w USING (res))
SELECT id, res, own FROM (SELECT *, row_number() OVER (ORDER BY own DESC, md5(concat('0-', id)), id) AS place FROM r) WHERE place <= (SELECT sum(n) FROM w)""")
def stratified_fill(spark, sf):
    items = X.items(spark, sf)
    wanted = items.where("not labeled and res % 2 = 0").groupBy("res").agg((F.count("*") * 2).alias("n"))
    return S.stratified_fill(items.where("labeled").select("id", "res"), wanted, "res")


CHECKS = [("split_covers_labeled", "SELECT id FROM items WHERE labeled AND id NOT IN (SELECT id FROM split)"), ("split_only_labeled", "SELECT id FROM split JOIN items USING (id) WHERE NOT labeled"),
          ("ids_unique", "SELECT id FROM items GROUP BY id HAVING count(*) > 1"), ("split_unique", "SELECT id FROM split GROUP BY id HAVING count(*) > 1"),
          ("groups_span_splits", "SELECT grp FROM split JOIN groups USING (id) GROUP BY grp HAVING count(DISTINCT split) > 1")]


@query("constraint_report", f"{CORE}, {SPLIT} " + " UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM ({q})) AS violations" for n, q in CHECKS))
def constraint_report(spark, sf):
    from sieveline.operators import constraints as C

    items, split = X.items(spark, sf), X.split_of(spark, sf)
    labeled = items.where("labeled").select("id")
    grouped = split.join(core_of(spark, sf), "id")
    return C.report({
        "split_covers_labeled": C.missing(labeled, split, "id"), "split_only_labeled": C.missing(split, labeled, "id"), "ids_unique": C.repeated(items, "id"),
        "split_unique": C.repeated(split, "id"), "groups_span_splits": C.spanning(grouped, "grp", "split"),
    })



@query("average_linkage")
def average_linkage(spark, sf):
    from sieveline.operators.linkage import linkage_groups

    return linkage_groups(X.items(spark, sf), 0.62, "average")


@query("complete_linkage")
def complete_linkage(spark, sf):
    from sieveline.operators.linkage import linkage_groups

    return linkage_groups(X.items(spark, sf), 0.62, "complete")
