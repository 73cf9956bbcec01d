"""Edge tables: predicates, degree, support, the rule against chaining, prevalence, leakage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.graph import connected_components
from sieveline.operators.pairs import both_ways
from sieveline.storage import cut


@dataclass(frozen=True)
class Thresholds:
    """An edge is accepted, or strong, by its verifier's count or by its similarity."""

    accept_count: int = 15
    accept_sim: float = 0.96
    strong_count: int = 30
    strong_sim: float = 0.96
    support: int = 1
    cap: int = 250


def accepted(pairs: DataFrame, t: Thresholds) -> DataFrame:
    """Accepted pairs (a, b, sim, n_inl) with strong."""
    return pairs.where((F.col("n_inl") >= t.accept_count) | (F.col("sim") >= t.accept_sim)).withColumn("strong", (F.col("n_inl") >= t.strong_count) | (F.col("sim") >= t.strong_sim))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("a").agg(F.count("*").alias("degree"))


#: Entries of the neighbours' lists that one block holds by itself; more make blocks and their sizes grow alike.
ENTRIES = 1 << 18
#: Entries of lists that a task looks up at a time.
LOOKED_UP = 1 << 20


def with_common(edges: DataFrame) -> DataFrame:
    """edges with tri, the vertices that are neighbours of both ends, and the ends' degrees (deg_a, deg_b). Edges (a, b, ...),
    a < b, each once.

    No wedge becomes a row: vertices fall into blocks, and the lists of neighbours of two blocks meet the edges between
    them in one task, which marks a list's vertices and looks up those of its partners' lists.
    """
    edges = cut(edges)
    near = both_ways(edges).groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("near"))
    blocks = max(1, round((2 * edges.count() / ENTRIES) ** 0.5))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")

    def packed(batches):
        for pdf in batches:
            yield pdf.assign(near=[x.astype("<i8").tobytes() for x in pdf.near])

    lists = near.mapInPandas(packed, "a long, near binary").withColumn("k", of("a"))
    every = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda t: F.struct(F.least(t, F.col("k")).alias("i"), F.greatest(t, F.col("k")).alias("j")))
    lists = lists.select("a", "near", F.explode(every).alias("t")).select("t.i", "t.j", "a", "near")
    tiles = edges.withColumn("i", F.least(of("a"), of("b"))).withColumn("j", F.greatest(of("a"), of("b")))
    columns = edges.columns

    def meet(own, lists):
        import numpy as np

        own = own[columns].sort_values(["a", "b"]).reset_index(drop=True)
        if not len(own):
            return own.assign(tri=np.zeros(0, np.int64), deg_a=np.zeros(0, np.int64), deg_b=np.zeros(0, np.int64))
        lists = lists.sort_values("a")
        ids, degree = lists.a.to_numpy(), lists.near.str.len().to_numpy(np.int64) // 8
        names, flat = np.unique(np.frombuffer(b"".join(lists.near), "<i8"), return_inverse=True)
        flat, first, mark = flat.astype(np.int32), np.cumsum(degree) - degree, np.zeros(len(names), bool)
        x, y = np.searchsorted(ids, own.a.to_numpy()), np.searchsorted(ids, own.b.to_numpy())
        # The list that is marked is the longer one; those of its partners are looked up.
        longer, shorter = np.where(degree[x] >= degree[y], x, y), np.where(degree[x] >= degree[y], y, x)
        order = np.argsort(longer, kind="stable")
        starts = np.append(np.flatnonzero(np.diff(longer[order], prepend=-1)), len(order))
        tri = np.zeros(len(own), np.int64)
        for low, high in zip(starts[:-1], starts[1:]):
            v = longer[order[low]]
            marked = flat[first[v] : first[v] + degree[v]]
            mark[marked] = True
            while low < high:
                # At least one list, and so many that their entries stay few.
                some = order[low:high]
                upto = max(1, int(np.searchsorted(np.cumsum(degree[shorter[some]]), LOOKED_UP)))
                some = some[:upto]
                n = degree[shorter[some]]
                ends = np.cumsum(n)
                at = np.arange(ends[-1]) + np.repeat(first[shorter[some]] - ends + n, n)
                tri[some] = np.add.reduceat(mark[flat[at]].astype(np.int64), ends - n)
                low += upto
            mark[marked] = False
        return own.assign(tri=tri, deg_a=degree[x], deg_b=degree[y])

    schema = ", ".join(f"{c} {kind}" for c, kind in edges.dtypes) + ", tri long, deg_a long, deg_b long"
    return tiles.groupBy("i", "j").cogroup(lists.groupBy("i", "j")).applyInPandas(meet, schema)


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, tri) for each edge: vertices that are neighbours of both ends."""
    return with_common(edges.select("a", "b")).select("a", "b", "tri")


def with_support(edges: DataFrame, t: Thresholds) -> DataFrame:
    """Accepted edges with degrees, tri and used: strong, or supported by a triangle, or to a leaf."""
    used = F.col("strong") | (F.col("tri") >= t.support) | (F.least("deg_a", "deg_b") == 1)
    return with_common(edges).withColumn("used", used)


def groups(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, grp): components of the edges; items without any are groups of their own."""
    comp = connected_components(edges, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("grp"))
    return items.select("id").join(comp, "id", "left").select("id", F.coalesce("grp", "id").alias("grp"))


#: Edges up to which one task walks what is left of a capped union, and by how much a round has to bring it down.
FEW_EDGES, SLOW = 1 << 18, 64


def _walk(cap: int):
    """The sequential rule over edges (a, b, n_inl, x, y, nx, ny) between clusters x and y of sizes nx and ny:
    each cluster with the one it ends in, and in the first row how many were merged and refused."""

    def walk(pdf):
        import pandas as pd

        up: dict[int, int] = {}
        size: dict[int, int] = {}
        count = [0, 0]

        def end(c):
            path = []
            while up[c] != c:
                path.append(c)
                c = up[c]
            for p in path:
                up[p] = c
            return c

        for r in pdf.sort_values(["n_inl", "a", "b"], ascending=[False, True, True]).itertuples():
            for c, n in ((r.x, r.nx), (r.y, r.ny)):
                if c not in up:
                    up[c], size[c] = c, n
            low, high = sorted((end(r.x), end(r.y)))
            if low != high:
                fits = size[low] + size[high] <= cap
                count[not fits] += 1
                if fits:
                    up[high] = low
                    size[low] += size[high]
        out = pd.DataFrame({"old": list(up), "new": [end(c) for c in up], "merged": 0, "refused": 0})
        out.loc[:0, ["merged", "refused"]] = [count]
        return out

    return walk


def capped_union(group_of: DataFrame, held: DataFrame, cap: int, few: int = FEW_EDGES) -> tuple[DataFrame, DataFrame]:
    """Merge core groups over held-back edges (a, b, n_inl), largest count first (ties to the smaller a, then b), as long
    as the union has at most ``cap`` items. Gives (id, grp) and one row (merged, refused).

    Which unions fit depends on the order, but not everywhere: an edge that comes first in the order at both of its
    clusters is decided whatever the others do, for only edges at a cluster change it. Such edges never share a
    cluster, so a round decides all of them at once, as a join. An edge whose clusters are too large together by
    now is refused at its turn as well, for clusters only grow. When ``few`` edges are left one task walks them;
    where an order leaves rounds little to do (a long chain of falling counts), one task walks the first ``few``.
    Memory of a task is bounded by ``few``, and merged, refused and groups are those of the sequential walk.
    """
    at = lambda end, name: group_of.select(F.col("id").alias(end), F.col("grp").alias(name))
    links = cut(held.select("a", "b", "n_inl").join(at("a", "x"), "a").join(at("b", "y"), "b").where("x <> y"))
    size = group_of.groupBy("grp").agg(F.count("*").alias("n"))
    clusters = cut(links.select(F.explode(F.array("x", "y")).alias("c")).distinct().join(size, F.col("c") == F.col("grp")).select("c", "n"))
    of, merged, refused = clusters.select(F.col("c").alias("was"), F.col("c").alias("root")), 0, 0
    key = F.struct((-F.col("n_inl")).alias("m"), "a", "b")
    while True:
        n = lambda c: clusters.select(F.col("c").alias(c), F.col("n").alias(f"n{c}"))  # noqa: E731, B023
        sized = cut(links.join(n("x"), "x").join(n("y"), "y").select("a", "b", "n_inl", "x", "y", "nx", "ny"))
        fits = F.col("nx") + F.col("ny") <= cap
        row = sized.agg(F.count_if(~fits).alias("over"), F.count_if(fits).alias("left")).first()
        refused += row["over"]
        live = sized.where(fits)
        if not row["left"]:
            break
        walked = None
        if row["left"] <= few:
            walked = live
        else:
            ends = live.select(F.col("x").alias("c"), key.alias("key")).unionAll(live.select(F.col("y").alias("c"), key.alias("key")))
            first = ends.groupBy("c").agg(F.min("key").alias("first"))
            one = lambda c: first.select(F.col("c").alias(c), F.col("first").alias(f"first_{c}"))  # noqa: E731, B023
            chosen = cut(live.join(one("x"), "x").where(key == F.col("first_x")).join(one("y"), "y").where(key == F.col("first_y")).select(F.greatest("x", "y").alias("old"), F.least("x", "y").alias("new")))
            decided = chosen.count()
            merged += decided
            if decided * SLOW < row["left"]:
                merged -= decided
                walked = cut(live.orderBy(F.desc("n_inl"), "a", "b").limit(few))
                last = walked.agg(F.max(key).alias("last")).first()["last"]
                live = live.where(key > F.struct(*(F.lit(v).cast("long") for v in last)))
        if walked is not None:
            told = cut(walked.groupBy().applyInPandas(_walk(cap), "old long, new long, merged long, refused long"))
            row = told.agg(F.sum("merged").alias("merged"), F.sum("refused").alias("refused")).first()
            merged, refused, chosen = merged + row["merged"], refused + row["refused"], told.where("old <> new").select("old", "new")
            if walked is live:
                live = live.limit(0)
        now = lambda table, c: table.join(chosen, F.col(c) == F.col("old"), "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")  # noqa: E731, B023
        links = now(now(live.select("a", "b", "n_inl", "x", "y"), "x"), "y").where("x <> y")
        clusters = cut(now(clusters, "c").groupBy("c").agg(F.sum("n").alias("n")))
        of = cut(now(of, "root"))
    out = group_of.join(of, F.col("grp") == F.col("was"), "left").select("id", F.coalesce("root", "grp").alias("grp"))
    return out, out.sparkSession.createDataFrame([(merged, refused)], "merged long, refused long")


def touched(edges: DataFrame) -> DataFrame:
    """Ids that any edge touches."""
    return edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges both of whose ends are among ids."""
    for end in ("a", "b"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def leaked(edges: DataFrame, split: DataFrame) -> DataFrame:
    """(id, split) of items outside train that an edge, in either direction, links to train."""
    at = lambda end: split.select(F.col("id").alias(end), F.col("split").alias(f"split_{end}"))
    e = both_ways(edges).join(at("a"), "a").join(at("b"), "b").where("split_a <> 'train' and split_b = 'train'")
    return e.select(F.col("a").alias("id"), F.col("split_a").alias("split")).distinct()


def leak_rates(edges: DataFrame, split: DataFrame) -> DataFrame:
    """(split, n, n_leaked, rate) of the splits other than train."""
    hit = leaked(edges, split).groupBy("split").agg(F.count("*").alias("n_leaked"))
    n = split.where("split <> 'train'").groupBy("split").agg(F.count("*").alias("n"))
    out = n.join(hit, "split", "left").select("split", "n", F.coalesce("n_leaked", F.lit(0)).cast("long").alias("n_leaked"))
    return out.withColumn("rate", F.round(F.col("n_leaked") / F.col("n"), 6))


def noisy_or(edges: DataFrame, split: DataFrame) -> DataFrame:
    """(split, weight): sum over leaked items of 1 - prod(1 - p), p the edge's probability."""
    at = lambda end: split.select(F.col("id").alias(end), F.col("split").alias(f"split_{end}"))
    e = both_ways(edges, "p").join(at("a"), "a").join(at("b"), "b").where("split_a <> 'train' and split_b = 'train'")
    by_item = e.groupBy("split_a", "a").agg((1 - F.exp(F.sum(F.log(1 - F.col("p") + 1e-12)))).alias("w"))
    return by_item.groupBy(F.col("split_a").alias("split")).agg(F.round(F.sum("w"), 6).alias("weight"))
