"""Clustering of groups of vectors (each topic's sources), and the relational steps around it.

A group of bounded size is one call of applyInPandas. In larger ones density clustering builds its tree by joins and
gives the same clusters, and so does average linkage where it is to be whole; else it and the other methods work on parts
that two-means by cosine cuts the group into, and say so.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as vectors
from ..session import cut_lineage
from . import density, linkage, wide_linkage

#: Vectors that are clustered in one task: distances of all pairs are held there, by affinity propagation several times.
GROUP_ROWS, AFFINITY_ROWS = 5000, 1500
#: Rounds of two-means at a cut.
MEANS_ROUNDS = 5


def cosine_distances(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(n == 0, 1, n)
    d = x @ x.T  # of all pairs, so the rest is done in place
    np.subtract(1, d, out=d)
    return np.maximum(0.0, d, out=d)


def affinity(d: np.ndarray, damping: float = 0.7, rounds: int = 1000, steady: int = 100) -> np.ndarray:
    """Affinity propagation over negative distances, preference the median, until the centres stay for some rounds."""
    n = len(d)
    if n <= 1:
        return np.zeros(n, dtype=int)
    s = -d.copy()
    np.fill_diagonal(s, np.median(s[~np.eye(n, dtype=bool)]))
    s = s - 1e-12 * np.arange(n)[None, :]
    r, a, rows = np.zeros_like(s), np.zeros_like(s), np.arange(n)
    before, kept = np.zeros(n, dtype=bool), 0
    for _ in range(rounds):
        v = a + s
        top = v.argmax(axis=1)
        first = v[rows, top]
        v[rows, top] = -np.inf
        new = s - first[:, None]
        new[rows, top] = s[rows, top] - v.max(axis=1)
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        np.fill_diagonal(p, r.diagonal())
        new = p.sum(axis=0)[None, :] - p
        own = new.diagonal().copy()
        new = np.minimum(new, 0)
        np.fill_diagonal(new, own)
        a = damping * a + (1 - damping) * new
        now = (a + r).diagonal() > 0
        kept = kept + 1 if now.any() and np.array_equal(now, before) else 0
        before = now
        if kept >= steady:
            break
    centres = np.flatnonzero((a + r).diagonal() > 0)
    if not len(centres):
        return np.zeros(n, dtype=int)
    label = s[:, centres].argmax(axis=1)
    label[centres] = np.arange(len(centres))
    return label


def collapse(d: np.ndarray, threshold: float) -> np.ndarray:
    """Each cluster, in order, takes in every later one nearer than threshold, by the distances as they were."""
    n, out = len(d), np.full(len(d), -1)
    for i in range(n):
        if out[i] < 0:
            out[i] = i
            out[(out < 0) & (d[i] < threshold)] = i
    return np.unique(out, return_inverse=True)[1]


def spread_score(d: np.ndarray) -> float:
    """0.7 x closeness of the number of clusters to 20, plus the mean distance to the nearest other."""
    k = len(d)
    near = np.where(np.eye(k, dtype=bool), np.inf, d).min(axis=1).mean() if k > 1 else 0.0
    return 0.7 * (1 - min(abs(k - 20), 40) / 40) + float(near)


def best_collapse(centres: np.ndarray, thresholds: tuple[float, ...] = (0.2, 0.25, 0.3)) -> tuple[float, np.ndarray]:
    """The threshold whose merged centres score best; the first of equals."""
    best, found = -np.inf, (thresholds[0], np.arange(len(centres)))
    for t in thresholds:
        label = collapse(cosine_distances(centres), t)
        merged = np.stack([centres[label == k].mean(axis=0) for k in np.unique(label)])
        s = spread_score(cosine_distances(merged))
        if s > best:
            best, found = s, (t, label)
    return found


#: Labels by method, from vectors. Density works on Euclidean distances, the others on cosine distances.
METHODS = {
    "agglomerative": lambda x: linkage.best_cut(lambda: cosine_distances(x), len(x))[1],
    "affinity": lambda x: affinity(cosine_distances(x)),
    **{name: lambda x, own=own: density.labels(x, own) for name, own in density.SETTINGS.items()},
}


def cluster_groups(rows: DataFrame, method: str, group: str = "topic", key: str = "id", vector: str = "vector", named: bool = False, whole: bool = False) -> DataFrame:
    """(group, key, cluster) with every group clustered on its own; cluster -1 is noise, and clusters are numbered from 0.

    method 'best' takes, group by group, the method whose clusters score best. named: with the method that a row's
    group went through; that of a group of too many rows for one task ends in '-in-parts', but for density clustering,
    whose result is the same either way. whole: so is that of method 'agglomerative', which then never works on parts.
    """
    if method != "best" and method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    kinds = rows.schema
    rows = rows.select(F.col(group).cast("bigint").alias("group"), F.col(key).cast("bigint").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    most = AFFINITY_ROWS if method in ("affinity", "best") else GROUP_ROWS
    large = cut_lineage(rows.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > most).select("group"), "large-groups")
    split = not large.isEmpty()

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id")
        x = np.stack(df["vector"].to_list())

        def score(label: np.ndarray) -> float:
            ks = np.unique(label[label >= 0])
            return spread_score(cosine_distances(np.stack([x[label == k].mean(axis=0) for k in ks]))) if len(ks) else -1.0

        found = {name: f(x) for name, f in METHODS.items() if method in ("best", name)}
        name = max(found, key=lambda k: score(found[k])) if len(found) > 1 else method
        return pd.DataFrame({"group": df["group"], "part": df["part"], "id": df["id"], "cluster": found[name].astype("int32"), "method": name})

    schema = "group bigint, part bigint, id bigint, cluster int, method string"
    small = rows.join(large, "group", "left_anti") if split else rows
    found = small.withColumn("part", F.lit(0).cast("bigint")).groupBy("group", "part").applyInPandas(run, schema).drop("part")
    if split:
        big = rows.join(large, "group", "left_semi")
        if method in density.SETTINGS:
            more = density.large_groups(big, density.SETTINGS[method]).withColumn("method", F.lit(method))
        elif whole and method == "agglomerative":
            more = wide_linkage.best_cuts(big, most).withColumn("method", F.lit(method))
        else:
            more = _numbered(bisected(big, most).groupBy("group", "part").applyInPandas(run, schema)).withColumn("method", F.concat("method", F.lit("-in-parts")))
        found = found.unionByName(more)
    out = [F.col("group").cast(kinds[group].dataType).alias(group), F.col("id").cast(kinds[key].dataType).alias(key), "cluster"]
    return found.select(*out, *(["method"] if named else []))


def _numbered(found: DataFrame) -> DataFrame:
    """The clusters of a group's parts numbered one after the other."""
    found = cut_lineage(found, "parts-clustered")
    most = found.groupBy("group", "part").agg((F.max("cluster") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = found.join(most.select("group", "part", before.alias("before")), ["group", "part"])
    return both.select("group", "id", F.when(F.col("cluster") < 0, -1).otherwise(F.col("cluster") + F.col("before")).cast("int").alias("cluster"), "method")


def two_means(rows: DataFrame, rounds: int | None = None) -> DataFrame:
    """rows (group, part, id, vector) with side: each part in two by two-means over cosine, all parts at once.

    The first centre is the vector of the least hashed id, the second the one farthest from it; equal sides go to the first.
    """
    rows = cut_lineage(rows.withColumn("vector", vectors.normalize(F.col("vector"))), "two-means")
    by = ["group", "part"]
    one = rows.groupBy(*by).agg(F.min_by("vector", F.struct(F.xxhash64("id"), "id")).alias("one"))
    far = rows.join(one, by).groupBy(*by).agg(F.first("one").alias("one"), F.min_by("vector", F.struct(vectors.dot(F.col("vector"), F.col("one")), "id")).alias("two"))
    centres = cut_lineage(far, "centres")
    side = (vectors.dot(F.col("vector"), F.col("two")) > vectors.dot(F.col("vector"), F.col("one"))).cast("int")
    for _ in range(MEANS_ROUNDS if rounds is None else rounds):
        sums = rows.join(centres, by).select(*by, side.alias("side"), array_to_vector("vector").alias("v")).groupBy(*by, "side").agg(Summarizer.mean(F.col("v")).alias("mean"))
        mean = vector_to_array("mean")
        new = sums.groupBy(*by).agg(F.first(F.when(F.col("side") == 0, mean), ignorenulls=True).alias("m0"), F.first(F.when(F.col("side") == 1, mean), ignorenulls=True).alias("m1"))
        centres = cut_lineage(centres.join(new, by).select(*by, vectors.normalize(F.coalesce("m0", "one")).alias("one"), vectors.normalize(F.coalesce("m1", "two")).alias("two")), "centres")
    return rows.join(centres, by).select(*by, "id", "vector", side.alias("side"))


def bisected(rows: DataFrame, most: int) -> DataFrame:
    """rows (group, id, vector) with part: groups cut by two-means again and again until no part has more than most rows.

    A part that two-means leaves whole has vectors of one direction only; its rows are dealt by the hash of their id.
    """
    now, done = cut_lineage(rows.withColumn("part", F.lit(1).cast("bigint")), "bisected"), None
    while True:
        sizes = now.groupBy("group", "part").agg(F.count("*").alias("n"))
        large = cut_lineage(sizes.where(F.col("n") > most), "parts-large")
        fit = now.join(large, ["group", "part"], "left_anti")
        done = fit if done is None else done.unionByName(fit)
        if large.isEmpty():
            return done.select("group", "id", "vector", "part")
        sides = cut_lineage(two_means(now.join(large.drop("n"), ["group", "part"], "left_semi")), "bisected-sides")
        cut = sides.groupBy("group", "part").agg(F.min("side").alias("least"), F.max("side").alias("last"), F.ceil(F.count("*") / most).alias("deals"))
        both = sides.join(cut, ["group", "part"])
        whole = F.col("least") == F.col("last")
        dealt = both.where(whole).select("group", "id", "vector", (-F.col("part") * (1 << 20) - F.pmod(F.xxhash64("id"), F.col("deals"))).alias("part"))
        done = done.unionByName(dealt)
        now = both.where(~whole).select("group", "id", "vector", (2 * F.col("part") + F.col("side")).alias("part"))


def members(rows: DataFrame, group: str = "topic", key: str = "id") -> DataFrame:
    """(group, cluster, size, items) of clusters, noise left out."""
    return rows.where("cluster >= 0").groupBy(group, "cluster").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(key)).alias("items"))


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """(node, rank) over edges (src, dst) after a fixed number of rounds; the ranks of nodes without exit go to all.
    The links are written out once, as lists of a bounded length, ranks too every few rounds, so that neither the plan nor the cost of a lost executor grows."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("n") / LINK_ROWS))
    links = cut_lineage(e.join(out, "src").groupBy("src", "n", part.alias("part")).agg(F.collect_list("dst").alias("to")).select("src", "n", "to"), "links")
    nodes = cut_lineage(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "nodes")
    total = nodes.count()
    if not total:
        return nodes.withColumn("rank", F.lit(0.0))
    sinks = cut_lineage(nodes.join(out, nodes["node"] == out["src"], "left_anti"), "sinks")
    none = sinks.isEmpty()
    rank = nodes.withColumn("rank", F.lit(1.0 / total))
    for i in range(rounds):
        sent = links.join(rank, links["src"] == rank["node"]).select(F.explode("to").alias("dst"), (F.col("rank") / F.col("n")).alias("share")).groupBy("dst").agg(F.sum("share").alias("got"))
        base = nodes.join(sent, nodes["node"] == sent["dst"], "left").withColumn("got", F.coalesce("got", F.lit(0.0)))
        if none:
            rank = base.select("node", (F.lit((1 - damping) / total) + damping * F.col("got")).alias("rank"))
        else:
            lost = rank.join(sinks, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
            rank = base.join(F.broadcast(lost)).select("node", (F.lit((1 - damping) / total) + damping * (F.col("got") + F.col("lost") / total)).alias("rank"))
        if (i + 1) % cut_every == 0 and i + 1 < rounds:
            rank = cut_lineage(rank, "rank")
    return rank


#: Links of a list in page_rank(), about.
LINK_ROWS = 4096


def distance_matrix(rows: DataFrame, key: str, vector: str, block: int = 1024) -> DataFrame:
    """(a, b, distance) by cosine of all pairs, which is the result's own size; null where a vector is zero.

    Rows lie in blocks, and every two blocks meet by an equi-join, so that no task holds more than a pair of them."""
    blocks = max(1, -(-rows.count() // block))
    own = rows.select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    a = own.select(F.col("k").alias("a"), F.col("v").alias("__x"), F.col("own").alias("i"), every.alias("j"))
    b = own.select(F.col("k").alias("b"), F.col("v").alias("__y"), every.alias("i"), F.col("own").alias("j"))
    return a.join(b, ["i", "j"]).select("a", "b", vectors.cosine_distance(F.col("__x"), F.col("__y")).alias("distance"))


def alone(rows: DataFrame, condition: Column, key: str) -> DataFrame:
    """rows (key, cluster) in which those of the condition have clusters of their own, numbered after the others'."""
    most = rows.agg(F.max("cluster").alias("__m"))
    own = rows.where(condition)
    number = own.withColumn("__i", F.row_number().over(Window.orderBy(key)))  # primaries are few
    moved = number.join(F.broadcast(most)).withColumn("cluster", (F.col("__m") + F.col("__i")).cast("bigint")).drop("__m", "__i")
    return rows.where(~F.coalesce(condition, F.lit(False))).unionByName(moved)


def recluster_large(rows: DataFrame, found: DataFrame, method: str, group: str = "topic", key: str = "id") -> DataFrame:
    """found (group, key, cluster) with the members of clusters larger than mean + 3 deviations of the group's others clustered
    once more, numbered after the rest."""
    sizes = found.where("cluster >= 0").groupBy(group, "cluster").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    k, total, squares = F.count("*").over(w) - 1, F.sum("n").over(w) - F.col("n"), F.sum(F.col("n") * F.col("n")).over(w) - F.col("n") * F.col("n")
    mean = total / F.greatest(k, F.lit(1))
    spread = F.sqrt(F.greatest(F.lit(0.0), (squares - k * mean * mean) / F.greatest(k - 1, F.lit(1))))
    large = sizes.withColumn("__large", (k >= 2) & (F.col("n") > mean + 3 * spread)).where("__large").select(group, "cluster")
    hot = found.join(large, [group, "cluster"], "left_semi").select(group, key)
    again = cluster_groups(rows.join(hot, [group, key], "left_semi"), method, group, key)
    most = found.groupBy(group).agg((F.max("cluster") + 1).alias("__m"))
    again = again.join(most, group).select(group, key, F.when(F.col("cluster") < 0, -1).otherwise(F.col("cluster") + F.col("__m")).cast("int").alias("cluster"))
    return found.join(large, [group, "cluster"], "left_anti").select(group, key, "cluster").unionByName(again)


def break_largest(rows: DataFrame, found: DataFrame, least: int = 6, rounds: int = 5, group: str = "topic", key: str = "id", vector: str = "vector") -> DataFrame:
    """found (group, key, cluster) with each group's largest cluster, if it has `least` members, broken up in two, up to `rounds` times.

    Only that cluster's rows are read. One that fits a task is broken by average linkage, a larger one by two-means.
    """
    kinds = rows.schema
    own = rows.select(F.col(group).cast("bigint").alias("group"), F.col(key).cast("bigint").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    now = cut_lineage(found.select(F.col(group).cast("bigint").alias("group"), F.col(key).cast("bigint").alias("id"), "cluster"), "to-break")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id")
        x = np.stack(df["vector"].to_list())
        merges = linkage.dendrogram(lambda: cosine_distances(x))
        return pd.DataFrame({"group": df["group"], "id": df["id"], "side": linkage.cut(merges, len(df), 2).astype("int32")})

    for _ in range(rounds):
        sizes = now.where("cluster >= 0").groupBy("group", "cluster").agg(F.count("*").alias("n"))
        most = now.groupBy("group").agg(F.max("cluster").alias("most"))
        top = sizes.groupBy("group").agg(F.max(F.struct("n", (-F.col("cluster")).alias("first"))).alias("m")).where(F.col("m.n") >= least)
        top = cut_lineage(top.select("group", (-F.col("m.first")).alias("cluster"), F.col("m.n").alias("n")).join(most, "group"), "largest")
        if top.isEmpty():
            break
        members = now.join(top, ["group", "cluster"]).join(own, ["group", "id"])
        sides = members.where(F.col("n") <= GROUP_ROWS).select("group", "id", "vector").groupBy("group").applyInPandas(run, "group bigint, id bigint, side int")
        if not top.where(F.col("n") > GROUP_ROWS).isEmpty():
            wide = members.where(F.col("n") > GROUP_ROWS).select("group", F.lit(0).cast("bigint").alias("part"), "id", "vector")
            sides = sides.unionByName(two_means(wide).select("group", "id", "side"))
        moved = sides.where("side = 1").join(most, "group").select("group", "id", (F.col("most") + 1).cast("int").alias("new"))
        now = cut_lineage(now.join(moved, ["group", "id"], "left").select("group", "id", F.coalesce("new", "cluster").alias("cluster")), "to-break")
    return now.select(F.col("group").cast(kinds[group].dataType).alias(group), F.col("id").cast(kinds[key].dataType).alias(key), "cluster")


def settle_noise(rows: DataFrame, found: DataFrame, method: str = "affinity", group: str = "topic", key: str = "id") -> DataFrame:
    """found (group, key, cluster) with the noise of each group clustered on its own, numbered after the rest."""
    found = cut_lineage(found.select(group, key, "cluster"), "with-noise")
    noise = found.where("cluster < 0").select(group, key)
    again = cluster_groups(rows.join(noise, [group, key], "left_semi"), method, group, key)
    most = found.groupBy(group).agg((F.max("cluster") + 1).alias("__m"))
    again = again.join(most, group).select(group, key, (F.col("cluster") + F.col("__m")).cast("int").alias("cluster"))
    return found.where("cluster >= 0").unionByName(again)


def with_ignored(rows: DataFrame, method: str, group: str = "topic", key: str = "id") -> DataFrame:
    """(group, key, cluster, reason): rows with a reason are left out of the clustering and come back with a null cluster."""
    found = cluster_groups(rows.where("reason is null"), method, group, key, whole=True).withColumn("reason", F.lit(None).cast("string"))
    return found.unionByName(rows.where("reason is not null").select(group, key, F.lit(None).cast("int").alias("cluster"), "reason"))
