"""Average linkage of groups too large for one task, with the clusters that linkage.best_cut() gives of the whole group.

The mean distance by cosine of two clusters is one less the product of their mean unit vectors, so a cluster is a sum and
a size. Clusters that are each other's nearest merge, all of a round at once: average linkage never brings a merged
cluster nearer to others than its parts were, so these merges are those of the whole tree. What is left when a task can
hold it merges there. Silhouettes of all cuts are summed over blocks of points. Distances are met as products of blocks;
no task holds a group's distances. One task holds a group's ids and merges, and at a block of points its clusters' sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as vectors
from ..session import cut_lineage
from . import linkage

#: Clusters or points of a block, those that are met at once within a task, points whose silhouettes step together, and merges of a step.
BLOCK_ROWS, MET_ROWS, POINTS, MERGES = 2048, 1024, 256, 64



def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many tasks as the session says, as its tasks take long for their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


MERGE = "group bigint, round int, seq int, a bigint, b bigint, height double"


def best_cuts(rows: DataFrame, most: int) -> DataFrame:
    """(group, id, cluster) of rows (group, id, vector): the cut with the best silhouette; up to `most` clusters are held in one task."""
    unit = F.transform(F.array(vectors.norm(F.col("vector"))), lambda n: F.transform("vector", lambda x: x / F.when(n == 0, 1.0).otherwise(n)))[0]  # one norm a vector
    units = cut_lineage(rows.select("group", "id", unit.alias("vector")), "units")
    cuts = cut_lineage(_dealt(merges(units, most), "group").groupBy("group").applyInPandas(_finest, "group bigint, kind int, at bigint, a int, b int, n bigint, low int"), "cuts")
    best = silhouettes(units, cuts).groupBy("group").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("b")).select("group", (-F.col("b.k")).alias("k"))
    return _dealt(cuts.join(best, "group"), "group").groupBy("group").applyInPandas(_cut, "group bigint, id bigint, cluster int")


def merges(units: DataFrame, most: int) -> DataFrame:
    """All merges of each group's unit vectors (group, round, seq, a, b, height), where a and b are the least ids of the two clusters.

    Copies merge first; a zero vector is as far from another one as from any, so it has none."""
    alone = F.when(F.forall("vector", lambda x: x == 0), F.col("id")).otherwise(F.lit(None).cast("bigint"))
    own = units.withColumn("alone", F.struct(alone))
    first = cut_lineage(own.groupBy("group", "vector", "alone").agg(F.min("id").alias("first"), F.count("*").alias("n")), "distinct")
    copies = own.join(first.where("n > 1"), ["group", "vector", "alone"]).where("id > first")
    done = copies.select("group", F.lit(0).alias("round"), F.lit(0).alias("seq"), F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("height"))
    now, ready, number = first.select("group", F.col("first").alias("id"), "n", F.transform("vector", lambda x: x * F.col("n")).alias("sum")), None, 0
    while True:
        number += 1
        wide = cut_lineage(now.groupBy("group").agg(F.count("*").alias("k")).where(F.col("k") > most), "wide")
        fit = now.join(wide, "group", "left_anti")
        ready = fit if ready is None else ready.unionByName(fit)
        if wide.isEmpty():
            break
        now = now.join(wide, "group")
        new = cut_lineage(_nearest_pairs(now).withColumn("round", F.lit(number)), "merged")
        done = done.unionByName(new)
        to = now.join(new.select("group", F.col("b").alias("id"), F.col("a").alias("to")), ["group", "id"], "left")
        both = to.groupBy("group", F.coalesce("to", "id").alias("into")).agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.min_by("sum", "id").alias("x"), F.max_by("sum", "id").alias("y"))
        total = F.when(F.col("parts") == 1, F.col("x")).otherwise(F.zip_with("x", "y", lambda x, y: x + y))
        now = cut_lineage(both.select("group", F.col("into").alias("id"), "n", total.alias("sum")), "merging")
    last = _dealt(ready.withColumn("round", F.lit(number)), "group").groupBy("group").applyInPandas(_rest, MERGE)
    return done.unionByName(last)


def _nearest_pairs(now: DataFrame) -> DataFrame:
    """Merges of the clusters (group, id, n, sum, k) that are each other's nearest, the least id of equals; each group has one at least."""
    blocks = F.ceil(F.col("k") / BLOCK_ROWS)
    own = now.select("group", "id", F.transform("sum", lambda x: x / F.col("n")).alias("mean"), F.pmod(F.xxhash64("id"), blocks).alias("own"), blocks.alias("blocks"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    met = each.select("group", "id", "mean", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"))
    best = _dealt(met, "group", "i", "j").groupBy("group", "i", "j").applyInPandas(_nearest, "group bigint, id bigint, other bigint, height double").groupBy("group", "id").agg(F.min(F.struct("height", "other")).alias("b"))
    pairs = best.groupBy("group", F.least("id", "b.other").alias("a"), F.greatest("id", "b.other").alias("b")).agg(F.count("*").alias("n"), F.min("b.height").alias("height"))
    return pairs.where("n = 2").select("group", F.lit(0).alias("seq"), "a", "b", "height")


def _nearest(df: pd.DataFrame) -> pd.DataFrame:
    """Each cluster's nearest in the other block, or in its own; the least id of equals."""
    df = df.sort_values(["second", "id"])
    x, ids = np.stack(df["mean"].to_list()), df["id"].to_numpy()
    n, cut = len(df), len(df) - int(df["second"].sum())
    one = bool((df["i"] == df["j"]).iloc[0])
    best, other = np.full(n, np.inf), np.full(n, -1)

    def offer(at: np.ndarray, which: np.ndarray, d: np.ndarray) -> None:
        nearer = d < best[at]
        best[at[nearer]], other[at[nearer]] = d[nearer], which[nearer]

    for a in range(0, cut, MET_ROWS):
        left = np.arange(a, min(a + MET_ROWS, cut))
        for b in range(a if one else cut, n, MET_ROWS):
            right = np.arange(b, min(b + MET_ROWS, n))
            d = np.maximum(0.0, 1 - x[left] @ x[right].T)
            if one and a == b:
                d[np.tril_indices(len(left))] = np.inf  # each pair once, so that both see the same distance
            top = d.argmin(axis=0)
            offer(right, left[top], d[top, np.arange(len(right))])
            top = d.argmin(axis=1)
            offer(left, right[top], d[np.arange(len(left)), top])
    known = other >= 0
    return pd.DataFrame({"group": df["group"].iloc[0], "id": ids[known], "other": ids[other[known]], "height": best[known]})


def _rest(df: pd.DataFrame) -> pd.DataFrame:
    """The merges of a group's last clusters, whose distances one task holds."""
    df = df.sort_values("id")
    n, ids = df["n"].to_numpy(dtype=float), df["id"].to_numpy()

    def distances() -> np.ndarray:
        x = np.stack(df["sum"].to_list()) / n[:, None]
        d = x @ x.T
        np.subtract(1, d, out=d)
        return np.maximum(0.0, d, out=d)

    found = linkage.dendrogram(distances, n)
    at = found[:, :2].astype(int)
    return pd.DataFrame({"group": df["group"].iloc[0], "round": df["round"].iloc[0], "seq": np.arange(len(found)), "a": ids[at[:, 0]], "b": ids[at[:, 1]], "height": found[:, 2]})


def _finest(df: pd.DataFrame) -> pd.DataFrame:
    """kind 0: the points (at: id, a: cluster) of the finest cut that counts; kind 1: the merges from there on (at: number, a and b: clusters of that cut)."""
    df = df.sort_values(["height", "round", "seq", "a", "b"])
    ids = np.unique(df[["a", "b"]].to_numpy())
    pairs, n = np.searchsorted(ids, df[["a", "b"]].to_numpy()), len(ids)
    low, high = (min(n, 3), n // 2) if n // 2 >= min(n, 3) + 1 else (2, 3)
    label = linkage.cut(pairs, n, high - 1)
    later = label[pairs[n - (high - 1) : n - low]]
    points = pd.DataFrame({"kind": 0, "at": ids, "a": label, "b": 0})
    return pd.concat([points, pd.DataFrame({"kind": 1, "at": np.arange(len(later)), "a": later[:, 0], "b": later[:, 1]})]).assign(group=df["group"].iloc[0], n=n, low=low)[["group", "kind", "at", "a", "b", "n", "low"]]


def silhouettes(units: DataFrame, cuts: DataFrame) -> DataFrame:
    """(group, k, score): the mean silhouette of each cut, to ten places."""
    blocks = F.ceil(F.col("n") / BLOCK_ROWS)
    points = cut_lineage(cuts.where("kind = 0").select("group", F.col("at").alias("id"), F.col("a").alias("label"), "n", "low").join(units, ["group", "id"]), "labelled")
    sums = points.withColumn("v", array_to_vector("vector")).groupBy("group", "label").agg(F.count("*").alias("size"), vector_to_array(Summarizer.sum(F.col("v"))).alias("sum"), F.first("n").alias("n"))
    later = cuts.where("kind = 1").select("group", F.col("at").cast("int").alias("label"), "a", "b")
    clusters = cut_lineage(sums.join(later, ["group", "label"], "left"), "clusters").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).drop("n")
    dealt = points.select("group", F.pmod(F.xxhash64("id"), blocks).alias("block"), "label", "vector", "n", "low")
    found = _dealt(dealt, "group", "block").groupBy("group", "block").cogroup(_dealt(clusters, "group", "block").groupBy("group", "block")).applyInPandas(_block_scores, "group bigint, k int, total double, n bigint")
    return found.groupBy("group", "k").agg(F.round(F.sum("total") / F.first("n"), 10).alias("score"))


def _block_scores(points: pd.DataFrame, clusters: pd.DataFrame) -> pd.DataFrame:
    """The summed silhouettes of a block's points at each cut."""
    if not len(points):
        return pd.DataFrame({"group": [], "k": [], "total": [], "n": []})
    clusters = clusters.sort_values("label")
    size = clusters["size"].to_numpy(dtype=float)
    mean = np.stack(clusters["sum"].to_list()) / size[:, None]
    later = clusters[["a", "b"]].dropna().to_numpy(dtype=int)
    x, label = np.stack(points["vector"].to_list()), points["label"].to_numpy()
    root, steps, now = np.arange(len(size)), [], size.copy()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in later.tolist():
        i, j = find(a), find(b)
        steps.append((i, j, now[i], now[j]))
        root[j] = i
        now[i] += now[j]
    totals = sum(_point_scores(x[at], label[at], mean, size, steps) for at in np.array_split(np.arange(len(x)), -(-len(x) // POINTS)))
    return pd.DataFrame({"group": points["group"].iloc[0], "k": len(size) - np.arange(len(totals)), "total": totals, "n": points["n"].iloc[0]})


def _point_scores(x: np.ndarray, label: np.ndarray, mean: np.ndarray, size: np.ndarray, steps: list[tuple[int, int, float, float]]) -> np.ndarray:
    """The summed silhouettes of points before the first merge and after each.

    Rows are clusters, columns are points. Of some merges, those clusters that take no part have one least distance for all."""
    n = np.arange(len(x))
    far = mean @ x.T
    np.subtract(1, far, out=far)
    np.maximum(0.0, far, out=far)
    inner, count = far[label, n] * size[label], size[label].copy()  # summed distances to the own cluster, and its size
    far[label, n] = np.inf
    members = {int(c): np.flatnonzero(label == c) for c in np.unique(label)}
    where = np.arange(len(size))  # rows of clusters
    totals = [_scores(far.min(axis=0)[None], inner[None], count[None])]
    for start in range(0, len(steps), MERGES):
        part = steps[start : start + MERGES]
        own = sorted({c for i, j, *_ in part for c in (i, j)})
        place = {c: k for k, c in enumerate(own)}
        active = far[where[own]]
        far[where[own]] = np.inf
        idle = far.min(axis=0)
        b, inners, counts = (np.empty((len(part), len(x))) for _ in range(3))
        for k, (i, j, si, sj) in enumerate(part):
            p, q = active[place[i]], active[place[j]]
            mi, mj = members.get(i), members.pop(j, None)
            if mi is not None:
                inner[mi] += sj * q[mi]
                count[mi] += sj
            if mj is not None:
                inner[mj] += si * p[mj]
                count[mj] += si
                members[i] = mj if mi is None else np.concatenate((mi, mj))
            p *= si
            p += sj * q
            p /= si + sj
            q[:] = np.inf
            np.minimum(idle, active.min(axis=0), out=b[k])
            inners[k], counts[k] = inner, count
        far[where[own]] = active
        totals.append(_scores(b, inners, counts))
        gone = {j for _, j, *_ in part}
        where[list(gone)] = -1
        if start // MERGES % 16 == 15:  # rows of clusters that are gone make room
            live = np.flatnonzero(where >= 0)
            far, where[live] = far[where[live]], np.arange(len(live))
    return np.concatenate(totals)


def _scores(b: np.ndarray, inner: np.ndarray, count: np.ndarray) -> np.ndarray:
    a = inner / np.maximum(count - 1, 1)
    return np.where(count > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0).sum(axis=1)


def _cut(df: pd.DataFrame) -> pd.DataFrame:
    """The clusters of a group's best cut, numbered by their first points."""
    points, later = df[df["kind"] == 0], df[df["kind"] == 1].sort_values("at")
    n = int(points["a"].max()) + 1
    label = linkage.cut(later[["a", "b"]].to_numpy(), n, int(df["k"].iloc[0]))
    return pd.DataFrame({"group": points["group"], "id": points["at"], "cluster": label[points["a"].to_numpy()].astype("int32")})
