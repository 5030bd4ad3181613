"""Density clustering with a hierarchy: mutual-reachability tree, condensed tree, selection of clusters.

Within one task the tree grows point by point; beyond that it grows by rounds of joins (reachability_tree), each of
which links every component to its nearest other. Both give the same heights, so results do not depend on the size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Vectors of a block, and neighbours kept of each vector, where a group is searched in blocks.
BLOCK_ROWS, NEIGHBOURS = 1024, 16


@dataclass(frozen=True)
class Settings:
    """min_samples counts the point itself. selection: 'eom' (most stable clusters) or 'leaf'; clusters born below epsilon give way to the first ancestor born above it."""

    min_samples: int = 1
    min_size: int = 2
    selection: str = "eom"
    epsilon: float = 0.0


# The two settings of the surveyed clustering, by name.
SETTINGS = {"density": Settings(1, 2, "eom", 0.65), "density_leaf": Settings(1, 2, "leaf", 0.5)}


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all of y, each the same to the last bit whichever rows stand beside."""
    out = np.empty((len(x), len(y)))
    step = max(1, 1_000_000 // max(1, y.size))
    for i in range(0, len(x), step):
        apart = x[i : i + step, None, :] - y[None, :, :]
        apart *= apart
        out[i : i + step] = np.sqrt(apart.sum(axis=2))
    return out


def tree(x: np.ndarray, min_samples: int) -> np.ndarray:
    """The n - 1 edges (a, b, height) of the spanning tree of least mutual reachability, row by row of distances; equal heights by their points."""
    n = len(x)
    core = np.zeros(n)
    if min_samples > 1:
        for part in np.array_split(np.arange(n), max(1, n // BLOCK_ROWS)):
            core[part] = np.partition(euclidean(x[part], x), min(min_samples, n) - 1, axis=1)[:, min(min_samples, n) - 1]
    best, parent, inside, rows = np.full(n, np.inf), np.zeros(n, dtype=int), np.zeros(n, dtype=bool), np.arange(n)
    edges, i = np.zeros((max(0, n - 1), 3)), 0
    low, high = np.zeros(n, dtype=int), np.zeros(n, dtype=int)
    for k in range(n - 1):
        inside[i] = True
        reach = np.maximum(np.maximum(euclidean(x[i : i + 1], x)[0], core), core[i])
        a, b = np.minimum(rows, i), np.maximum(rows, i)
        near = ~inside & ((reach < best) | ((reach == best) & ((a < low) | ((a == low) & (b < high)))))
        best[near], parent[near], low[near], high[near] = reach[near], i, a[near], b[near]
        left = np.where(inside, np.inf, best)
        tied = np.flatnonzero(left == left.min())
        i = int(tied[0]) if len(tied) == 1 else int(min(tied, key=lambda t: (low[t], high[t])))
        edges[k] = parent[i], i, best[i]
    return edges


def select(edges: np.ndarray, n: int, settings: Settings) -> np.ndarray:
    """Labels of n points (-1: noise) from the edges of their spanning tree."""
    if n < max(2, settings.min_size):
        return np.full(n, -1)
    children, height = _hierarchy(edges, n)
    parent, birth, stability, of_point = _condensed(children, height, n, settings.min_size)
    chosen = _chosen(parent, birth, stability, settings)
    up = list(range(len(parent)))  # to the nearest chosen cluster; parents come before their children
    for c in range(1, len(parent)):
        up[c] = c if c in chosen else up[parent[c]]
    top = np.array([up[c] for c in of_point])
    kept = np.isin(top, sorted(chosen))
    names, first = np.unique(top[kept], return_index=True)
    place = {int(c): k for k, c in enumerate(names[np.argsort(first)])}  # clusters are numbered by their first points
    return np.array([place.get(int(c), -1) if ok else -1 for c, ok in zip(top, kept, strict=True)])


def _hierarchy(edges: np.ndarray, n: int) -> tuple[list[tuple[int, int]], list[float]]:
    """Inner nodes n, n + 1, ... by growing height: their two children and their heights."""
    root, node = list(range(n)), list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    children, height = [], []
    ends = np.sort(edges[:, :2], axis=1)
    for a, b, h in edges[np.lexsort((ends[:, 1], ends[:, 0], edges[:, 2]))].tolist():
        a, b = find(int(a)), find(int(b))
        children.append((node[a], node[b]))
        height.append(h)
        root[b] = a
        node[a] = n + len(children) - 1
    return children, height


def _condensed(children: list[tuple[int, int]], height: list[float], n: int, least: int) -> tuple[list[int], list[float], list[float], np.ndarray]:
    """Clusters (0: all points) that only splits into parts of least points or more end: parent, density at birth, stability; and the cluster that each point falls out of."""
    size = [1] * n
    for a, b in children:
        size.append(size[a] + size[b])
    parent, birth, stability, of_point = [-1], [0.0], [0.0], np.zeros(n, dtype=int)
    stack = [(2 * n - 2, 0)]

    def gain(c: int, density: float, points: int) -> None:
        if density != birth[c]:  # two infinite densities leave nothing
            stability[c] += (density - birth[c]) * points

    while stack:
        node, c = stack.pop()
        if node < n:
            of_point[node] = c
            continue
        a, b = children[node - n]
        density = 1 / height[node - n] if height[node - n] > 0 else np.inf
        large = [x for x in (a, b) if size[x] >= least]
        if len(large) == 2:
            for x in large:
                gain(c, density, size[x])
                parent.append(c)
                birth.append(density)
                stability.append(0.0)
                stack.append((x, len(parent) - 1))
            continue
        for x in (a, b):
            if x in large:
                stack.append((x, c))
            else:
                gain(c, density, size[x])
                below = [x]
                while below:
                    y = below.pop()
                    if y < n:
                        of_point[y] = c
                    else:
                        below.extend(children[y - n])
    return parent, birth, stability, of_point


def _chosen(parent: list[int], birth: list[float], stability: list[float], settings: Settings) -> set[int]:
    """The clusters that become labels; never all points together."""
    k = len(parent)
    below: list[list[int]] = [[] for _ in range(k)]
    for c in range(1, k):
        below[parent[c]].append(c)
    if settings.selection == "leaf":
        start = [c for c in range(1, k) if not below[c]]
    else:
        best, kept = list(stability), [True] * k
        for c in range(k - 1, 0, -1):
            inner = sum(best[x] for x in below[c])
            if below[c] and inner > best[c]:
                best[c], kept[c] = inner, False
        start, look = [], list(below[0])
        while look:
            c = look.pop()
            if kept[c]:
                start.append(c)
            else:
                look.extend(below[c])
    if settings.epsilon <= 0:
        return set(start)
    chosen = set()
    for c in start:
        while 1 / birth[c] < settings.epsilon and parent[c] != 0:
            c = parent[c]
        chosen.add(c)
    return {c for c in chosen if not _above(parent, c, chosen)}


def _above(parent: list[int], c: int, chosen: set[int]) -> bool:
    c = parent[c]
    while c > 0:
        if c in chosen:
            return True
        c = parent[c]
    return False


def labels(x: np.ndarray, settings: Settings) -> np.ndarray:
    return select(tree(x, settings.min_samples), len(x), settings)


def _blocks(rows: DataFrame, extra: list[str]) -> DataFrame:
    """(group, block, ids, vectors and extra columns as arrays): rows (group, id, vector) dealt into blocks of bounded size."""
    sizes = rows.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    dealt = rows.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    lists = [F.col("s").getField(c).alias(f"{c}s") for c in ("id", "vector", *extra)]
    return dealt.groupBy("group", "block").agg(F.collect_list(F.struct("id", "vector", *extra)).alias("s")).select("group", "block", *lists)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _scan(queries: DataFrame, rows: DataFrame, k: int, foreign: bool) -> DataFrame:
    """(group, a, b, distance): the k nearest rows of each query, itself left out; foreign: of other components only, by mutual reachability.

    Each block of queries meets the group's blocks one after the other in one task, which keeps the best k so far.
    """
    extra = ["component", "core"] if foreign else []
    q = _blocks(queries, extra).select("group", F.col("block").alias("q"), *[F.col(f"{c}s").alias(f"q_{c}") for c in ("id", "vector", *extra)])
    both = q.join(_blocks(rows, extra), "group").repartition("group", "q").sortWithinPartitions("group", "q")

    def told(group, ids: np.ndarray, best: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
        a, c = np.nonzero(np.isfinite(best))
        return pa.RecordBatch.from_arrays([pa.array([group] * len(a), pa.int64()), pa.array(ids[a]), pa.array(to[a, c]), pa.array(best[a, c])], names=["group", "a", "b", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, best, to = None, None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                group, block = one.column("group")[0].as_py(), one.column("q")[0].as_py()
                if (group, block) != now:
                    if now:
                        yield told(now[0], ids, best, to)
                    now, ids = (group, block), one.column("q_id").flatten().to_numpy()
                    best, to = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), dtype=np.int64)
                others = one.column("ids").flatten().to_numpy()
                d = euclidean(_matrix(one.column("q_vector")), _matrix(one.column("vectors")))
                d[ids[:, None] == others[None, :]] = np.inf
                if foreign:
                    mine, theirs = one.column("q_component").flatten().to_numpy(), one.column("components").flatten().to_numpy()
                    cores = (one.column(c).flatten().to_numpy() for c in ("q_core", "cores"))
                    d = np.maximum(np.maximum(d, next(cores)[:, None]), next(cores)[None, :])
                    d[mine[:, None] == theirs[None, :]] = np.inf
                d, names = np.concatenate((best, d), axis=1), np.concatenate((to, np.broadcast_to(others, d.shape)), axis=1)
                first = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
                best, to = np.take_along_axis(d, first, axis=1), np.take_along_axis(names, first, axis=1)
        if now:
            yield told(now[0], ids, best, to)

    return both.mapInArrow(run, "group bigint, a bigint, b bigint, distance double")


def reachability_tree(rows: DataFrame, min_samples: int, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(group, a, b, height) of every group's spanning tree of least mutual reachability, for rows (group, id, vector) of any number.

    Boruvka's rounds: of each component the nearest link to another is taken, links of equal length by their ids.
    Candidates are the nearest neighbours found once; a point whose neighbours have all joined its own component, and
    whose farthest neighbour is nearer than the component's best link, is searched against all foreign rows. Each
    round at least halves the components of a group, and is written to the shared folder.
    """
    rows = cut_lineage(rows.select("group", "id", "vector"), "density-rows")
    near = cut_lineage(_scan(rows, rows, max(neighbours, min_samples - 1), False), "density-near")
    if min_samples > 1:
        place = F.row_number().over(_by(["group", "a"], "distance", "b"))
        core = near.withColumn("p", place).where(F.col("p") == min_samples - 1).select("group", F.col("a").alias("id"), F.col("distance").alias("core"))
        core = rows.select("group", "id").join(core, ["group", "id"], "left").withColumn("core", F.coalesce("core", F.lit(0.0)))
    else:
        core = rows.select("group", "id", F.lit(0.0).alias("core"))
    core = cut_lineage(core, "density-core")
    known = _reach(near, core)
    reach = cut_lineage(known.groupBy("group", "a").agg(F.max("distance").alias("far"), F.max("core").alias("core")), "density-far")
    known = cut_lineage(known, "density-links")
    component = rows.select("group", "id", F.col("id").alias("component"))
    trees: DataFrame | None = None
    while True:
        component = cut_lineage(component, "density-components")
        if component.groupBy("group").agg(F.count_distinct("component").alias("n")).where("n > 1").isEmpty():
            return trees if trees is not None else known.limit(0).select("group", "a", "b", F.col("height"))
        mine, theirs = component.select("group", F.col("id").alias("a"), F.col("component").alias("ca")), component.select("group", F.col("id").alias("b"), F.col("component").alias("cb"))
        links = known.join(mine, ["group", "a"]).join(theirs, ["group", "b"]).where("ca <> cb")
        best = _best(links)
        points = reach.join(mine, ["group", "a"]).join(best.select("group", F.col("ca").alias("c"), F.col("m.height").alias("height")), (F.col("ca") == F.col("c")) & (reach["group"] == best["group"]), "left").select(reach["group"], "a", "far", "core", "ca", "height")
        search = points.where(F.col("height").isNull() | (F.greatest("far", "core") < F.col("height"))).select("group", F.col("a").alias("id"), F.col("ca").alias("component"))
        cored = rows.join(core, ["group", "id"])
        found = _scan(cored.join(search, ["group", "id"]), cored.join(component, ["group", "id"]), 1, True)
        more = _reach(found, core).join(mine, ["group", "a"]).join(theirs, ["group", "b"])
        picked = cut_lineage(_best(links.unionByName(more.select(links.columns))).select("group", "m.height", F.col("m.low").alias("a"), F.col("m.high").alias("b"), "ca", F.col("m.other").alias("cb")), "density-picked")
        new = picked.select("group", "a", "b", "height").distinct()
        trees = cut_lineage(new if trees is None else trees.unionByName(new), "density-tree")
        component = component.join(_merged(picked), ["group", "component"], "left").select("group", "id", F.coalesce("root", "component").alias("component"))


def _by(keys: list[str], *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


def _reach(links: DataFrame, core: DataFrame) -> DataFrame:
    """Links with their mutual reachability, and the core distance of a."""
    one = core.select("group", F.col("id").alias("a"), F.col("core").alias("core"))
    two = core.select("group", F.col("id").alias("b"), F.col("core").alias("core_b"))
    both = links.join(one, ["group", "a"]).join(two, ["group", "b"])
    return both.select("group", "a", "b", "distance", "core", F.greatest("distance", "core", "core_b").alias("height"))


def _best(links: DataFrame) -> DataFrame:
    order = F.struct("height", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), F.col("cb").alias("other"))
    return links.groupBy("group", "ca").agg(F.min(order).alias("m"))


def _merged(picked: DataFrame) -> DataFrame:
    """(group, component, root) of components joined by their picked links, by pointing each at the least it reaches."""
    both = picked.select("group", F.col("ca").alias("x"), F.col("cb").alias("y"))
    pairs = cut_lineage(both.unionByName(both.select("group", F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "density-pairs")
    root = pairs.select("group", F.col("x").alias("component"), F.col("x").alias("root")).distinct()
    while True:
        around = pairs.join(root.select("group", F.col("component").alias("y"), F.col("root").alias("r")), ["group", "y"]).groupBy("group", F.col("x").alias("component")).agg(F.min("r").alias("r"))
        new = root.join(around, ["group", "component"]).select("group", "component", "root", F.least("root", "r").alias("next"))
        jump = new.select("group", F.col("component").alias("next"), F.col("next").alias("further"))
        new = cut_lineage(new.join(jump, ["group", "next"]).select("group", "component", F.col("root").alias("old"), F.least("next", "further").alias("root")), "density-roots")
        root = new.drop("old")
        if new.where("old <> root").isEmpty():
            return root


def large_groups(rows: DataFrame, settings: Settings) -> DataFrame:
    """(group, id, cluster) of groups of any number of rows (group, id, vector): the tree by joins, the clusters from its edges alone, 24 bytes a row."""
    edges = reachability_tree(rows, settings.min_samples)
    points = rows.select("group", "id", F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("double").alias("height"))
    both = points.unionByName(edges.select("group", F.col("a").alias("id"), "b", "height"))

    def run(df):
        import pandas as pd

        ids = np.sort(df.loc[df["height"].isna(), "id"].to_numpy())
        links = df[df["height"].notna()]
        ends = np.stack((np.searchsorted(ids, links["id"].to_numpy()), np.searchsorted(ids, links["b"].to_numpy().astype(np.int64)), links["height"].to_numpy()), axis=1)
        return pd.DataFrame({"group": df["group"].iloc[0], "id": ids, "cluster": select(ends, len(ids), settings).astype("int32")})

    return both.groupBy("group").applyInPandas(run, "group bigint, id bigint, cluster int")
