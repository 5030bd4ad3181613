"""Clustering against plain versions."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster, density, linkage
from tessera.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain_average_linkage(d, k):
    groups = [[i] for i in range(len(d))]
    while len(groups) > k:
        pairs = [(d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)
    label = np.zeros(len(d), dtype=int)
    for k, g in enumerate(sorted(groups, key=min)):
        label[g] = k
    return label


def plain_silhouette(d, label):
    s = []
    for i in range(len(d)):
        own = [j for j in range(len(d)) if label[j] == label[i] and j != i]
        if not own:
            s.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, label == k].mean() for k in set(label) if k != label[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def _bundles(seed, n, width=6):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, width)) + rng.integers(0, 3, (n, 1)) * 3 * rng.standard_normal((1, width))


@pytest.mark.parametrize("seed", range(12))
def test_dendrogram_and_silhouettes_equal_plain_ones(seed):
    n = 4 + 2 * seed
    d = cluster.cosine_distances(_bundles(seed, n))
    merges = linkage.dendrogram(d)
    assert all(np.array_equal(linkage.cut(merges, n, k), plain_average_linkage(d, k)) for k in range(1, n + 1))
    low, high = (min(n, 3), n // 2) if n // 2 >= min(n, 3) + 1 else (2, 3)
    want = {k: plain_silhouette(d, plain_average_linkage(d, k)) for k in range(low, high)}
    got = linkage.silhouettes(d, merges, low, high)
    assert got == pytest.approx(want)
    k, label = linkage.best_cut(d)
    assert k == max(want, key=want.get) and np.array_equal(label, plain_average_linkage(d, k))


def test_small_groups():
    assert [linkage.best_cut(np.zeros((n, n)))[1].tolist() for n in (0, 1)] == [[], [0]]
    assert len(linkage.best_cut(np.zeros((9, 9)))[1]) == 9  # equal vectors
    assert density.labels(np.zeros((5, 2)), density.Settings(1, 2, "eom", 0.5)).shape == (5,)


def test_five_thousand_rows_within_a_minute():
    x = np.random.default_rng(0).standard_normal((5000, 32))
    start = time.time()
    linkage.best_cut(cluster.cosine_distances(x))
    density.labels(x, density.SETTINGS["density"])
    assert time.time() - start < 60


def plain_density(x, s):
    """Clusters by removing the longest edge of each part's own spanning tree again and again."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, s.min_samples - 1]
    d = np.maximum(np.maximum(d, core[:, None]), core[None])

    def split(points):
        left, rest, edges = [points[0]], list(points[1:]), []
        while rest:
            h, _, _, i, j = min((d[i, j], min(i, j), max(i, j), i, j) for i in left for j in rest)
            edges.append((h, i, j))
            left.append(j)
            rest.remove(j)
        edges = sorted((h, min(i, j), max(i, j)) for h, i, j in edges)
        longest, part = edges.pop(), {p: {p} for p in points}
        for _, i, j in edges:
            both = part[i] | part[j]
            for p in both:
                part[p] = both
        return longest[0], sorted(part[longest[1]]), sorted(part[longest[2]])

    def grow(points, birth, up):
        node = {"points": points, "birth": birth, "up": up, "stability": 0.0, "below": []}
        now = points
        while len(now) > 1:
            h, a, b = split(now)
            large = [p for p in (a, b) if len(p) >= s.min_size]
            gone = len(now) if len(large) != 1 else len(now) - len(large[0])
            node["stability"] += (1 / h - birth) * gone
            if len(large) == 2:
                node["below"] = [grow(p, 1 / h, node) for p in large]
            if len(large) != 1:
                break
            now = large[0]
        return node

    def stable(node):
        inner = [stable(c) for c in node["below"]]
        total = sum(v for v, _ in inner)
        if inner and (total > node["stability"] or node["up"] is None):
            return total, [c for _, own in inner for c in own]
        return node["stability"], [] if node["up"] is None else [node]

    def leaves(node):
        return [x for c in node["below"] for x in leaves(c)] if node["below"] else [] if node["up"] is None else [node]

    root = grow(list(range(n)), 0.0, None)
    chosen = stable(root)[1] if s.selection == "eom" else leaves(root)
    tops = []
    for c in chosen:
        while s.epsilon and 1 / c["birth"] < s.epsilon and c["up"]["up"] is not None:
            c = c["up"]
        tops.append(c)
    sets = {frozenset(c["points"]) for c in tops}
    sets = sorted((p for p in sets if not any(p < q for q in sets)), key=min)
    label = np.full(n, -1)
    for k, p in enumerate(sets):
        label[sorted(p)] = k
    return label


SETTINGS = [*density.SETTINGS.values(), density.Settings(1, 2, "eom"), density.Settings(4, 5, "eom"), density.Settings(3, 4, "leaf", 1.0)]


def _clouds(seed, n, width=4):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((4, width)) * 2)[rng.integers(0, 4, n)] + 0.3 * rng.standard_normal((n, width))


@pytest.mark.parametrize("settings", SETTINGS)
def test_density_equals_the_plain_version(settings):
    for seed, n in enumerate((6, 13, 30, 45)):
        x = _clouds(seed, n)
        assert density.labels(x, settings).tolist() == plain_density(x, settings).tolist(), (seed, n)


def _frame(spark, groups):
    rows = [(g, i, [float(v) for v in x]) for g, own in groups.items() for i, x in enumerate(own)]
    return spark.createDataFrame(rows, "topic int, id bigint, vector array<double>")


@pytest.mark.parametrize("settings", [density.SETTINGS["density"], density.Settings(3, 4, "leaf")])
def test_the_tree_by_joins_gives_the_same_clusters(spark, settings, monkeypatch):
    monkeypatch.setattr(density, "BLOCK_ROWS", 16)
    groups = {1: _clouds(1, 26), 2: _clouds(2, 6), 3: _clouds(3, 1)}
    rows = _frame(spark, groups).select(F.col("topic").cast("bigint").alias("group"), "id", "vector")
    edges = density.reachability_tree(rows, settings.min_samples, neighbours=3).toPandas()
    found = density.large_groups(rows, settings).toPandas()
    for g, x in groups.items():
        assert np.allclose(np.sort(edges[edges["group"] == g]["height"]), np.sort(density.tree(x, settings.min_samples)[:, 2]))
        assert found[found["group"] == g].sort_values("id")["cluster"].tolist() == density.labels(x, settings).tolist()


def test_large_groups(spark, monkeypatch):
    monkeypatch.setattr(cluster, "GROUP_ROWS", 40)
    monkeypatch.setattr(cluster, "MEANS_ROUNDS", 2)
    groups = {1: np.concatenate([_bundles(k, 60) + 9 * np.eye(6)[k] for k in range(3)]), 2: _bundles(5, 30), 3: np.ones((100, 6))}
    rows = _frame(spark, groups)
    got = cluster.cluster_groups(rows, "agglomerative", named=True).toPandas()
    assert len(got) == 310 and not got.duplicated(["topic", "id"]).any()
    assert got.groupby("topic")["method"].unique().map(list).to_dict() == {1: ["agglomerative-in-parts"], 2: ["agglomerative"], 3: ["agglomerative-in-parts"]}
    small = got[got["topic"] == 2].sort_values("id")["cluster"].tolist()
    assert small == linkage.best_cut(cluster.cosine_distances(groups[2]))[1].tolist()
    parts = cluster.bisected(rows.where("topic < 3").select(F.col("topic").cast("bigint").alias("group"), "id", "vector"), 70).toPandas()
    assert parts.groupby(["group", "part"]).size().max() <= 70 and len(parts) == 210


def test_breaking_up_and_settling(spark, monkeypatch):
    x = np.concatenate([_clouds(1, 40, 3), _clouds(2, 5, 3)])
    rows = _frame(spark, {1: x, 2: x[:4]})
    found = rows.select("topic", "id", F.when(F.col("id") < 40, 0).otherwise(1).alias("cluster"))
    for most in (5000, 10):
        monkeypatch.setattr(cluster, "GROUP_ROWS", most)
        got = cluster.break_largest(rows, found, least=6, rounds=3).toPandas()
        assert len(got) == 49 and (got[got["topic"] == 2]["cluster"] == 0).all()
        assert got[got["topic"] == 1]["cluster"].nunique() == 5
        if most == 5000:
            label = np.array([0] * 40 + [1] * 5)
            for _ in range(3):
                ks, n = np.unique(label, return_counts=True)
                own = np.flatnonzero(label == ks[n.argmax()])
                part = plain_average_linkage(cluster.cosine_distances(x[own]), 2)
                label[own[part == 1]] = label.max() + 1
            assert got[got["topic"] == 1].sort_values("id")["cluster"].tolist() == label.tolist()
    noisy = rows.select("topic", "id", F.when(F.col("id") % 3 == 0, -1).otherwise(0).alias("cluster"))
    settled = cluster.settle_noise(rows, noisy).toPandas()
    assert len(settled) == 49 and settled["cluster"].min() == 0 and (settled[settled["id"] % 3 == 0]["cluster"] > 0).all()


@pytest.mark.parametrize("name", ["cluster_agglomerative", "cluster_density", "cluster_density_leaf", "cluster_affinity", "cluster_best", "cluster_members", "reclustered", "noise_settled", "largest_broken_up", "collapsed_clusters", "sidebar_clusters"])
def test_queries_cover_their_rows(spark, name):
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    got = catalog.queries()[name](spark, DATA)
    rows = got.collect()
    if name == "cluster_members":
        assert sum(r["size"] for r in rows) == n
    else:
        assert len(rows) == n and len({(r["topic"], r["id"]) for r in rows}) == n


def test_queries_equal_plain_versions(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").toPandas()
    topics = max(25, len(e) // 100)
    got = {name: catalog.queries()[f"cluster_{name}"](spark, DATA).toPandas() for name in ("agglomerative", "density", "density_leaf")}
    for topic in range(topics):
        x = np.stack(e[e["vec_id"] % topics == topic]["embedding"].to_list()).astype(float)
        own = {k: v[v["topic"] == topic].sort_values("id")["cluster"].tolist() for k, v in got.items()}
        for name, settings in density.SETTINGS.items():
            assert own[name] == plain_density(x, settings).tolist()
        d = cluster.cosine_distances(x)
        assert own["agglomerative"] == linkage.best_cut(d)[1].tolist()


def test_whole_linkage_of_large_groups_is_that_of_one_task(spark, monkeypatch):
    from tessera.operators import wide_linkage

    x = np.concatenate([_bundles(3, 150), _bundles(5, 30)])
    odd = np.concatenate([_bundles(8, 60), np.repeat(_bundles(9, 1), 20, axis=0), np.zeros((3, 6))])
    groups = {1: x, 2: _bundles(6, 45), 3: odd, 4: np.random.default_rng(1).standard_normal((99, 6)), 5: _bundles(7, 20)}
    rows = _frame(spark, groups).withColumn("reason", F.when(F.col("id") % 10 == 3, "no text"))
    want = {(r["topic"], r["id"]): r["cluster"] for r in cluster.with_ignored(rows, "agglomerative").collect()}
    for name, most in (("BLOCK_ROWS", 64), ("MET_ROWS", 16), ("POINTS", 16), ("MERGES", 2)):
        monkeypatch.setattr(wide_linkage, name, most)
    monkeypatch.setattr(cluster, "GROUP_ROWS", 40)
    got = {(r["topic"], r["id"]): r["cluster"] for r in cluster.with_ignored(rows, "agglomerative").collect()}
    assert got == want
    assert cluster.cluster_groups(rows.where("topic = 2"), "agglomerative", named=True, whole=True).select("method").distinct().collect() == [("agglomerative",)]
