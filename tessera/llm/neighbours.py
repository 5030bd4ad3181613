"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors are lifted by one coordinate so that the largest inner product is the smallest distance. Centroids are
fitted on a bounded sample; every vector is filed under its nearest centroid and, if it lies near a boundary,
under the others whose distance is within a ratio of the least. Queries find centroids by walking an in-memory
graph of them and read the lists within a distance ratio of the nearest. Lists longer than LIST_ROWS are dealt
into parts, which are searched side by side. Equal vectors are searched once and share what was found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors that fit the centroids (more if there are over an eighth as many centroids, SAMPLE_MOST at most); vectors a
#: centroid; centroids at most, some 12 MB with their graph; rows of a part of a list.
SAMPLE_ROWS, SAMPLE_MOST, PER_CENTROID, MAX_CENTROIDS, LIST_ROWS = 32_768, 131_072, 160, 16_384, 4096
#: Distance ratios within which a vector is replicated, and a query reads a list; most replicas of one vector; lists a query reads at most.
REPLICATE_RATIO, PROBE_RATIO, REPLICAS, PROBES = 1.06, 1.35, 4, 48
#: Edges of a centroid in the graph; candidates a walk holds.
DEGREE, BEAM = 16, 64


class Centroids:
    """Centroids with a graph of their nearest neighbours and some far links, searched by best-first walks."""

    def __init__(self, points: np.ndarray, scale: float):
        self.points, self.scale = points, scale
        n = len(points)
        rng = np.random.default_rng(3)
        near = np.concatenate([_nearest(_distances(points[a : a + 512], points), min(n, DEGREE + 1)) for a in range(0, n, 512)])
        self.edges = np.concatenate([near, rng.integers(0, n, (n, 4))], axis=1)
        self.entries = rng.permutation(n)[: min(n, BEAM // 2)]

    def lift(self, v: np.ndarray, query: bool) -> np.ndarray:
        """One more coordinate: vectors get equal norms, queries are normalised and get zero."""
        if query:
            norm = np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            return np.concatenate([v / norm * self.scale, np.zeros((len(v), 1))], axis=1)
        rest = np.sqrt(np.maximum(0.0, self.scale**2 - (v * v).sum(axis=1, keepdims=True)))
        return np.concatenate([v, rest], axis=1)

    def search(self, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids of each row that the walks find, nearest first, and their distances (inf: fewer were found)."""
        n, beam = len(v), max(BEAM, k)
        cand = np.tile(self.entries, (n, 1))
        dist = _distances(v, self.points)[:, :0] if not n else np.sqrt(np.maximum(0, ((self.points[cand] - v[:, None]) ** 2).sum(axis=2)))
        seen = np.zeros((n, len(self.points)), dtype=bool)
        np.put_along_axis(seen, cand, True, axis=1)
        opened = np.zeros(cand.shape, dtype=bool)
        rows = np.arange(n)
        while len(rows):
            d = np.where(opened[rows], np.inf, dist[rows])
            best = np.argsort(d, axis=1)[:, :4]  # the four nearest that have not been opened
            worth = np.take_along_axis(d, best, axis=1)
            live = np.isfinite(worth[:, 0])
            rows, best, worth = rows[live], best[live], worth[live]
            if not len(rows):
                break
            o = opened[rows]
            np.put_along_axis(o, best, True, axis=1)
            opened[rows] = o
            new = self.edges[np.take_along_axis(cand[rows], best, axis=1)].reshape(len(rows), -1)
            new = np.where(np.isfinite(worth).repeat(self.edges.shape[1], axis=1), new, cand[rows, :1])
            fresh = ~np.take_along_axis(seen[rows], new, axis=1)
            order = np.argsort(new, axis=1, kind="stable")
            sorted_new = np.take_along_axis(new, order, axis=1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], sorted_new[:, 1:] == sorted_new[:, :-1], axis=1)
            fresh &= ~twice
            s = seen[rows]
            np.put_along_axis(s, new, True, axis=1)
            seen[rows] = s
            nd = np.sqrt(np.maximum(0, ((self.points[new] - v[rows, None]) ** 2).sum(axis=2)))
            nd[~fresh] = np.inf
            both_d, both_c = np.concatenate([dist[rows], nd], axis=1), np.concatenate([cand[rows], new], axis=1)
            both_o = np.concatenate([opened[rows], ~fresh], axis=1)
            top = np.argsort(both_d, axis=1)[:, :beam]
            if top.shape[1] > cand.shape[1]:
                grow = top.shape[1] - cand.shape[1]
                cand = np.pad(cand, ((0, 0), (0, grow)))
                dist = np.pad(dist, ((0, 0), (0, grow)), constant_values=np.inf)
                opened = np.pad(opened, ((0, 0), (0, grow)), constant_values=True)
            dist[rows], cand[rows], opened[rows] = (np.take_along_axis(x, top, axis=1) for x in (both_d, both_c, both_o))
        order = np.argsort(dist, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(cand, order, axis=1), np.take_along_axis(dist, order, axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.sqrt(np.maximum(0.0, d))


def _nearest(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least of each row, least first."""
    some = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, axis=1), axis=1, kind="stable"), axis=1)


def n_centroids(rows: int) -> int:
    return int(min(MAX_CENTROIDS, max(1, rows // PER_CENTROID)))


def fit(sample: np.ndarray, rows: int, scale: float, rounds: int = 8) -> Centroids:
    """Balanced k-means on the sample: a centroid's pull falls with the share of vectors it holds."""
    lifted = Centroids.lift(_Scale(scale), sample, False)
    k = min(n_centroids(rows), len(lifted))
    rng = np.random.default_rng(5)
    points = lifted[rng.permutation(len(lifted))[:k]]
    weight = np.ones(k)
    for _ in range(rounds):
        own = np.concatenate([np.argmin(_distances(lifted[a : a + 2048], points) * weight, axis=1) for a in range(0, len(lifted), 2048)])
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(points)
        np.add.at(sums, own, lifted)
        points = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], lifted[rng.integers(0, len(lifted), k)])
        weight = np.sqrt(weight * np.clip((size + 1) / (len(lifted) / k + 1), 0.5, 2.0) ** 0.2)
    return Centroids(points, scale)


class _Scale:
    def __init__(self, scale: float):
        self.scale = scale


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row that queries marks, the k nearest of all other rows found,
    largest inner product (in double precision, on the vectors as given) first, ties to the smaller id.

    Rows whose vector is null, zero, or holds a null or non-finite component, whose length is not the most
    common one, or whose id is null take no part. With fewer than k others, all are returned. Repeated rows count once;
    of different vectors with one id the first in order counts.
    """
    spark = common.prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    widths = {r["n"]: r["count"] for r in rows.groupBy(F.size("v").alias("n")).count().collect()}
    width = max(widths, key=lambda w: (widths[w], w), default=0)
    rows = rows.where(F.size("v") == width).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    # of equal vectors, no more than the k + 1 smallest ids can be among anyone's nearest
    low = Window.partitionBy("v").orderBy("id")
    least = rows.select("v", "id").withColumn("n", F.row_number().over(low)).where(F.col("n") <= k + 1)
    classes = common.stage(least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("cid", F.col("ids")[0]), "ann-classes")
    asked = common.stage(rows.where("q").join(classes.select("v", "cid"), "v").select("id", "cid"), "ann-queries")
    n = classes.count()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return spark.createDataFrame([], empty)
    scale = classes.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    picked = classes.select("v").orderBy(F.xxhash64("cid"), "cid").limit(min(SAMPLE_MOST, max(SAMPLE_ROWS, 8 * n_centroids(n))))
    index = spark.sparkContext.broadcast(fit(np.array([r["v"] for r in picked.toLocalIterator()], dtype=np.float64), n, scale))

    def file(query: bool):
        most, ratio = (PROBES, PROBE_RATIO) if query else (REPLICAS, REPLICATE_RATIO)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    c = index.value
                    lists, dist = c.search(c.lift(_matrix(b.column("v")), query), most)
                    near = (dist <= dist[:, :1] * ratio) & np.isfinite(dist)
                    if query:
                        near |= (np.arange(near.shape[1]) < PROBES // 2) & np.isfinite(dist)
                    near[:, 0] = True
                    row, col = np.nonzero(near)
                    yield pa.RecordBatch.from_arrays([pa.array(lists[row, col].astype(np.int64)), *(x.take(pa.array(row)) for x in b.columns)], ["list", *b.schema.names])

        return run

    posts = classes.select("cid", "v", "ids").mapInArrow(file(False), "list bigint, cid bigint, v array<double>, ids array<bigint>")
    posts = common.stage(posts, "ann-lists")
    parts = posts.groupBy("list").agg(F.ceil(F.count("*") / LIST_ROWS).alias("parts"))
    posts = posts.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")))
    own = classes.join(asked.select("cid").distinct(), "cid").select("cid", "v")
    probes = own.mapInArrow(file(True), "list bigint, cid bigint, v array<double>").join(parts, "list")
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        kinds = [("cid", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))]
        if left.num_rows and right.num_rows:
            v, ids, cid = _matrix(right.column("v")), right.column("ids").combine_chunks(), right.column("cid").to_numpy()
            for at in range(0, left.num_rows, 256):
                q = left.slice(at, 256)
                score = _matrix(q.column("v")) @ v.T
                most = min(k + 1, score.shape[1])
                edge = -np.partition(-score, most - 1, axis=1)[:, most - 1 : most]
                row, col = np.nonzero(score >= edge)  # ties at the edge stay
                order = np.lexsort((cid[col], -score[row, col], row))
                row, col = row[order], col[order]
                starts = np.searchsorted(row, np.arange(q.num_rows))
                keep = np.arange(len(row)) - starts[row] < most
                row, col = row[keep], col[keep]
                found.append(pa.table([pa.array(q.column("cid").to_numpy()[row]), pa.array(score[row, col]), ids.take(pa.array(col))], schema=pa.schema(kinds)))
        return pa.concat_tables(found) if found else pa.schema(kinds).empty_table()

    hits = probes.select("list", "part", "cid", "v").groupBy("list", "part").cogroup(posts.select("list", "part", "cid", "v", "ids").groupBy("list", "part"))
    hits = hits.applyInArrow(search, "cid bigint, score double, ids array<bigint>")
    each = hits.select("cid", F.explode("ids").alias("vec_id"), "score").groupBy("cid", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id")
    top = each.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    out = asked.select(F.col("id").alias("query_id"), "cid").join(top, "cid").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
