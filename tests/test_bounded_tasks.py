"""What a task or a Python worker holds at once does not grow with the tables."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera import session
from tessera.operators import chunking, cluster, intervals, linkage, ranking
from tessera.plans import relational

DATA = "/root/testdata/sf0.001"


def sizes():
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    return run


def test_batches_of_python_workers_have_bounded_bytes(spark):
    texts = session.prepare(spark).range(10_000).coalesce(1).select(F.repeat(F.lit("x"), 1000).alias("text"))
    got = texts.mapInArrow(sizes(), "rows bigint, bytes bigint").collect()
    assert sum(r["rows"] for r in got) == 10_000 and max(r["bytes"] for r in got) < 3_000_000


def test_what_the_session_says_of_batches_stays(spark):
    key, ours = session.BATCH_BYTES
    spark.conf.set(key, "7m")
    try:
        assert session.prepare(spark).conf.get(key) == "7m"
    finally:
        spark.conf.set(key, ours)


def test_vectors_are_sent_on_batch_by_batch(spark):
    units = spark.range(1000).coalesce(1).select("id", F.lit("word").alias("text"))
    got = chunking._with_vectors(units, lambda texts: [[0.0] * 2000 for _ in texts]).mapInArrow(sizes(), "rows bigint, bytes bigint").collect()
    assert sum(r["rows"] for r in got) == 1000 and max(r["bytes"] for r in got) < 3_000_000


def test_rankings_are_dealt_into_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    found = relational._rankings(spark, DATA)
    assert found.rdd.getNumPartitions() >= lines // 500
    assert ranking.exposures(found, lines).rdd.getNumPartitions() >= lines // 500
    assert ranking.sufficient_statistics(found, rows=lines).rdd.getNumPartitions() >= lines // 500


def test_one_pass_gives_the_statistics_of_unit_latent_times(spark):
    rows = [(1, 1, [3, 5, 7]), (1, 2, [5, 3]), (2, 3, [4]), (None, 4, [1, 2])]
    rankings = spark.createDataFrame(rows, "problem int, ranking int, items array<int>")
    latent = spark.createDataFrame([(r, k, 1.0) for _, r, i in rows for k in range(len(i))], "ranking int, stage int, z double")
    known = rankings.where("problem is not null")
    ordered = lambda df: sorted(map(tuple, df.collect()))
    assert ordered(ranking.sufficient_statistics(known)) == ordered(ranking.sufficient_statistics(known, latent)) == ordered(ranking.sufficient_statistics(known, rows=4))
    assert ranking.sufficient_statistics(rankings).count() == 6


def test_ranges_are_merged_in_tasks_of_bounded_rows(spark, monkeypatch):
    dealt, seen = session.dealt, []
    monkeypatch.setattr(intervals, "dealt", lambda df, rows, *keys: seen.append((rows, keys)) or dealt(df, rows, *keys))
    rows = spark.range(3000).selectExpr("id % 3 as book", "id * 2 as start", "id * 2 + 1 as end")
    assert sorted(map(tuple, intervals.merge_close(rows).collect())) == [(k, 2 * k + 6 * i, 2 * k + 6 * i + 1, 1) for k in range(3) for i in range(1000)]
    assert seen == [(3000, ("book", "__bin")), (3000, ("book",))]


def most_held(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_average_linkage_holds_about_one_matrix_of_distances():
    n = 1500
    x, matrix = np.random.default_rng(3).standard_normal((n, 16)), 8 * n * n
    d, held = most_held(lambda: cluster.cosine_distances(x))
    assert held < 1.3 * matrix
    merges, held = most_held(lambda: linkage.dendrogram(d))
    assert held < 1.3 * matrix
    found, held = most_held(lambda: linkage.silhouettes(d, merges, 3, n // 2))
    assert held < 1.5 * matrix
    label, held = most_held(lambda: cluster.METHODS["agglomerative"](x))
    assert held < 1.8 * matrix
    assert np.array_equal(label, linkage.best_cut(d)[1]) and found == linkage.silhouettes(lambda: cluster.cosine_distances(x), merges, 3, n // 2)
