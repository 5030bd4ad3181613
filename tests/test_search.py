"""Search in blocks and the skyline against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval, search


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((700, 5)), 1)
    x[600:] = x[:100]  # ties
    docs = spark.createDataFrame([(i, [float(v) for v in x[i]], int(i % 7)) for i in range(700)], "doc_id bigint, vector array<float>, label int").repartition(5)
    q = np.round(rng.standard_normal((40, 5)), 1)
    queries = spark.createDataFrame([(i, [float(v) for v in q[i]], int(i % 9)) for i in range(40)], "query_id bigint, vector array<float>, label int")
    return x.astype(np.float32).astype(float), q.astype(np.float32).astype(float), docs, queries


def plain(x, q, k, measure):
    s = search.scores(q, x, measure)
    return {i: [int(j) for j in sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k]] for i in range(len(q))}


@pytest.mark.parametrize("measure", ["dot", "euclidean"])
@pytest.mark.parametrize("query_bytes", [None, 500])
def test_top_equals_all_pairs(spark, vectors, measure, query_bytes, monkeypatch):
    """Broadcast queries, and queries dealt into groups that never pass the driver."""
    monkeypatch.setattr(search, "STEP_SCORES", 400)
    x, q, docs, queries = vectors
    if query_bytes:
        monkeypatch.setattr(search, "_broadcast", None)
    got = retrieval.rank(docs, queries, 12, measure, query_bytes=query_bytes).collect()
    found = {i: [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] for i in range(40)}
    assert found == plain(x, q, 12, measure)


def test_rows_sent_on_are_bounded_by_tasks(spark, vectors):
    _, _, docs, queries = vectors
    many = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        assert search.top(many, queries, 10).count() <= 40 * 10 * 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ranks_by_label_equal_judgements(spark, vectors):
    _, _, docs, queries = vectors
    qrels = docs.select("doc_id", "label").join(queries.select("query_id", "label"), "label").select("query_id", "doc_id", F.lit(1).alias("relevance"))
    hits, first = retrieval.rank_by_label(docs, queries, 4, first=True)
    want = retrieval.first_relevant_rank(docs, queries, qrels)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, want.collect()))
    assert {r[1] for r in first.collect()} >= {float("inf")} and max(r[1] for r in first.collect() if r[1] < float("inf")) > 4
    by_label = retrieval.metrics_by_label(hits, docs, queries, (3,))
    by_rows = retrieval.query_metrics(retrieval.rank(docs, queries, 4), qrels, queries, (3,))
    assert np.allclose(sorted(map(tuple, by_label.collect())), sorted(map(tuple, by_rows.collect())))
    assert retrieval.rank(docs.limit(0), queries, 3).count() == retrieval.rank(docs, queries.limit(0), 3).count() == 0


def test_skyline_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.random((900, 3)), 2)
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(900, 1.0, None, 0.0), (901, float("nan"), 0.0, 0.0), (902, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double").repartition(6)
    y = np.array([[np.inf if v is not None and np.isnan(v) else v for v in r[1:]] for r in rows if None not in r])
    want = {r[0] for i, r in enumerate(r for r in rows if None not in r) if not any((o >= y[i]).all() and (o > y[i]).any() for o in y)} | {900}
    found = retrieval.pareto(df, ["a", "b", "c"])
    assert {r["k"] for r in found.collect()} == want and {901, 902} <= want
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert retrieval.pareto(df.limit(0), ["a", "b"]).count() == 0
