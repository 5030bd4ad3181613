import numpy as np
import pytest

from tessera.operators import cluster, density, generation, intervals, labels, linkage, ordering, ranking, retrieval, select


def test_toy_evaluation(spark):
    gold = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a"]), ("3", ["a", "b", "c"])], "ref string, slugs array<string>")
    pred = spark.createDataFrame([("1", ["a"]), ("2", ["a"]), ("3", ["a", "c"])], "ref string, slugs array<string>")
    m = labels.micro(labels.pairs(gold, pred)).first()
    assert (m["tp"], m["fp"], m["fn"], m["precision"]) == (4, 0, 2, 1.0)
    assert m["recall"] == pytest.approx(4 / 6)


def test_metrics_without_relevant_documents(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id bigint, vector array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.1]), (8, [1.0, 0.0])], "query_id bigint, vector array<double>")
    qrels = spark.createDataFrame([(7, 2, 1), (8, 1, 0)], "query_id bigint, doc_id bigint, relevance int")
    m = {r["query_id"]: r for r in retrieval.query_metrics(retrieval.rank(docs, queries, 5), qrels, queries).collect()}
    assert m[7]["mrr_3"] == 0.5 and m[7]["recall_1"] == 0.0 and m[7]["ndcg_5"] == pytest.approx(1 / np.log2(3))
    assert m[8]["ndcg_10"] == m[8]["recall_10"] == m[8]["mrr_10"] == 0.0
    first = {r[0]: r[1] for r in retrieval.first_relevant_rank(docs, queries, qrels).collect()}
    assert first == {7: 2.0, 8: float("inf")}


def test_plackett_luce_statistics(spark):
    rankings = spark.createDataFrame([(0, 0, [0, 1, 2]), (0, 1, [2, 0, 1])], "problem int, ranking int, items array<int>")
    latent = spark.createDataFrame([(0, 0, 0.5), (0, 1, 1.0), (1, 0, 0.25), (1, 1, 0.75)], "ranking int, stage int, z double")
    out = {r["item"]: (r["shape"], r["rate"]) for r in ranking.sufficient_statistics(rankings, latent, 2.0, 3.0).collect()}
    assert out == {0: (4.0, 4.5), 1: (3.0, 5.5), 2: (3.0, 4.75)}


def test_gibbs_orders_items():
    assert ranking.gibbs([[0, 1, 2]] * 30, 3, draws=40).mean(axis=0).argsort().tolist() == [2, 1, 0]
    assert ranking.gibbs([], 2, draws=5).shape == (5, 2)


def test_posterior_query_takes_all_draws(spark, monkeypatch):
    from inspect import signature

    from tessera.plans import modelling

    draws = signature(ranking.posterior).parameters["draws"].default
    monkeypatch.setattr(ranking, "posterior", lambda rankings, items, draws=draws: draws)
    monkeypatch.setattr(ranking, "summary", lambda found: found)
    assert modelling.pl_posterior(spark, "/root/testdata/sf0.001") == draws == 80


def test_posterior_query_takes_all_customers(spark, monkeypatch):
    from tessera.plans import modelling

    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(ranking, "posterior", lambda rankings, items: rankings)
    monkeypatch.setattr(ranking, "summary", lambda found: found)
    orders, lines = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    want = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select("o_custkey").distinct().count()
    assert modelling.pl_posterior(spark, d).select("problem").distinct().count() == want


def test_spanning_tree_neighbourhoods():
    u = np.array([[0, 9, 1, 1], [9, 0, 8, 1], [1, 8, 0, 7], [1, 1, 7, 0]], float)
    assert sorted(ranking.neighbourhoods(ranking.max_spanning_tree(u), 4, 3)) == [(0, 1, 2), (1, 2, 3)]
    assert len(ranking.next_batch(u, 3, 2, overlap=1)) == 1


def test_clusters_of_two_bundles():
    x = np.array([[1, 0.01 * i] for i in range(5)] + [[0.01 * i, 1] for i in range(5)])
    d = cluster.cosine_distances(x)
    for label in (linkage.cut(linkage.dendrogram(d), 10, 2), cluster.affinity(d), density.labels(x, density.Settings(1, 2, "eom", 0.0))):
        assert len(set(label[:5])) == len(set(label[5:])) == 1 and label[0] != label[9]
    assert cluster.collapse(d, 0.3).tolist() == [0] * 5 + [1] * 5


def test_selection_is_best():
    s = [select.Source(str(i), i // 2, float(10 - i), ("a" if i % 3 else "b",), book=f"k{i % 2}") for i in range(8)]
    links = {frozenset(["0", "2"])}
    got = select.solve(s, links, most=3)
    from itertools import combinations

    best = max((select.objective(list(c), s, links) for c in combinations(s, 3) if len({x.cluster for x in c}) == 3), default=None)
    assert select.objective(got, s, links) == best


def test_selection_ends_at_the_optimum():
    own = [select.Source(str(k), int(c), float(80 - k), (f"c{k % 4}",), f"b{k // 12}") for k, c in enumerate(np.random.default_rng(2).integers(0, 30, 80))]
    states = {(0, frozenset(), frozenset()): 0.0}  # number, books and categories so far: the largest weight
    for c in {s.cluster for s in own}:
        for (k, books, cats), w in list(states.items()):
            for s in (s for s in own if s.cluster == c and k < 20):
                key = (k + 1, books | {s.book}, cats | set(s.categories))
                states[key] = max(states.get(key, -np.inf), w + s.weight)
    best = max(w - 400 * (20 - len(b)) - 80 * (4 - len(c)) for (k, b, c), w in states.items() if k == 20)
    assert select.objective(select.solve(own), own, set()) == best


def test_intervals(spark):
    rows = spark.createDataFrame([("a", "x", 1, 100), ("b", "x", 10, 20), ("c", "x", 10, 20), ("d", "y", 10, 20)], "ref string, book string, start int, end int")
    assert sorted(r["ref"] for r in intervals.drop_containing(rows).collect()) == ["b", "d"]
    near = spark.createDataFrame([("x", 1, 2), ("x", 4, 5), ("x", 9, 9)], "book string, start int, end int")
    assert sorted((r["start"], r["end"], r["n"]) for r in intervals.merge_close(near).collect()) == [(1, 5, 2), (9, 9, 1)]


def test_samples(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    assert ordering.sample_n(rows, "k", 10, 1).count() == 10
    with pytest.raises(ValueError):
        ordering.sample_n(rows, "k", 101, 1)


def test_failures_become_a_column(spark):
    def call(p):
        if p == "bad":
            raise ValueError("no")
        return "Yes"

    rows = spark.createDataFrame([("ok",), ("bad",)], "p string")
    assert {(r["p"], r["answer"], r["error"]) for r in generation.ask(rows, "p", call).collect()} == {("ok", "Yes", None), ("bad", None, "no")}
    assert [r["p"] for r in generation.keep_if(rows, "p", call).collect()] == ["ok"]


def test_cache_is_reused(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "p string")
    path = f"file://{tmp_path}/cache"
    assert generation.cached_ask(rows, "p", lambda p: p.upper(), path).count() == 3
    again = generation.cached_ask(rows, "p", lambda p: "other", path)
    assert {r["answer"] for r in again.collect()} == {"A", "B"}
