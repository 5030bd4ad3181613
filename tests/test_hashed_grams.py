"""Grams counted by hash first, and ranks over lists of links."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster
from tessera.plans import texts


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_only_frequent_grams_are_counted_by_their_words(spark, monkeypatch, most):
    cuts, cut = [], texts.cut_lineage
    monkeypatch.setattr(texts, "cut_lineage", lambda df, name: cuts.append(name) or cut(df, name))
    monkeypatch.setattr(texts, "MOST_HASHES", most)
    words = [[f"w{(i * j) % 7}" for j in range(i % 23)] for i in range(60)]
    docs = spark.createDataFrame([(" ".join(w),) for w in words] + [(None,), ("",)], "text string")
    count = Counter(" ".join(w[k : k + 3]) for w in words for k in range(len(w) - 2))
    for top in (5, 40, 10_000):  # ties at the edge, and fewer grams than wanted
        want = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:top]
        assert [tuple(r) for r in texts._ngrams(docs, 3, top).collect()] == want
    assert cuts.count("grams") == (2 if most else 0)


def test_a_hash_that_two_grams_share_leaves_none_out(spark, monkeypatch):
    monkeypatch.setattr(texts.F, "xxhash64", lambda *c: F.length(F.concat_ws(" ", *c)))
    docs = spark.createDataFrame([("a b a b a b",), ("c d c d c d",), ("eee f eee f",)], "text string")
    assert [tuple(r) for r in texts._ngrams(docs, 2, 3).collect()] == [("a b", 3), ("c d", 3), ("b a", 2)]


def test_links_lie_in_lists_of_bounded_length(spark, monkeypatch):
    cuts, cut = {}, cluster.cut_lineage
    monkeypatch.setattr(cluster, "cut_lineage", lambda df, name: cuts.setdefault(name, cut(df, name)))
    monkeypatch.setattr(cluster, "LINK_ROWS", 10)
    edges = spark.range(1000).selectExpr("0L as src", "id + 1 as dst").unionByName(spark.range(1000).selectExpr("id + 1 as src", "0L as dst"))
    ranks = {r["node"]: r["rank"] for r in cluster.page_rank(edges, rounds=2).collect()}
    assert ranks[0] == pytest.approx(0.15 / 1001 + 0.85 * 1000 * (0.15 / 1001 + 0.85 * (1 / 1001) / 1000)) and len(ranks) == 1001
    assert cuts["links"].agg(F.max(F.size("to"))).first()[0] < 40
