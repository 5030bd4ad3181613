"""The hierarchical model recovers planted effects; the parameter search finds planted optima."""

import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import additive, ranking, tuning
from tessera.plans import catalog, evaluation

DATA = "/root/testdata/sf0.001"
PLANTED = {"size": {"a": -0.06, "b": 0.01, "c": 0.05}, "kind": {"x": 0.03, "y": -0.03}}


@pytest.fixture(scope="module")
def sampled(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(1500):
        s, k = rng.choice(["a", "b", "c"], p=[0.2, 0.5, 0.3]), rng.choice(["x", "y"])
        rows.append((str(s), str(k), float(0.6 + PLANTED["size"][s] + PLANTED["kind"][k] + 0.02 * rng.standard_normal())))
    df = spark.createDataFrame([*rows, ("a", "x", None), ("a", "x", float("nan"))], "size string, kind string, y double")
    return df, additive.sample(df, ["size", "kind"], "y", draws=800, tune=400)


def test_planted_effects_lie_in_their_intervals(sampled):
    found = {(r["factor"], r["level"]): r for r in additive.summary(sampled[1]).collect()}
    for f, own in PLANTED.items():
        for level, effect in own.items():
            r = found[f, level]
            assert r["low_95"] <= effect <= r["high_95"] and r["low_95"] <= r["low_80"] <= r["mean"] <= r["high_80"] <= r["high_95"]
            assert r["p_above"] == pytest.approx(float(effect > 0), abs=0.05) or abs(effect) < 0.02
            assert r["r_hat"] < 1.03 and r["ess"] > 300
    assert found["intercept", ""]["mean"] == pytest.approx(0.6, abs=0.01)
    assert found["sigma", ""]["mean"] == pytest.approx(0.02, abs=0.002)
    assert set(found) == {(f, v) for f, own in PLANTED.items() for v in [*own, "tau"]} | {("intercept", ""), ("sigma", "")}


def test_design_equals_the_rows(sampled):
    d = additive.design(sampled[0], ["size", "kind"], "y")
    rows = [r for r in sampled[0].collect() if r["y"] is not None and not np.isnan(r["y"])]
    x = np.array([[1.0, *(float(r[f] == v) for f, v in d.names[1:])] for r in rows])
    y = np.array([r["y"] for r in rows])
    assert np.allclose(d.xx, x.T @ x) and np.allclose(d.xy, x.T @ y) and d.yy == pytest.approx(y @ y) and d.n == len(y)


def test_chains_are_repeatable_and_differ(sampled):
    draws = sampled[1].where("factor = 'sigma' and draw < 3").orderBy("chain", "draw").collect()
    again = sampled[1].where("factor = 'sigma' and draw < 3").orderBy("chain", "draw").collect()
    assert draws == again and len({r["effect"] for r in draws}) == 12


def test_search_beats_the_grid_on_a_hill(spark):
    space = {"x": tuning.Range(0, 10), "n": tuning.Range(1, 1000, whole=True, log=True)}
    shares = []

    def evaluate(trials, share):
        shares.append((trials.count(), share))
        return trials.select("trial", (-F.pow(F.col("x") - 7.3, 2) - F.pow(F.log10("n") - 1, 2)).alias("score"))

    found = tuning.search(spark, space, evaluate, rounds=5, trials=12, seed=3)
    again = tuning.search(spark, space, evaluate, rounds=5, trials=12, seed=3)
    assert [t.values for t in found] == [t.values for t in again]
    assert shares[:3] == [(12, 0.25), (6, 0.5), (3, 1.0)] and len(found) == 60
    even = max(-((x - 7.3) ** 2) - (np.log10(n) - 1) ** 2 for x in np.linspace(0, 10, 6) for n in np.logspace(0, 3, 5))
    assert found[0].share == 1 and found[0].score >= even
    assert all(t.values["n"] == int(t.values["n"]) for t in found)


def test_searched_parameters_are_no_worse_than_the_grid(spark):
    rows = catalog.queries()["searched_parameters"](spark, DATA).orderBy("place").collect()
    near, gold = evaluation._tagging(spark, DATA)
    grid = [(docs, factor, power) for docs in (5, 10, 20, 50, 100) for factor in (0.25, 1.0, 3.0) for power in (1.0, 3.0, 10.0)]
    trials = spark.createDataFrame([(i, float(a), b, c) for i, (a, b, c) in enumerate(grid)], "trial int, docs double, factor double, power double")
    best = evaluation.tagging_recall(near, gold, trials, 1.0).agg(F.max("score")).first()[0]
    assert rows[0]["recall"] >= best - 1e-12
    own = rows[0]
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    docs = [r for r in e if r["vec_id"] % 50]
    x = np.array([r["embedding"] for r in docs], float)
    hits = total = 0
    for q in (r for r in e if r["vec_id"] % 50 == 0):
        v = np.array(q["embedding"], float)
        score = x @ v / (np.linalg.norm(x, axis=1) * np.linalg.norm(v))
        votes = {}
        for i in sorted(range(len(docs)), key=lambda i: (-score[i], docs[i]["vec_id"]))[: own["docs"]]:
            cos = 1 - 2 * (1 - score[i]) ** 2 / 2
            w = (1 - np.sqrt(max(0.0, 1 - cos * cos))) ** own["power"]
            for slug in (f"t{docs[i]['label']}", f"m{docs[i]['label'] % 3}"):
                votes[slug] = votes.get(slug, 0) + w
        edge = np.mean(list(votes.values())) + own["factor"] * np.std(list(votes.values()))
        wanted = {f"t{q['label']}", f"m{q['label'] % 3}"}
        hits, total = hits + sum(votes.get(s, -1) > edge for s in wanted), total + 2
    assert own["recall"] == pytest.approx(hits / total)


def test_ranks_name_every_set_once():
    for n, k in ((1, 1), (5, 3), (7, 7), (9, 4)):
        sets = [tuple(ranking.set_of_rank(r, n, k)) for r in range(math.comb(n, k))]
        assert sets == list(itertools.combinations(range(n), k))
    assert ranking.drawn_ranks(10, 10, "a") == list(range(10))
    many = ranking.drawn_ranks(math.comb(500, 60), 50, "a")  # far beyond what can be listed
    assert len(set(many)) == 50 and many == ranking.drawn_ranks(math.comb(500, 60), 50, "a") != ranking.drawn_ranks(math.comb(500, 60), 50, "b")
    counts = collections.Counter(r for s in range(3000) for r in ranking.drawn_ranks(6, 3, str(s)))
    assert all(abs(c / 3000 - 0.5) < 0.05 for c in counts.values())


def test_candidate_sets_of_small_and_large_problems(spark):
    rows = [(1, i) for i in range(4)] + [(1, 2), (1, None)] + [(None, i) for i in range(3)] + [(3, i) for i in range(200)] + [(4, 1)]
    items = spark.createDataFrame(rows, "problem bigint, item int")
    got = ranking.candidate_sets(items, 3, 20).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["problem"]].append(tuple(r["items"]))
    assert sorted(by[1]) == list(itertools.combinations(range(4), 3)) and by[None] == [(0, 1, 2)] and 4 not in by
    assert len(set(by[3])) == 20 and all(list(s) == sorted(set(s)) and len(s) == 3 for s in by[3])
    again = ranking.candidate_sets(items.repartition(7), 3, 20).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert ranking.candidate_sets(items.limit(0), 3, 20).count() == 0
