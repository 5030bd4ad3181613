"""Samplers that step together and centres that are met as matrices give what one at a time gives."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.operators import gather, ranking


def plain(rankings, n, draws=80, burn_in=80, thin=2, shape=1.5, rate=1.0):
    rng = np.random.default_rng(0)
    if not rankings:
        return np.log(rng.gamma(shape, 1 / rate, (draws, n)))
    size = np.array([len(r) for r in rankings])
    col = np.arange(size.max())
    placed, stages = col < size[:, None], col < size[:, None] - 1
    items = np.full(placed.shape, n)
    items[placed] = np.concatenate([np.asarray(r) for r in rankings])
    wins, skill, out, step = shape + np.bincount(items[stages], minlength=n)[:n], np.ones(n), [], 0
    while len(out) < draws:
        left = np.cumsum(np.append(skill, 0.0)[items][:, ::-1], axis=1)[:, ::-1]
        waits = np.where(stages, rng.standard_exponential(items.shape) / np.where(stages, left, 1.0), 0.0)
        skill = rng.gamma(wins, 1 / (rate + np.bincount(items[placed], weights=np.cumsum(waits, axis=1)[placed], minlength=n)[:n]))
        if step >= burn_in and (step - burn_in) % thin == 0:
            out.append(np.log(skill))
        step += 1
    return np.array(out)


def test_problems_side_by_side_draw_what_each_draws_alone():
    rng = np.random.default_rng(5)
    problems = [([rng.permutation(n)[: rng.integers(1, n + 1)].tolist() for _ in range(rng.integers(0, 7))], int(n)) for n in rng.integers(1, 13, 40)]
    for (r, n), got in zip(problems, ranking.gibbs_side_by_side(problems), strict=True):
        assert got.shape == (80, n) and np.array_equal(got, plain(r, n)) and np.array_equal(got, ranking.gibbs(r, n))


def test_posterior_of_odd_problems(spark, monkeypatch):
    monkeypatch.setattr(ranking, "STEP_PLACES", 8)
    rankings = spark.createDataFrame([(1, 9, ["b", "a"]), (1, 8, ["c", "b"]), (None, 1, ["a"]), (2, 1, ["a", "c"])], "problem int, ranking int, items array<string>")
    items = spark.createDataFrame([(1, "c"), (1, "a"), (1, "b"), (None, "a"), (2, "c"), (2, "a"), (3, "z")], "problem int, item string")
    got = {(r["problem"], r["draw"], r["item"]): r["score"] for r in ranking.posterior(rankings, items, 5).collect()}
    want = {}
    for p, r, names in [(1, [[2, 1], [1, 0]], "abc"), (None, [[0]], "a"), (2, [[0, 1]], "ac"), (3, [], "z")]:
        want |= {(p, d, x): s for d, row in enumerate(plain(r, len(names), 5)) for x, s in zip(names, row, strict=True)}
    assert got == want


def test_closest_of_copies_scaled_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(gather, "BLOCK_CENTRES", 16)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 7))
    v = [*v.tolist(), *(3.7 * v[:20]).tolist(), *v[:20].tolist(), [0.0] * 7, [1.0, 2.0], [float("nan")] * 7, [None] * 7, None, [1e200] * 7, [float("inf")] + [1.0] * 6]
    rows = spark.createDataFrame([(i % 60, x) for i, x in enumerate(v)], "id int, v array<double>")
    centres = spark.createDataFrame([(f"c{len(v) - i:03}", x) for i, x in enumerate(v)], "centre string, v array<double>")
    each = rows.withColumn("row", F.monotonically_increasing_id()).crossJoin(centres.withColumnRenamed("v", "w")).withColumn("distance", vector.cosine_distance(F.col("v"), F.col("w")))
    want = each.where("distance is not null").groupBy("row", "id").agg(F.min(F.struct("distance", "centre")).alias("b"))
    want = want.where("b.distance < 1.5").select("id", "b.centre", "b.distance")
    assert sorted(map(tuple, gather.closest(rows, centres, 1.5).collect())) == sorted(map(tuple, want.collect()))


def test_posterior_of_small_problems_looks_its_draws_up(monkeypatch):
    """Each problem had two calls of its own generator at every step, which took most of the time of many small ones."""
    rng = np.random.default_rng(6)
    problems = [([rng.permutation(12)[: rng.integers(1, 8)].tolist() for _ in range(rng.integers(1, 30))], 12) for _ in range(50)]
    want, made = [plain(r, n) for r, n in problems], []
    ranking.gibbs_side_by_side(problems)  # tables are made once
    generator = np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda *a: made.append(a) or generator(*a))
    got = ranking.gibbs_side_by_side(problems)
    assert not made and all(map(np.array_equal, got, want))
    monkeypatch.setattr(ranking, "STREAM_BITS", 0)
    assert all(map(np.array_equal, ranking.gibbs_side_by_side(problems), want)) and len(made) == 50


def test_draws_of_a_stream_that_must_be_read_further(monkeypatch):
    from types import SimpleNamespace

    from tessera.operators import draws

    short = draws.Stream(0).reach(1024, 8)
    monkeypatch.setattr(ranking, "stream", lambda seed: SimpleNamespace(reach=lambda size, run: short))
    problems = [([[0, 1, 2], [2, 0]], 3), ([[1, 0]], 2)]
    assert all(np.array_equal(x, plain(r, n)) for (r, n), x in zip(problems, ranking.gibbs_side_by_side(problems), strict=True))
    assert short.size > 1024


def test_posterior_takes_the_items_of_its_rankings(spark):
    rankings = spark.createDataFrame([(1, 9, ["b", "a"]), (1, 8, ["c", "b"]), (2, 1, ["a", "c"])], "problem int, ranking int, items array<string>")
    items = rankings.select("problem", F.explode("items").alias("item")).distinct()
    assert sorted(map(tuple, ranking.posterior(rankings, None, 5).collect())) == sorted(map(tuple, ranking.posterior(rankings, items, 5).collect()))
