"""Extra columns with clashing names, and packing against plain best fit."""

import random

import pytest

from tessera.llm import exact_dedup, packing, simhash


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, simhash.near_dedup])
def test_clashing_columns_stay_as_they_are(spark, f):
    names = ["own", "doc", "sha", "norm", "last", "__own", "__id", "__sha", "Id", "kept", "digest", "cid", "salt", "_OWN"]
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(1, words), (2, words), (3, "other text"), (3, "other text"), (None, None)]
    df = spark.createDataFrame([(i, t, *[f"{k}:{n}" for n in names]) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = f(df)
    assert got.columns == df.columns
    found = got.collect()
    assert sorted(r["doc_id"] or 0 for r in found) == [0, 2 if f is exact_dedup.exact_dedup else 1, 3]
    assert all(tuple(r)[2:] == tuple(f"{tuple(r)[2][0]}:{n}" for n in names) for r in found)
    assert f(df.limit(0)).count() == 0


def _evolved(lengths):
    elites, bred = [None, None], 0
    for epoch in range(packing.EPOCHS):
        found = [packing.evolve(lengths, 1024, [e for e in (elites[k], elites[1 - k]) if e], 7 * epoch + k) for k in (0, 1)]
        elites, bred = [a for a, _ in found], bred + sum(n for _, n in found)
    for a in elites:
        fill = [0] * (max(a) + 1)
        for n, k in zip(lengths, a, strict=True):
            fill[k] += n
        assert 0 < min(fill) and max(fill) <= 1024
    return min(max(a) + 1 for a in elites), bred


def test_the_search_beats_best_fit():
    rng = random.Random(0)
    thirds = []
    for _ in range(1365):
        a = rng.randint(250, 450)
        b = rng.randint(250, 774 - a)
        thirds += [a, b, 1024 - a - b]
    cases = [([rng.randint(250, 400) for _ in range(4096)], 12), (thirds, 8), ([rng.randint(200, 700) for _ in range(4096)], 3), ([min(1024, int(rng.lognormvariate(5.2, 0.8)) + 1) for _ in range(4096)], 0)]
    for lengths, gain in cases:
        plain = len(packing.fit_all(sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)), lengths, 1024).items)
        bins, bred = _evolved(lengths)
        assert bins <= plain - gain and bred >= 2 * packing.EPOCHS
