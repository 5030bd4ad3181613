"""Interval operators against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import intervals


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)

    def draw(n, first):
        out = []
        for i in range(n):
            s = rng.choice([rng.randint(-300, 5000), rng.choice([1023, 1024, 2048])])
            length = rng.choice([0, 1, 3, 31, 32, 33, 100, 4000, 100_000])
            out.append((first + i, rng.randint(0, 2), s, s + rng.randint(0, length)))
        return out + [(first + n + k, 1, 64, 127) for k in range(5)] + [(first + n + 9, 1, 9, 3)]

    a, b = draw(150, 0), draw(130, 1000)
    frame = lambda rows: spark.createDataFrame(rows, "ref int, book int, start bigint, end bigint")
    return a, b, frame(a), frame(b)


def _pairs(a, b):
    return [(x, y) for x in a for y in b if x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]]


def test_joins_equal_all_pairs(tables):
    a, b, left, right = tables
    got = [(r["a_ref"], r["b_ref"]) for r in intervals.overlap_join(left, right).select("a_ref", "b_ref").collect()]
    want = [(x[0], y[0]) for x, y in _pairs(a, b)]
    assert sorted(got) == sorted(want)
    got = [(r["a_ref"], r["b_ref"]) for r in intervals.containment_join(left, right).select("a_ref", "b_ref").collect()]
    assert sorted(got) == sorted((x[0], y[0]) for x, y in _pairs(a, b) if x[2] <= y[2] and y[3] <= x[3])
    got = sorted(r["ref"] for r in intervals.without_overlap(left, right.where("ref % 7 = 0")).collect())
    hit = {x[0] for x, _ in _pairs(a, [y for y in b if y[0] % 7 == 0])}
    assert got == sorted(x[0] for x in a if x[0] not in hit)


def test_nested_ones_equal_all_pairs(tables, monkeypatch):
    a, _, left, _ = tables
    rows = [x for x in a if x[2] <= x[3]]
    holds = lambda x, y: x[1] == y[1] and x[2] <= y[2] and y[3] <= x[3]
    gone = {x[0] for x in rows for y in rows if x[0] != y[0] and holds(x, y) and (y[3] - y[2] < x[3] - x[2] or y[0] < x[0])}
    for stretch in (1024, 16):
        monkeypatch.setattr(intervals, "STRETCH", stretch)
        got = sorted(r["ref"] for r in intervals.drop_containing(left.where("end >= start")).collect())
        assert got == sorted(x[0] for x in rows if x[0] not in gone)


def test_long_intervals_stand_in_few_bins(spark):
    rows = spark.range(20).select(F.col("id").alias("ref"), F.lit(1).alias("book"), F.col("id").alias("start"), (F.col("id") + (1 << 40)).alias("end"))
    short = spark.range(5).select((F.col("id") + 100).alias("ref"), F.lit(1).alias("book"), (F.col("id") * (1 << 37)).alias("start"), (F.col("id") * (1 << 37)).alias("end"))
    for a, b in intervals._meetings(rows, short):
        assert a.count() <= 2 * 20 and b.count() <= 2 * 2 * 5
    assert intervals.overlap_join(rows, short).count() == 20 * 5 - 19
    assert intervals.overlap_join(rows.limit(0), short).count() == intervals.drop_containing(rows.limit(0)).count() == 0
