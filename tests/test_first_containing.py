"""Hits and candidates of equal ranges are met once."""

from tessera.operators import gather, intervals


def test_equal_ranges_are_met_once(spark, monkeypatch):
    met, join = [], intervals.containment_join
    monkeypatch.setattr(intervals, "containment_join", lambda outer, inner: met.append((outer.count(), inner.count())) or join(outer, inner))
    hits = spark.range(3000).selectExpr("id as hit", "'b' as book", "id % 3 * 10 as start", "id % 3 * 10 + 1 as end", "cast(id % 7 as double) as score")
    cands = spark.range(3000).selectExpr("2999 - id as place", "'b' as book", "0L as start", "id % 2 * 20 + 5 as end", "id % 5 as segment")
    got = {k: [tuple(r) for r in gather.first_containing(hits, cands, k).collect()] for k in ("best", "first")}
    assert met == [(2, 3)] * 2
    # place 0 (segment 4) ends at 25 and holds all of them
    assert got == {"best": [(4, 6, 6.0)], "first": [(4, 0, 0.0)]}


def test_a_hit_with_several_ranges_takes_the_first_candidate_of_all(spark):
    hits = spark.createDataFrame([(1, "b", 0, 1, 0.5), (1, "b", 30, 31, 0.25), (2, "b", 90, 91, 1.0)], "hit int, book string, start int, end int, score double")
    cands = spark.createDataFrame([(5, "b", 0, 5, 50), (3, "b", 30, 35, 51)], "place int, book string, start int, end int, segment int")
    assert [tuple(r) for r in gather.first_containing(hits, cands).collect()] == [(51, 1, 0.25)]
