import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays, text
from tessera.operators import cluster, gather, labels, ordering, ranking, shells
from tessera.session import cut_lineage, new_path, shared_folder


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_chunk_for_link_takes_the_first_ref(spark):
    links = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["z"]), (4, None)], "link int, refs array<string>")
    chunks = spark.createDataFrame([(10, "b", ["a"]), (11, "a", ["b", "b"]), (12, "a", ["b"]), (13, "c", ["x"])], "chunk_id int, ref string, cited array<string>")
    assert rows_of(gather.chunk_for_link(links, chunks)) == [(1, 11)]


def test_opposite_and_paired(spark):
    links = spark.createDataFrame([("a", "b"), ("c", "a"), (None, "a")], "a string, b string")
    assert rows_of(gather.opposite(links, spark.createDataFrame([("a",), ("a",)], "ref string"))) == [("a", "b"), ("a", "c"), ("a", None)]
    left, right = (spark.createDataFrame(x, "ref int, value int") for x in ([(1, 10), (2, 20)], [(2, 5), (3, 6)]))
    assert rows_of(gather.paired(left, right)) == [(1, 10, None), (2, 20, 5), (3, None, 6)]


def test_order_of_another_list(spark):
    rows = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3), ("y", 4)], "ref string, place bigint")
    order = spark.createDataFrame([("y", 0), ("x", 9000), ("y", 5)], "ref string, place bigint")
    got = gather.in_order_of(rows, order).orderBy("rank").collect()
    assert [(r["ref"], r["rank"]) for r in got] == [("y", 1), ("y", 2), ("x", 3), ("z", 4)]


def test_closest_needs_a_distance_below_one(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.1]), (2, [-1.0, 0.0]), (3, [0.0, 0.0])], "id bigint, v array<double>")
    centres = spark.createDataFrame([(7, [1.0, 0.0]), (8, [2.0, 0.0])], "centre bigint, v array<double>")
    assert [r[:2] for r in rows_of(gather.closest(rows, centres))] == [(1, 7)]
    assert gather.closest(rows, centres.limit(0)).count() == 0


def test_example_scores_without_labels(spark):
    make = lambda x: spark.createDataFrame(x, "ref int, slugs array<string>")
    got = rows_of(gather.example_scores(make([(1, ["a", "b"]), (2, [])]), make([(1, ["a", "c", "c"]), (2, [])]), make([(1, ["a", "c"]), (2, ["a"])])))
    assert got[0][:4] == (1, 1, 2, 1) and got[0][6] == pytest.approx(2 / 3) and got[1] == (2, 0, 0, 0, 0.0, 0.0, 0.0)


def test_range_recall_counts_ranges_once(spark):
    kind = "topic int, book string, start int, end int"
    want = spark.createDataFrame([(1, "g", 1, 5), (1, "g", 1, 5), (1, "g", 9, 9), (2, "g", 1, 1)], kind)
    found = spark.createDataFrame([(1, "g", 5, 8), (1, "h", 1, 1), (1, "g", 5, 8)], kind)
    assert rows_of(gather.range_recall(want, found)) == [(1, 2, 1, 0.5), (2, 1, 0, 0.0)]


def test_runs_and_context(spark):
    rows = spark.createDataFrame([(1, 0, "o", "a"), (1, 1, "o", "b"), (1, 2, "s", "c"), (1, 3, "s", "d"), (1, 4, "o", "e")], "k int, i int, kind string, t string")
    got = gather.joined_runs(rows, "k", "i", "kind", "t", "o").orderBy("run").collect()
    assert [(r["kind"], r["t"], r["n"]) for r in got] == [("o", "a\nb", 2), ("s", "c", 1), ("s", "d", 1), ("o", "e", 1)]
    assert [(r["i"], r["before"]) for r in gather.with_text_before(rows, "k", "i", "kind", "t", "o").orderBy("i").collect()] == [(2, "b"), (3, None)]


def test_first_candidate_then_best_hit(spark):
    hits = spark.createDataFrame([(1, "b", 2, 3, 0.5), (2, "b", 2, 2, 0.9), (3, "b", 50, 51, 0.1), (4, "c", 2, 2, 1.0)], "hit int, book string, start int, end int, score double")
    cands = spark.createDataFrame([(0, "b", 0, 5, 77), (1, "b", 0, 9, 78), (2, "b", 40, 60, 77)], "place int, book string, start int, end int, segment int")
    assert rows_of(gather.first_containing(hits, cands)) == [(77, 2, 0.9)]
    assert rows_of(gather.first_containing(hits, cands, "first")) == [(77, 1, 0.5)]


def test_hierarchies(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "b"), ("a", "a0")], "child string, parent string")
    rows = spark.createDataFrame([(1, "c"), (1, "c"), (2, "x")], "ref int, slug string")
    assert rows_of(labels.implied_parents(edges, rows)) == [(1, "a"), (1, "a0"), (1, "b"), (1, "c"), (2, "x")]
    assert rows_of(gather.descendants(edges, spark.createDataFrame([("b",), ("z",)], "slug string"))) == [("b", "b"), ("b", "c"), ("b", "d"), ("z", "z")]
    assert rows_of(gather.children_missing(edges, spark.createDataFrame([(1, "b"), (2, "b"), (2, "d"), (3, "c")], "ref int, slug string"))) == [(1, "b")]


def test_halving_judge():
    asked = []

    def judge(refs):
        asked.append(len(refs))
        if len(refs) > 4:
            raise ValueError
        return {r: 9 for r in refs if r != "r0"} | {"more": 1}

    assert shells.grade_by_halves([f"r{k}" for k in range(8)], judge) == {f"r{k}": 4 * (k > 0) for k in range(8)} and asked == [8, 4, 4]
    assert shells.grade_by_halves(["x"], lambda r: 1 / 0) == {"x": 0} and shells.grade_by_halves([], judge) == {}


def test_shell_rows(spark):
    rows = spark.createDataFrame([(1, "t", "one", "en"), (2, "t", None, "en")], "ref int, title string, text string, lang string")
    got = {r["ref"]: r["summary"] for r in shells.run(rows, "summary", shells.echo("summary")).collect()}
    assert got == {1: "ONE", 2: None}
    assert {r["ref"]: r["others"] for r in shells.with_others(rows, "title", "ref", "text").collect()} == {1: "", 2: "one"}
    with pytest.raises(ValueError):
        shells.prompt("nothing")
    assert shells.run_parallel(range(6), lambda x: x * x if x % 2 else None) == [1, 9, 25]
    calls = []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert shells.patient(flaky, (0.0, 0.0))("p") == "ok"
    with pytest.raises(ValueError):
        shells.EMBEDDERS.make("none")


def test_samples_and_ranks(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    got = {r["k"] for r in ordering.first_by_hash(rows, "k", 1234, 5).collect()}
    want = {r["k"] for r in rows.orderBy(ordering.hash_order(F.col("k"), 5), "k").limit(1234).collect()}
    assert got == want and ordering.first_by_hash(rows, "k", 9999, 5).count() == 5000
    n = ordering.numbered(rows.withColumn("g", F.col("k") % 3), "g", ["k"], "n").orderBy("n").collect()
    assert [r["n"] for r in n] == list(range(1, 5001)) and [r["g"] for r in n] == sorted(r["g"] for r in n)
    places = ranking.simulate(spark.createDataFrame([(1, i, 0.0 if i else 30.0) for i in range(9)], "problem int, item int, score double"), 1)
    assert places.where("item = 0").first()["place"] == 1


def test_text_values(spark):
    one = spark.createDataFrame([('{"a": "x "y" z", "b": "q"\n}', "Choice: 3", "choose 9", "the Quick brown fox", "see the quick brown dog")], "j string, c string, o string, a string, b string")
    r = one.select(text.escape_inner_quotes(F.col("j")).alias("j"), text.choice_number(F.col("c"), F.lit(5)).alias("c"), text.choice_number(F.col("o"), F.lit(5)).alias("o"), text.shared_phrase(F.col("a"), F.col("b")).alias("p")).first()
    assert r["j"] == '{"a": "x \\"y\\" z", "b": "q"\n}' and (r["c"], r["o"], r["p"]) == (3, None, "the quick brown")
    got = spark.createDataFrame([(["he", "en"],), (["fr"],)], "l array<string>").select(text.choose_langs(F.col("l")).alias("l")).collect()
    assert [x["l"] for x in got] == [["he"], []]
    with pytest.raises(ValueError):
        arrays.in_scope(one, "other")


def test_shared_folder(spark):
    assert shared_folder(spark) in new_path(spark, "x")
    df = cut_lineage(spark.range(5).where("id > 1"))
    assert df.count() == 3 and "Filter" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_more_centres_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(gather, "BLOCK_CENTRES", 3)
    at = lambda a: [math.cos(a), math.sin(a)]
    rows = spark.createDataFrame([(i % 30, at(i / 7)) for i in range(40)] + [(99, [0.0, 0.0])], "id int, v array<double>")
    centres = spark.createDataFrame([(k, at(k)) for k in range(6)] + [(6, at(0)), (7, [0.0, 0.0])], "centre int, v array<double>")
    got = sorted((r["id"], r["centre"]) for r in gather.closest(rows, centres, 1.5).collect())
    want = [(i % 30, min(range(6), key=lambda k: (round(1 - math.cos(i / 7 - k), 12), k))) for i in range(40)]
    assert got == sorted(want)
    pairs = cluster.distance_matrix(centres.where("centre < 6"), "centre", "v", block=2).collect()
    assert len(pairs) == 36 and all(abs(r["distance"] - (1 - math.cos(r["a"] - r["b"]))) < 1e-9 for r in pairs)


def test_places_over_all_rows(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.when(F.col("id") % 9 > 0, F.col("id") % 4).alias("g"))
    got = ordering.placed(rows, [F.desc("k")], "n").collect()
    assert sorted((r["n"], r["k"]) for r in got) == [(i + 1, 499 - i) for i in range(500)]
    n = ordering.numbered(rows, "g", ["k"], "n").orderBy("n").collect()
    assert [r["n"] for r in n] == list(range(1, 501)) and [(r["g"] is not None, r["g"] or 0, r["k"]) for r in n] == sorted((r["g"] is not None, r["g"] or 0, r["k"]) for r in n)
    ranks = {(r["g"], r["rank"]) for r in ranking.dense_ranks(rows, "g", "rank").collect()}
    assert ranks == {(3, 1), (2, 2), (1, 3), (0, 4), (None, 5)}
    assert ordering.placed(rows.limit(0), [F.col("k")], "n").count() == 0
    parts = labels.frequency_partitions(rows.select(F.col("k").cast("string").alias("slug"), F.lit(1).alias("count"))).collect()
    assert {r["part"] for r in parts} == set(range(22))
