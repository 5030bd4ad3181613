import pytest
from pyspark.sql import functions as F

from tessera.sources import readers, writers
from tessera.streaming import events


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\nbroken\n')
    assert readers.json_lines(spark, f"file://{p}", "a int", bad="DROPMALFORMED").where("a is not null").count() == 2
    assert readers.json_lines(spark, f"file://{tmp_path}/none.jsonl", "a int").count() == 0


def test_first_column(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,1\nb,2\n")
    (tmp_path / "x.jsonl").write_text('{"k": ["c", "d"]}\n')
    assert [r[0] for r in readers.first_column(spark, f"file://{tmp_path}/x.csv").collect()] == ["a", "b"]
    assert [r[0] for r in readers.first_column(spark, f"file://{tmp_path}/x.jsonl").collect()] == ["c", "d"]
    with pytest.raises(ValueError):
        readers.first_column(spark, "x.txt")


def test_upsert_and_csv(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert {tuple(r) for r in writers.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c")}
    writers.csv_columns(old, f"file://{tmp_path}/o", ["v", "gone", "k"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/o").columns == ["v", "gone", "k"]


def test_stream_counts_as_batch_does(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(f"file://{tmp_path}/in")
    live = events.windowed_counts(events.read_events(spark, f"file://{tmp_path}/in", src.schema))
    q = live.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.windowed_counts(src).agg(F.sum("n"), F.count("*")).first()
    assert spark.table("counts").agg(F.sum("n"), F.count("*")).first() == want
