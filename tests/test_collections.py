"""Replacing and upserting tables bucket by bucket."""

import pytest
from pyspark.sql import functions as F

from tessera.session import new_path
from tessera.sources.collections import Collection, Conflict


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_writes_touched_buckets_only(spark):
    held = Collection(spark, new_path(spark, "held"), ["a", "b"], 16)
    base = spark.range(200).select((F.col("id") % 50).cast("int").alias("a"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("b"), F.col("id").alias("v"))
    assert held.version() == 0 and held.upsert(base) == 1
    first = held._manifest(1)
    change = base.where("v in (3, 7, 14)").withColumn("v", -F.col("v"))  # null keys are equal
    gone = {(r["a"], r["b"]) for r in change.collect()}
    assert held.upsert(change) == 2
    want = [r for r in rows_of(base) if (r[0], r[1]) not in gone] + rows_of(change)
    assert rows_of(held.read()) == sorted(want, key=repr)
    second = held._manifest(2)
    assert 0 < sum(v == 2 for v in second["of"].values()) <= 3 and set(second["of"]) == set(first["of"])
    assert rows_of(held.read(1)) == rows_of(base)
    held.delete(change)
    assert rows_of(held.read()) == sorted((r for r in rows_of(base) if (r[0], r[1]) not in gone), key=repr)
    held.tidy()
    assert rows_of(held.read()) == sorted((r for r in rows_of(base) if (r[0], r[1]) not in gone), key=repr)
    assert held.upsert(base.limit(0)) == 4 and held.read().count() == len(want) - len(gone)
    held.replace(base.where("v < 5"))
    assert held.read().count() == 5


def test_a_failed_run_leaves_the_old_table(spark):
    held = Collection(spark, new_path(spark, "held"), ["id"], 4)
    held.replace(spark.range(20).withColumn("v", F.lit(1)))
    bad = spark.range(10).withColumn("v", F.when(F.col("id") == 9, F.raise_error(F.lit("broken")).cast("int")).otherwise(2))
    for f in (held.upsert, held.replace):
        with pytest.raises(Exception, match="broken"):
            f(bad)
    assert held.version() == 1 and rows_of(held.read()) == [(i, 1) for i in sorted(range(20), key=lambda i: repr((i, 1)))]
    held.upsert(bad.where("id < 5").select("id", F.lit(3).alias("v")))
    assert held.read().where("v = 3").count() == 5 and held.read().count() == 20


def test_two_writers_of_one_version_conflict(spark):
    path = new_path(spark, "held")
    one, two = Collection(spark, path, ["id"], 2), Collection(spark, path, ["id"], 2)
    one.replace(spark.range(3))
    two.version = lambda: 0
    with pytest.raises(Conflict):
        two.replace(spark.range(5))
    with pytest.raises(FileNotFoundError):
        Collection(spark, new_path(spark, "none"), ["id"]).read()
