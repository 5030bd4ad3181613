"""The table function over tables of its own partitions and order."""

import pytest

from tessera.functions import registered


def test_groups_by_section(spark):
    registered.register(spark)
    rows = [(1, 2, 4), (1, 0, 5), (1, 1, 5), (1, 3, None), (2, 0, 99), (2, 1, 1), (None, 7, 3), (None, 8, 8)]
    spark.createDataFrame(rows, "section int, place int, size int").repartition(3).createOrReplaceTempView("packed_rows")
    got = sorted(map(tuple, spark.sql("SELECT * FROM packed(TABLE(packed_rows), 10)").collect()), key=repr)
    want = [(1, 1, 0, 1, 2, 10), (1, 2, 2, 3, 2, 4), (2, 1, 0, 0, 1, 99), (2, 2, 1, 1, 1, 1), (None, 1, 7, 7, 1, 3), (None, 2, 8, 8, 1, 8)]
    assert got == sorted(want, key=repr)
    spark.sql("SELECT * FROM packed_rows WHERE false").createOrReplaceTempView("packed_none")
    assert spark.sql("SELECT * FROM packed(TABLE(packed_none), 10)").count() == 0


@pytest.mark.parametrize("call", ["packed(TABLE(packed_bad), 10)", "packed(TABLE(packed_rows), 0)", "packed(3, 10)"])
def test_wrong_arguments_are_told_at_once(spark, call):
    registered.register(spark)
    spark.range(3).createOrReplaceTempView("packed_bad")
    spark.createDataFrame([(1, 1, 1)], "section int, place int, size int").createOrReplaceTempView("packed_rows")
    with pytest.raises(Exception, match="packed"):
        spark.sql(f"SELECT * FROM {call}").collect()
