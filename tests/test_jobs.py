"""The batch entry point: a query's rows written as Parquet, a second run in their place, and names that are not known."""

from tessera import jobs
from tessera.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_job_writes_what_the_query_gives(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    for name in ("category_counts", "corpus_size"):
        assert jobs.main([name, DATA, out]) == 0
        want = catalog.queries()[name](spark, DATA)
        got = spark.read.parquet(out)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_job_of_an_unknown_name_says_which_there_are(capsys):
    assert jobs.main(["no_such_query", DATA, "x"]) == 2 == jobs.main([])
    assert "category_counts" in capsys.readouterr().err
