import os

import duckdb
import pytest

import __spark_entry__ as e
from tessera.plans import catalog

DATA = "/root/testdata/sf0.001"
NEW = ("values", "files", "shelled", "gathering", "curation")
SOME = ["vec_rank_cosine", "eval_breakdowns", "eval_summary", "top10_lists", "first_relevant_rank", "micro_prf", "label_confusion", "confounder_band", "gap_islands", "nested_dedupe", "pagerank", "ngram_counts_2", "seeded_sample", "balanced_concat", "hierarchy_closure", "pairwise_mi"]
SOME += ["chunk_coverage", "knn_tags", "pareto_front", "best_parameters", "containment", "free_of_overlap", "query_metrics"]
SOME += [n for n, f in catalog.queries().items() if f.__module__.rsplit(".", 1)[1] in NEW and n in catalog.oracle_sql()]


def _same(x, y):
    if isinstance(x, float) and y is not None:
        return x == pytest.approx(float(y), abs=1e-5)
    return x == y


@pytest.mark.parametrize("name", SOME)
def test_query_gives_what_its_sql_gives(spark, name):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    want = con.execute(catalog.oracle_sql()[name])
    names = sorted(c[0] for c in want.description)
    got = catalog.queries()[name](spark, DATA)
    assert sorted(got.columns) == names
    order = [[c[0] for c in want.description].index(n) for n in names]
    a = sorted((tuple(r) for r in got.select(names).collect()), key=repr)
    b = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    assert len(a) == len(b) and all(_same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
