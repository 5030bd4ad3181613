"""Removal of repeated strings where one text makes up most of the table."""

from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import common, repeats

#: Small enough that a share of a test's rows is skewed, and no side of a join is sent whole.
CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "16k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


def test_reads_of_a_hot_anchor_are_dealt_over_tasks(spark):
    """A task of the join by anchor writes a file; the reads of 4,000 equal texts must not all be in one."""
    same = " ".join(f"word{k * k % 997}" for k in range(60))[:401]
    own = [" ".join(f"{i}x{k * k % 89}" for k in range(120)) for i in range(40)]
    rows = [(str(i), same) for i in range(4000)] + [(str(4000 + i), t) for i, t in enumerate(own)] + [(str(5000 + i), t[100:]) for i, t in enumerate(own)]
    files: dict[str, list[int]] = {}

    class Watched(common.Scratch):
        def stage(self, df, name, wide=False):
            out = super().stage(df, name, wide)
            if name == "repeats-again":
                files[name] = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
            return out

    was = {k: spark.conf.get(k, None) for k in CONF}
    try:
        for k, v in CONF.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame(rows, "id string, text string").repartition(16)
        found = {bytes(r["key"]): [tuple(s) for s in r["spans"]] for r in repeats.spans(docs, scratch=Watched()).collect()}
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    covered = Counter()
    for _, t in rows[3999:]:
        covered[t] = sum(max(0, e - max(s, at)) for s, e, at in _from_the_left(found[repeats.text_key(t.encode())]))
    assert covered[same] == 401 and all(covered[t] == covered[t[100:]] == len(t) - 100 for t in own)
    (counts,) = files.values()
    assert sum(counts) >= 4000 and max(counts) < 1500


def _from_the_left(spans):
    at = 0
    for s, e in spans:
        yield s, e, at
        at = max(at, e)
