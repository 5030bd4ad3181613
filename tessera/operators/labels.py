"""Multi-label tagging by neighbours' votes, and the evaluation of label sets (ref, slugs: array<string>)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import ordering


def votes(neighbours: DataFrame, weight: Column | None = None) -> DataFrame:
    """(ref, slug, vote): summed weights, or counts, of neighbours' labels; rows (ref, other, slugs[, weight]), a ref's own row does not vote."""
    rows = neighbours.where("ref <> other").withColumn("w", F.lit(1.0) if weight is None else weight)
    return rows.select("ref", F.explode("slugs").alias("slug"), "w").groupBy("ref", "slug").agg(F.sum("w").alias("vote"))


def above_mean(rows: DataFrame, group: list[str], value: str, factor: float) -> DataFrame:
    """Rows whose value is strictly above mean + factor x population deviation of their group."""
    w = Window.partitionBy(*group)
    edge = F.avg(value).over(w) + factor * F.stddev_pop(value).over(w)
    return rows.withColumn("__edge", edge).where(F.col(value) > F.col("__edge")).drop("__edge")


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("slugs").alias("slug")).groupBy("slug").count()


def frequency_partitions(counts: DataFrame, key: str = "slug") -> DataFrame:
    """Labels dealt round robin by falling count into floor(sqrt(n)) sets."""
    sets = max(1, math.isqrt(counts.count()))
    return ordering.placed(counts, [F.desc("count"), F.col(key)], "__place").select(key, "count", ((F.col("__place") - 1) % sets).alias("part"))


def closure(edges: DataFrame, depth: int = 32) -> DataFrame:
    """All (child, parent) pairs over one or more edges, a label hierarchy. Paths double each round, so rounds are few; each is written out, so none is computed twice."""
    reach = cut_lineage(edges.select("child", "parent").distinct(), "closure")
    n = reach.count()
    for _ in range(depth):
        more = reach.alias("x").join(reach.alias("y"), F.col("x.parent") == F.col("y.child")).select("x.child", "y.parent")
        reach = cut_lineage(reach.union(more).distinct(), "closure")
        before, n = n, reach.count()
        if n == before:
            break
    return reach


def implied_parents(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(ref, slug) with all ancestors added, over edges (child, parent): the small hierarchy is closed first, then rows meet it once."""
    own = rows.select("ref", "slug").distinct()
    return own.union(own.join(closure(edges).withColumnRenamed("child", "slug"), "slug").select("ref", "parent")).distinct()


def pairs(gold: DataFrame, predicted: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """(ref, gold, predicted) of refs on both sides, restricted to the allowed labels."""
    keep = (lambda c: F.filter(c, lambda x: x.isin(allowed))) if allowed is not None else (lambda c: F.col(c))
    g = gold.select("ref", keep("slugs").alias("gold"))
    return g.join(predicted.select("ref", keep("slugs").alias("predicted")), "ref")


def _without(a: str, b: str) -> Column:
    return F.size(F.filter(a, lambda x: ~F.array_contains(b, x)))


def confusion(both: DataFrame) -> DataFrame:
    """tp, fp, fn of each pair; repeated labels count as often as they stand there."""
    fp = _without("predicted", "gold")
    return both.select("*", (F.size("predicted") - fp).alias("tp"), fp.alias("fp"), _without("gold", "predicted").alias("fn"))


def micro(both: DataFrame, beta: float = 2.0) -> DataFrame:
    """One row: summed counts, precision, recall, F1, F-beta and the share of exact matches; empty ratios are 0."""
    c = confusion(both).agg(
        F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"), F.coalesce(F.sum("fn"), F.lit(0)).alias("fn"),
        F.coalesce(F.avg((F.array_sort(F.array_distinct("gold")) == F.array_sort(F.array_distinct("predicted"))).cast("double")), F.lit(0.0)).alias("exact"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f = lambda b: ratio((1 + b * b) * F.col("precision") * F.col("recall"), b * b * F.col("precision") + F.col("recall"))
    return c.withColumn("f1", f(1.0)).withColumn("fbeta", f(beta))


def label_stats(both: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """(slug, tp, fp, fn) of every label, zeros for labels of the universe that no pair has."""
    g = both.select("ref", F.explode(F.array_distinct("gold")).alias("slug")).withColumn("g", F.lit(1))
    p = both.select("ref", F.explode(F.array_distinct("predicted")).alias("slug")).withColumn("p", F.lit(1))
    one = g.join(p, ["ref", "slug"], "full").select("slug", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    out = one.groupBy("slug").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))
    if universe is None:
        return out
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]
    return universe.select("slug").distinct().join(out, "slug", "full").select("slug", *zero)


def label_refs(rows: DataFrame, key: str = "ref") -> DataFrame:
    """(slug, n, refs): how many refs have each label, and which, sorted."""
    return rows.select(key, F.explode("slugs").alias("slug")).groupBy("slug").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("refs"))


def complete_mean(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, mean, n) of the groups none of whose rows lacks the value."""
    g = rows.groupBy(group).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.count(value).alias("__have"))
    return g.where("n = __have").drop("__have")


def keep_shared(rows: DataFrame, other: DataFrame, key: str = "ref") -> DataFrame:
    """Rows whose ref the other side has too."""
    return rows.join(other.select(key).distinct(), key, "left_semi")
