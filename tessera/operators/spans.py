"""Operators over span arrays: structs of start, end and further fields within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering


def regex_spans(text: Column, pattern: str) -> Column:
    """(start, end, text) of every match that starts where a regular expression finds it, in order, found by walking from match to match."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)

    def step(acc: Column, hit: Column) -> Column:
        at = F.locate_from(text, hit, acc["at"]) if hasattr(F, "locate_from") else F.call_function("locate", hit, text, acc["at"])
        span = F.struct((at - 1).alias("start"), (at - 1 + F.length(hit)).alias("end"), hit.alias("text"))
        return F.struct(F.concat(acc["out"], F.array(span)).alias("out"), (at + F.length(hit)).alias("at"))

    zero = F.struct(F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(hits, zero, step)["out"]


def group_by_range(rows: DataFrame, doc: str = "doc_id", spans: str = "spans") -> DataFrame:
    """(doc, start, end, refs, resolved): ambiguous citations that share a character range; spans without range go."""
    s = rows.select(doc, F.posexplode(spans).alias("i", "s")).where("s.ambiguous and s.type = 'citation' and s.start is not null and s.end is not null")
    refs = F.transform(F.array_sort(F.collect_list(F.struct("i", "s.ref"))), lambda x: x["ref"])
    return s.groupBy(doc, "s.start", "s.end").agg(refs.alias("refs")).withColumn("resolved", F.size("refs") == 1)


def dedupe_candidates(rows: DataFrame, ref: str = "ref", score: str = "score", place: str = "place") -> DataFrame:
    return ordering.best_by_score(rows, ref, score, place)


def diff_accuracy(old: DataFrame, new: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """One row: spans common to both sides of equal keys, spans of the old side, and their ratio (0 for none)."""
    both = old.select(*keys, F.col(spans).alias("__a")).join(new.select(*keys, F.col(spans).alias("__b")), keys, "left")
    common = F.size(F.array_intersect("__a", F.coalesce("__b", F.array().cast(old.schema[spans].dataType))))
    sums = both.agg(F.coalesce(F.sum(common), F.lit(0)).alias("common"), F.coalesce(F.sum(F.size("__a")), F.lit(0)).alias("total"))
    return sums.withColumn("accuracy", F.coalesce(F.try_divide("common", "total"), F.lit(0.0)))


def relabel(spans: Column, old: str, new: str) -> Column:
    """spans whose label is old get the label new."""
    return F.transform(spans, lambda s: F.when(s["label"] == old, s.withField("label", F.lit(new))).otherwise(s))


def sub_spans_distinct(rows: DataFrame, spans: str, condition) -> DataFrame:
    """Distinct texts of the spans that fulfil a condition."""
    return rows.select(F.explode(F.filter(spans, condition)).alias("s")).select("s.text").distinct()


def entity_spans(spans: Column) -> Column:
    """A model's spans (start, end, label) with labels capitalised."""
    return F.transform(spans, lambda s: s.withField("label", F.initcap(s["label"])))
