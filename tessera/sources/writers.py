"""Sinks: JSON lines, CSV, upserts and run manifests, written by Spark to any store that it reaches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def csv_columns(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns in order; those that rows lack are empty."""
    have = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    rows.select(*have).write.mode("overwrite").option("header", True).csv(path)


def csv_union(parts: list[DataFrame], path: str) -> None:
    """Rows of several shapes under all their columns, sorted; nothing is written for no parts."""
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    if out is not None and not out.isEmpty():
        out.select(*sorted(out.columns)).write.mode("overwrite").option("header", True).csv(path)


def manifest(spark, path: str, values: dict) -> None:
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def append_run(rows: DataFrame, path: str, run_id: str) -> None:
    rows.withColumn("run_id", F.lit(run_id)).withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def dump(docs: DataFrame, queries: DataFrame, qrels: DataFrame, path: str, meta: dict) -> None:
    """A dataset as JSON lines with a manifest of its counts."""
    for name, df in (("documents", docs), ("queries", queries), ("qrels", qrels)):
        json_lines(df, f"{path}/{name}.jsonl")
    manifest(docs.sparkSession, f"{path}/metadata.json", meta | {"documents": docs.count(), "queries": queries.count(), "qrels": qrels.count()})


def html_table(rows: DataFrame, columns: list[str], group: str) -> DataFrame:
    """(group, html): a table of each group's rows, in the order of their first column."""
    cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), *[cell(c) for c in columns], F.lit("</tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(columns[0]).alias("k"), row.alias("r")))), lambda x: x["r"]), "")
    return rows.groupBy(group).agg(F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))


def option_columns(rows: DataFrame, options: str, n: int) -> DataFrame:
    """rows with 'Option 1' to 'Option n' in place of the array."""
    return rows.select("*", *[F.get(options, F.lit(i)).alias(f"Option {i + 1}") for i in range(n)]).drop(options)


def set_comparison(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, only_a, only_b, common): two arrays as sets, each part joined by |."""
    part = lambda c, name: F.array_join(c, "|").alias(name)
    return rows.select(key, part(F.array_except(a, b), "only_a"), part(F.array_except(b, a), "only_b"), part(F.array_intersect(a, b), "common"))
