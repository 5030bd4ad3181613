"""Sources: JSON lines, CSV, globbed files, remote exports, and composite datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def json_lines(spark: SparkSession, path: str, schema: str, missing_ok: bool = True, bad: str = "FAILFAST") -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped. bad: FAILFAST, DROPMALFORMED or PERMISSIVE."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", bad).json(path)


def csv_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quotes doubled within fields, fields over several lines."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def first_column(spark: SparkSession, path: str) -> DataFrame:
    """(value): the first column of a CSV without header, or the first array of JSON (lines)."""
    suffix = path.rsplit(".", 1)[-1]
    if suffix == "csv":
        return spark.read.csv(path).select(F.col("_c0").alias("value"))
    if suffix not in ("json", "jsonl"):
        raise ValueError(f"unknown format: {path}")
    df = spark.read.option("multiLine", suffix == "json").json(path)
    arrays = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    if not arrays:
        raise ValueError(f"no array in {path}")
    return df.select(F.explode(arrays[0]).alias("value"))


def uncurated(rows: DataFrame, column: str = "curated") -> DataFrame:
    return rows.where(F.trim(F.coalesce(column, F.lit(""))) == "")


def grouped(rows: DataFrame, key: str, value: str, split: str | None = None) -> DataFrame:
    """(key, values): all values of a key in order; with split, each value is a list and null where empty."""
    v = F.nullif(F.col(value), F.lit("")) if split is None else F.when(F.trim(value) != "", F.split(value, split))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(v)).alias("values"))


def with_file_key(spark: SparkSession, glob: str, pattern: str, schema: str) -> DataFrame:
    """JSON lines of all files of a glob, with key: what pattern's group 1 finds in the file's name."""
    return spark.read.schema(schema).json(glob).withColumn("key", F.regexp_extract(F.input_file_name(), pattern, 1))


def segments(rows: DataFrame, parts: str, key: str) -> DataFrame:
    """(key, index, text): parts counted from 1 before blank ones go, so numbers keep their gaps."""
    return rows.select(key, F.posexplode(parts).alias("i", "text")).where(F.trim("text") != "").select(key, (F.col("i") + 1).alias("index"), "text")


def with_element(rows: DataFrame, spans: str, condition) -> DataFrame:
    """Rows with a span that fulfils a condition."""
    return rows.where(F.exists(spans, condition))


def dataset(docs: DataFrame, confounders: DataFrame | None, queries: DataFrame, qrels: DataFrame) -> dict[str, DataFrame]:
    """Documents with confounders below, and the judged queries."""
    if confounders is not None:
        docs = docs.withColumn("is_confounder", F.lit(False)).unionByName(confounders.withColumn("is_confounder", F.lit(True)), allowMissingColumns=True)
    return {"docs": docs, "queries": queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi"), "qrels": qrels}


def link_texts(html: str) -> Column:
    """Texts of the links in a page."""
    return F.transform(F.regexp_extract_all(F.col(html), F.lit("(?s)<a\\s[^>]*>(.*?)</a>"), 1), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, condition: Column | None = None) -> DataFrame:
    """A landed collection as Parquet; condition and columns are pushed down to the files."""
    rows = spark.read.parquet(path)
    rows = rows if condition is None else rows.where(condition)
    return rows if columns is None else rows.select(*columns)


def service_links(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, a, b): the links of landed JSON answers (lists of {"refs": [a, b]}); answers that are no list give none."""
    listed = F.from_json(F.when(F.trim(body).startswith("["), F.col(body)), "array<struct<refs:array<string>>>")
    links = rows.select(key, F.explode(listed).alias("x")).where(F.size("x.refs") == 2)
    return links.select(key, F.col("x.refs")[0].alias("a"), F.col("x.refs")[1].alias("b"))


def paragraphs(html: str) -> Column:
    """The texts of a page's paragraphs, markup off, white space made one."""
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), "[ \\t\\n\\r\\f\\x0B]+", " "))
    return F.trim(F.array_join(F.transform(F.regexp_extract_all(F.col(html), F.lit("(?s)<p>(.*?)</p>"), 1), clean), " "))


def first_in_language(rows: DataFrame, langs: list[str]) -> DataFrame:
    """(ref, text): each reference's first text (by order_id) in the first of the languages that it has."""
    place = F.array_position(F.array(*map(F.lit, langs)), F.col("lang"))
    return rows.where(F.col("lang").isin(langs)).groupBy("ref").agg(F.min_by("text", F.struct(place.alias("p"), "order_id")).alias("text"))
