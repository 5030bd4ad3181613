"""The relational shells around model calls: the call itself is a function that is passed in (a deterministic stub in
tests), rows go to it in Arrow batches, failures become a column, and answers are kept in a cache table."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETRIES = 5
_LIMIT = re.compile("429|rate.?limit|quota|resource.?exhausted|too many requests|5\\d\\d", re.I)


def with_retry(call: Callable[[str], str], tries: int = RETRIES, wait: float = 0.5) -> Callable[[str], str]:
    """call with exponential waits after failures that say "too many" or "server"; others are raised at once."""

    def run(prompt: str) -> str:
        for k in range(tries):
            try:
                return call(prompt)
            except Exception as e:
                if k == tries - 1 or not _LIMIT.search(str(e)):
                    raise
                time.sleep(wait * 2**k)
        raise AssertionError

    return run


def ask(rows: DataFrame, prompt: str, call: Callable[[str], str], answer: str = "answer") -> DataFrame:
    """rows with the answer to each prompt and an error column; a failed call has a null answer."""
    names = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got, bad = [], []
            for p in df[prompt]:
                try:
                    got.append(call(p))
                    bad.append(None)
                except Exception as e:  # the row keeps what went wrong
                    got.append(None)
                    bad.append(str(e))
            yield df.assign(**{answer: got, "error": bad})[[*names, answer, "error"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, `{answer}` string, error string")


def cached_ask(rows: DataFrame, prompt: str, call: Callable[[str], str], cache_path: str, model: str = "stub") -> DataFrame:
    """ask() that computes each distinct prompt once and appends it to the cache table at cache_path."""
    spark = rows.sparkSession
    key = F.sha2(F.concat_ws("|", F.lit(model), F.col(prompt)), 256)
    keyed = rows.withColumn("__key", key)
    schema = "__key string, answer string"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)
    cache = spark.read.schema(schema).parquet(cache_path) if there else spark.createDataFrame([], schema)
    miss = keyed.select("__key", prompt).dropDuplicates(["__key"]).join(cache, "__key", "left_anti")
    ask(miss, prompt, call).where("error is null").select("__key", "answer").write.mode("append").parquet(cache_path)
    return keyed.join(spark.read.schema(schema).parquet(cache_path), "__key", "left").drop("__key")


def keep_if(rows: DataFrame, prompt: str, call: Callable[[str], str], yes: str = "Yes") -> DataFrame:
    """Rows whose answer is exactly yes; anything else, failures too, is a no."""
    return ask(rows, prompt, call).where(F.col("answer") == yes).drop("answer", "error")


def split_by(rows: DataFrame, prompt: str, call: Callable[[str], str], yes: str = "Yes") -> tuple[DataFrame, DataFrame]:
    """The rows with a yes and the others."""
    said = ask(rows, prompt, call).withColumn("__yes", F.coalesce(F.col("answer") == yes, F.lit(False))).drop("answer", "error")
    return said.where("__yes").drop("__yes"), said.where("not __yes").drop("__yes")


def two_pass(rows: DataFrame, slugs: str, over_general: list[str], confirm: Callable[[str], str], key: str = "ref", text: str = "text") -> DataFrame:
    """(key, slugs): picked labels, of which over-general ones need an exact 'true' as a second answer; order stays."""
    each = rows.select(key, text, F.posexplode(slugs).alias("i", "slug")).withColumn("prompt", F.concat_ws("\n", "slug", text))
    doubt = F.col("slug").isin(over_general)
    sure = ask(each.where(doubt), "prompt", confirm).where("answer = 'true'").select(key, "i", "slug")
    kept = each.where(~doubt).select(key, "i", "slug").union(sure)
    picked = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "slug"))), lambda x: x["slug"]).alias("slugs"))
    return rows.select(key).join(picked, key, "left").select(key, F.coalesce("slugs", F.array().cast("array<string>")).alias("slugs"))


def generate_queries(docs: DataFrame, types: list[str], call: Callable[[str], str], per_pair: int = 3) -> tuple[DataFrame, DataFrame]:
    """(queries, qrels): for every document and type, up to per_pair non-blank lines of the answer, and a judgement of 1 for their document."""
    jobs = docs.select("doc_id", "text", F.explode(F.array(*map(F.lit, types))).alias("type")).withColumn("prompt", F.concat_ws("\n", "type", "text"))
    lines = F.filter(F.transform(F.split("answer", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    one = ask(jobs, "prompt", call).select("doc_id", "type", F.posexplode(F.slice(lines, 1, per_pair)).alias("i", "text"))
    one = one.withColumn("query_id", F.concat_ws("__", F.col("doc_id").cast("string"), "type", F.col("i").cast("string")))
    return one.select("query_id", "text", "type"), one.select("query_id", "doc_id", F.lit(1).alias("relevance"))


def fill_scores(expected: DataFrame, scored: DataFrame, most_missing: int = 4) -> DataFrame:
    """(doc, ref, score) for every expected (doc, ref): up to most_missing missing scores of a document are 0, more give null for
    the document; unknown refs go."""
    both = expected.join(scored, ["doc", "ref"], "left")
    n = F.sum(F.col("score").isNull().cast("int")).over(_by("doc"))
    return both.withColumn("__n", n).select("doc", "ref", F.when(F.col("__n") <= most_missing, F.coalesce("score", F.lit(0))).alias("score"))


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


def stub(prompt: str) -> str:
    """A deterministic answer: Yes or No by the prompt's hash."""
    return "Yes" if hashlib.sha256(prompt.encode()).digest()[0] % 2 else "No"
