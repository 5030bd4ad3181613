"""Queries without an SQL form: clustering, sampling of posteriors, chunking, model shells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import additive, chunking, cluster, generation, ranking, select
from .catalog import query, table
from .relational import _rankings


def _topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics of about 100 vectors, 25 at least."""
    e = table(spark, d, "embeddings")
    topics = max(25, e.count() // 100)
    return e.select((F.col("vec_id") % topics).alias("topic"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


for _m in ("agglomerative", "affinity", "density", "density_leaf", "best"):

    @query(name=f"cluster_{_m}")
    def _cluster(spark: SparkSession, d: str, method: str = _m) -> DataFrame:
        return cluster.cluster_groups(_topics(spark, d), method, named=True, whole=True)


@query()
def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    return cluster.members(cluster.cluster_groups(_topics(spark, d), "agglomerative", whole=True))


@query()
def source_selection(spark: SparkSession, d: str) -> DataFrame:
    """A choice of sources for every topic; topics are solved side by side."""
    import pandas as pd

    rows = cluster.cluster_groups(_topics(spark, d), "agglomerative", whole=True).where("cluster >= 0")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id")
        n = len(df)
        own = [select.Source(str(i), int(c), float(n - k), (f"c{i % 4}",), f"b{i % 7}") for k, (i, c) in enumerate(zip(df["id"], df["cluster"], strict=True))]
        return pd.DataFrame([(df["topic"].iloc[0], int(s.ref), s.cluster) for s in select.solve(own)], columns=["topic", "id", "cluster"])

    return rows.groupBy("topic").applyInPandas(run, "topic bigint, id bigint, cluster int")


@query()
def pl_posterior(spark: SparkSession, d: str) -> DataFrame:
    return ranking.summary(ranking.posterior(_rankings(spark, d), None))


@query()
def additive_effects(spark: SparkSession, d: str) -> DataFrame:
    """Effects of status and priority on an order's price in a hierarchical model, with intervals and the chains' diagnostics."""
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), (F.col("o_totalprice") / 100_000).cast("double").alias("price"))
    return additive.summary(additive.sample(rows, ["status", "priority"], "price", additive.Priors(0.5, 1.0, 1.0), draws=500, tune=300))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("section"), F.col("turn").alias("place"), "text")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(_sections(spark, d), settings=chunking.Settings(least=40, most=120))


@query()
def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d)


@query()
def chunk_manifest(spark: SparkSession, d: str) -> DataFrame:
    return chunking.manifest(_chunks(spark, d))


@query(r"""WITH t AS (SELECT conv_id AS section, turn, regexp_replace(nfc_normalize(coalesce(text, '')), '\s+', '', 'g') AS t FROM conversations)
SELECT section, CAST(sum(length(t)) AS BIGINT) AS letters, md5(string_agg(t, '' ORDER BY turn)) AS text, true AS ordered, true AS fits FROM t WHERE t <> '' GROUP BY section""")
def chunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A section's chunks hold all of its letters in order, follow each other, and none is too long."""
    chunks = _chunks(spark, d)
    parts = F.array_sort(F.collect_list(F.struct("chunk", F.regexp_replace("text", r"\s+", "").alias("t"), "first", "last")))
    own = chunks.groupBy("section").agg(parts.alias("p"), F.max("tokens").alias("most"))
    follow = F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: (i == 1) | (F.get("p", i - 1)["first"] >= F.get("p", i - 2)["last"]))
    joined = F.array_join(F.col("p.t"), "")
    return own.select("section", F.length(joined).cast("bigint").alias("letters"), F.md5(joined).alias("text"), follow.alias("ordered"), (F.col("most") <= 120).alias("fits"))


@query("SELECT doc_id FROM documents WHERE CAST('0x' || substr(sha256(text), 1, 2) AS INT) % 2 = 1")
def keep_if_yes(spark: SparkSession, d: str) -> DataFrame:
    return generation.keep_if(table(spark, d, "documents").select("doc_id", "text"), "text", generation.stub).select("doc_id")


@query("""WITH t AS (SELECT item_id, t, unnest(x) AS line, unnest(range(len(x))) AS i FROM (SELECT item_id, t, list_filter(list_transform(string_split(substr(t || chr(10) || text, 1, 60), chr(10)), lambda y: trim(y)), lambda y: y <> '') AS x FROM benchmark, (VALUES ('fact'), ('theme')) v(t)))
SELECT item_id || '__' || t || '__' || i AS query_id, line AS text, t AS type FROM t WHERE i < 3""")
def generated_queries(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return generation.generate_queries(docs, ["fact", "theme"], lambda p: p[:60])[0]


@query("SELECT item_id, 1 AS n, text || '  end' AS clean FROM benchmark")
def footnotes(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.col("text"), F.lit(' <sup class="footnote-marker">1</sup><i class="footnote">a <i>b</i></i> end'))
    rows = table(spark, d, "benchmark").select("item_id", marked.alias("t"))
    return rows.select("item_id", F.size(text.footnote_spans(F.col("t"))).alias("n"), text.remove_footnotes(F.col("t")).alias("clean"))
