"""Vector retrieval and its evaluation.

Documents are scored against a stated set of queries in blocks (see search). Judgements are rows (query_id, doc_id,
relevance), or follow from labels: a document is relevant to the queries of its label. Then relevant documents are
counted by label and looked for among ranked rows only, and no row stands for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector
from ..session import cut_lineage
from . import search

KS = (1, 3, 5, 10, 20, 50)
#: Shares that one step of a skyline's merge puts together.
MERGED = 8


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.select("query_id", "doc_id", "score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def rank(docs: DataFrame, queries: DataFrame, k: int, measure: str = "cosine", threshold: float | None = None, query_bytes: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): each query's k best of docs (doc_id, vector), ties to the smaller doc_id;
    with a threshold, only scores at least that high."""
    found = search.top(docs, queries, k, measure, query_bytes=query_bytes)
    return _ranked(found if threshold is None else found.where(F.col("score") >= threshold), k)


def rank_by_label(docs: DataFrame, queries: DataFrame, k: int, measure: str = "cosine", first: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Ranked rows with rel (1 where the document has the query's label), and with first the rank of each query's best
    relevant document (inf: none); docs and queries have a label. One scan serves both; only queries whose best relevant
    document is not among their k best are counted in another."""
    found = search.top(docs, queries, k, measure, own_label=first)
    if first:
        found = cut_lineage(found, "ranked")
    labels = docs.select("doc_id", F.col("label").alias("__d"))
    ranked = _ranked(found.where("kind = 0"), k).join(labels, "doc_id").join(queries.select("query_id", F.col("label").alias("__q")), "query_id")
    ranked = ranked.select("query_id", "doc_id", "score", "rank", (F.col("__d") == F.col("__q")).cast("int").alias("rel"))
    if not first:
        return ranked, None
    ranked = cut_lineage(ranked, "ranked-by-label")
    near = ranked.where("rel = 1").groupBy("query_id").agg(F.min("rank").cast("double").alias("place"))
    best = found.where("kind = 1").groupBy("query_id").agg(F.max_by(F.struct("doc_id", "score"), F.struct("score", (-F.col("doc_id")).alias("d"))).alias("m"))
    far = best.join(near, "query_id", "left_anti").join(queries.select("query_id", "vector"), "query_id")
    counted = search.ahead(docs, far.select("query_id", "vector", F.col("m.doc_id").alias("best"), F.col("m.score").alias("edge")), measure)
    places = near.unionByName(counted.select("query_id", (F.col("n") + 1).cast("double").alias("place")))
    return ranked, queries.select("query_id").join(places, "query_id", "left").select("query_id", F.coalesce("place", F.lit(float("inf"))).alias("first_relevant_rank"))


def relevant_docs(qrels: DataFrame) -> DataFrame:
    """Judgements above zero; a missing one counts as zero."""
    return qrels.where(F.coalesce("relevance", F.lit(0)) > 0)


def marked(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Ranked rows with rel: 1 where a judgement says so."""
    rel = relevant_docs(qrels).select("query_id", "doc_id", F.lit(1).alias("rel")).distinct()
    return ranked.join(rel, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def top_lists(hits: DataFrame) -> DataFrame:
    """(query_id, top: array of struct(rank, doc_id, is_relevant), in order) of ranked rows with rel."""
    row = F.struct("rank", "doc_id", (F.col("rel") == 1).alias("is_relevant"))
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("top"))


def first_relevant_rank(docs: DataFrame, queries: DataFrame, qrels: DataFrame, measure: str = "cosine") -> DataFrame:
    """(query_id, first_relevant_rank): inf where no relevant document is there. Relevant pairs are scored by joins; then
    documents ahead of each query's best relevant one are counted in blocks."""
    rel = relevant_docs(qrels).select("query_id", "doc_id").distinct()
    pair = rel.join(docs.select("doc_id", "vector"), "doc_id").join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
    scored = pair.select("query_id", "doc_id", vector.measure(measure, F.col("q"), F.col("vector")).alias("score"))
    best = scored.groupBy("query_id").agg(F.max_by(F.struct("doc_id", "score"), F.struct("score", (-F.col("doc_id")).alias("d"))).alias("m"))
    targets = queries.join(best, "query_id").select("query_id", "vector", F.col("m.doc_id").alias("best"), F.col("m.score").alias("edge"))
    found = search.ahead(docs, targets, measure).select("query_id", (F.col("n") + 1).cast("double").alias("place"))
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("place", F.lit(float("inf"))).alias("first_relevant_rank"))


def query_metrics(ranked: DataFrame, qrels: DataFrame, queries: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """nDCG, recall and MRR at each k of every query that has a judgement; the ideal counts all relevant documents, ranked or not."""
    size = relevant_docs(qrels).select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_rel"))
    judged = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi").select("query_id")
    return _metrics(marked(ranked, qrels), judged.join(size, "query_id", "left"), ks)


def metrics_by_label(hits: DataFrame, docs: DataFrame, queries: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """The same where labels judge: ranked rows with rel, and relevant documents counted once a label."""
    size = docs.groupBy("label").agg(F.count("*").alias("n_rel"))
    return _metrics(hits, queries.select("query_id", "label").join(size, "label").select("query_id", "n_rel"), ks)


def _metrics(hit: DataFrame, judged: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    parts = []
    for k in ks:
        near = (F.col("rel") == 1) & (F.col("rank") <= k)
        parts += [F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}"), F.sum(near.cast("int")).alias(f"hits_{k}"), F.min(F.when(near, F.col("rank"))).alias(f"first_{k}")]
    sums = hit.groupBy("query_id").agg(*parts)
    base = judged.join(sums, "query_id", "left")
    n = F.coalesce("n_rel", F.lit(0))
    out = [F.col("query_id")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(k))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
        zero = lambda c: F.when(n == 0, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
        out += [zero(F.col(f"dcg_{k}") / ideal).alias(f"ndcg_{k}"), zero(F.try_divide(F.col(f"hits_{k}"), n)).alias(f"recall_{k}"), F.coalesce(1 / F.col(f"first_{k}"), F.lit(0.0)).alias(f"mrr_{k}")]
    return base.select(*out)


def mean_finite(c: Column) -> Column:
    """Mean of the finite values: 0 for no rows, inf if none is finite."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(F.count("*") == 0, 0.0).when(F.count_if(finite) == 0, float("inf")).otherwise(F.avg(F.when(finite, c)))


def breakdowns(rows: DataFrame, metrics: list[str], groups: list[str]) -> DataFrame:
    """(grouping, group_value, query_count, means): overall and by each of groups in one pass; null and empty keys are 'unknown'."""
    keyed = rows.select(*metrics, *[F.coalesce(F.nullif(F.col(g).cast("string"), F.lit("")), F.lit("unknown")).alias(g) for g in groups])
    sets = [[], *([F.col(g)] for g in groups)]
    agg = keyed.groupingSets(sets, *groups).agg(F.grouping_id().alias("gid"), F.count("*").alias("query_count"), *[mean_finite(F.col(m)).alias(m) for m in metrics])
    full = (1 << len(groups)) - 1
    name, value = F.lit("overall"), F.lit("all")
    for i, g in enumerate(groups):
        own = F.col("gid") == full - (1 << (len(groups) - 1 - i))
        name, value = F.when(own, g).otherwise(name), F.when(own, F.col(g)).otherwise(value)
    return agg.select(name.alias("grouping"), value.alias("group_value"), "query_count", *metrics)


def query_category(qrels: DataFrame, docs: DataFrame) -> DataFrame:
    """Category of a query by its relevant documents: none is unknown, several are mixed."""
    cats = relevant_docs(qrels).join(docs.select("doc_id", F.coalesce("category", F.lit("unknown")).alias("category")), "doc_id").groupBy("query_id").agg(F.collect_set("category").alias("c"))
    one = F.when(F.size("c") == 1, F.col("c")[0]).otherwise("mixed")
    return qrels.select("query_id").distinct().join(cats, "query_id", "left").select("query_id", F.when(F.col("c").isNull(), "unknown").otherwise(one).alias("category"))


def _undominated(x: np.ndarray) -> np.ndarray:
    """Which rows no other beats. A row that beats another has the larger sum or, sums being rounded, comes before it in some column; beaten rows beat none that their own beaters don't."""
    order = np.lexsort((*x.T[::-1], x.sum(axis=1)))[::-1]
    keep: list[int] = []
    front = np.zeros((0, x.shape[1]))
    for part in np.array_split(order, max(1, len(order) // 256)):
        own = x[part]
        rest = np.concatenate((front, own))
        beaten = np.zeros(len(part), dtype=bool)
        for at in range(0, len(rest), 2048):
            other = rest[at : at + 2048, None, :]
            beaten |= ((other >= own[None]).all(axis=2) & (other > own[None]).any(axis=2)).any(axis=0)
        keep += part[~beaten].tolist()
        front = np.concatenate((front, own[~beaten]))
    mask = np.zeros(len(x), dtype=bool)
    mask[keep] = True
    return mask


def pareto(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows that no other row beats: at least as good in all metrics and better in one. Equal rows stay, and so do rows with a null metric; NaN is above all numbers.

    A skyline: each partition drops what it sees beaten, then partitions are put together step by step, a few at a
    time. What a task holds is bounded by the undominated rows of its share, the last one's by the result.
    """
    whole = F.lit(True)
    for m in metrics:
        whole &= F.col(m).isNotNull()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            x = np.stack([held.column(m).to_numpy().astype(float) for m in metrics], axis=1)
            held = held.filter(pa.array(_undominated(np.where(np.isnan(x), np.inf, x))))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    front = rows.where(whole).mapInArrow(run, rows.schema)
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while shares > 1:
        shares = -(-shares // MERGED)
        front = front.repartition(shares).mapInArrow(run, rows.schema)
    return front.unionByName(rows.where(~whole))


def experiment_grid(spark, **axes: list) -> DataFrame:
    """All combinations of the axes' values."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.crossJoin(one)
    return out
