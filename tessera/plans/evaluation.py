"""Queries on vectors: retrieval, its evaluation, tagging and label metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector
from ..operators import cluster, labels, retrieval, tuning
from ..session import cut_lineage
from .catalog import query, table

_V = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 <> 0").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


_SCORED = f"""
WITH e AS ({_V}), q AS (SELECT vec_id AS query_id, label AS ql, v AS qv FROM e WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS doc_id, {{score}} AS score, (label = ql)::INT AS rel FROM e, q WHERE vec_id % 50 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
"""
_MEASURES = {"dot": "list_dot_product(v, qv)", "cosine": "list_cosine_similarity(v, qv)", "euclidean": "-list_distance(v, qv)"}
for _name, _score in _MEASURES.items():

    @query(_SCORED.format(score=_score) + "SELECT query_id, doc_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10", name=f"vec_rank_{_name}")
    def _rank(spark: SparkSession, d: str, measure: str = _name) -> DataFrame:
        return retrieval.rank(_docs(spark, d), _queries(spark, d), 10, measure).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(_SCORED.format(score=_MEASURES["cosine"]) + "SELECT query_id, doc_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20 AND score >= 0.2")
def vec_similarity_scan(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rank(_docs(spark, d), _queries(spark, d), 20, "cosine", threshold=0.2).select("query_id", "doc_id", "rank")


def _metric_sql() -> str:
    parts = []
    for k in retrieval.KS:
        parts.append(f"coalesce(sum(CASE WHEN rel = 1 AND rank <= {k} THEN 1 / log2(rank + 1) END), 0) / list_sum(list_transform(range(1, CAST(least(greatest(sum(rel), 1), {k}) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_{k}")
        parts.append(f"coalesce(sum(CASE WHEN rank <= {k} THEN rel END) / nullif(sum(rel), 0), 0) AS recall_{k}")
        parts.append(f"coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 AND rank <= {k} THEN rank END), 0) AS mrr_{k}")
    return f"m AS (SELECT query_id, {', '.join(parts)} FROM r GROUP BY query_id)"


_NAMES = [f"{m}_{k}" for k in retrieval.KS for m in ("ndcg", "recall", "mrr")]
_COSINE = _SCORED.format(score=_MEASURES["cosine"])


def _metrics(spark: SparkSession, d: str, measure: str = "cosine") -> DataFrame:
    docs, queries = _docs(spark, d), _queries(spark, d)
    return retrieval.metrics_by_label(retrieval.rank_by_label(docs, queries, max(retrieval.KS), measure)[0], docs, queries)


@query(f"{_COSINE}, {_metric_sql()} SELECT query_id, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)} FROM m")
def query_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("query_id", *[F.round(n, 6).alias(n) for n in _NAMES])


@query(f"{_COSINE} SELECT query_id, CAST(min(CASE WHEN rel = 1 THEN rank END) AS DOUBLE) AS first_relevant_rank FROM r GROUP BY query_id")
def first_relevant_rank(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rank_by_label(_docs(spark, d), _queries(spark, d), 10, first=True)[1]


@query(f"""{_COSINE}, {_metric_sql()}, g AS (SELECT m.*, CAST(label AS VARCHAR) AS label, CASE WHEN query_id % 100 = 0 THEN 'even' ELSE 'odd' END AS kind FROM m JOIN embeddings ON vec_id = query_id)
SELECT CASE WHEN grouping(label, kind) = 3 THEN 'overall' WHEN grouping(label, kind) = 1 THEN 'label' ELSE 'kind' END AS grouping,
 CASE WHEN grouping(label, kind) = 3 THEN 'all' WHEN grouping(label, kind) = 1 THEN label ELSE kind END AS group_value, count(*) AS query_count,
 round(avg(ndcg_10), 6) AS ndcg_10, round(avg(recall_10), 6) AS recall_10, round(avg(mrr_10), 6) AS mrr_10 FROM g GROUP BY GROUPING SETS ((), (label), (kind))""")
def eval_breakdowns(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d).join(_queries(spark, d).select("query_id", "label"), "query_id").withColumn("kind", F.when(F.col("query_id") % 100 == 0, "even").otherwise("odd"))
    out = retrieval.breakdowns(m, ["ndcg_10", "recall_10", "mrr_10"], ["label", "kind"])
    return out.select("grouping", "group_value", "query_count", *[F.round(n, 6).alias(n) for n in ("ndcg_10", "recall_10", "mrr_10")])


@query(f"{_COSINE} SELECT query_id, string_agg(rank || ':' || doc_id || ':' || rel, ',' ORDER BY rank) AS top FROM r WHERE rank <= 10 GROUP BY query_id")
def top10_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = retrieval.top_lists(retrieval.rank_by_label(_docs(spark, d), _queries(spark, d), 10)[0])
    one = lambda x: F.concat_ws(":", x["rank"].cast("string"), x["doc_id"].cast("string"), x["is_relevant"].cast("int").cast("string"))
    return lists.select("query_id", F.array_join(F.transform("top", one), ",").alias("top"))


@query(f"""{_COSINE}, {_metric_sql()}, f AS (SELECT query_id, min(CASE WHEN rel = 1 THEN rank END) AS first FROM r GROUP BY query_id),
g AS (SELECT m.*, f.first, CAST(label AS VARCHAR) AS label, CASE WHEN query_id % 100 = 0 THEN 'even' ELSE 'odd' END AS kind, 'c' || (label % 3) AS category FROM m JOIN f USING (query_id) JOIN embeddings ON vec_id = query_id)
SELECT CASE grouping(label, kind, category) WHEN 7 THEN 'overall' WHEN 3 THEN 'label' WHEN 5 THEN 'kind' ELSE 'category' END AS grouping, CASE grouping(label, kind, category) WHEN 7 THEN 'all' WHEN 3 THEN label WHEN 5 THEN kind ELSE category END AS group_value,
 count(*) AS query_count, round(avg(first), 6) AS mean_first_relevant_rank, {', '.join(f'round(avg({n}), 6) AS {n}' for n in _NAMES)} FROM g GROUP BY GROUPING SETS ((), (label), (kind), (category))""")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    """All 19 means, overall and by three keys."""
    docs, queries = _docs(spark, d), _queries(spark, d)
    hits, first = retrieval.rank_by_label(docs, queries, max(retrieval.KS), first=True)
    m = retrieval.metrics_by_label(hits, docs, queries).join(first.withColumnRenamed("first_relevant_rank", "mean_first_relevant_rank"), "query_id").join(queries.select("query_id", "label"), "query_id")
    m = m.withColumn("kind", F.when(F.col("query_id") % 100 == 0, "even").otherwise("odd")).withColumn("category", F.concat(F.lit("c"), (F.col("label") % 3).cast("string")))
    names = [*_NAMES, "mean_first_relevant_rank"]
    return retrieval.breakdowns(m, names, ["label", "kind", "category"]).select("grouping", "group_value", "query_count", *[F.round(n, 6).alias(n) for n in names])


@query(f"""{_COSINE}, {_metric_sql()}, g AS (SELECT label, round(avg(ndcg_10), 6) AS a, round(avg(recall_50), 6) AS b FROM m JOIN embeddings ON vec_id = query_id GROUP BY label)
SELECT label, a, b FROM g x WHERE NOT EXISTS (SELECT 1 FROM g y WHERE y.a >= x.a AND y.b >= x.b AND (y.a > x.a OR y.b > x.b))""")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d).join(_queries(spark, d).select("query_id", "label"), "query_id")
    return retrieval.pareto(m.groupBy("label").agg(F.round(F.avg("ndcg_10"), 6).alias("a"), F.round(F.avg("recall_50"), 6).alias("b")), ["a", "b"])


@query("""WITH j AS (SELECT e.vec_id AS query_id, CASE WHEN count(DISTINCT d.lang) = 0 THEN 'unknown' WHEN count(DISTINCT d.lang) = 1 THEN min(d.lang) ELSE 'mixed' END AS category
FROM embeddings e LEFT JOIN documents d ON d.doc_id % 40 = e.vec_id AND d.doc_id % 3 > 0 GROUP BY 1) SELECT * FROM j""")
def query_category(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("category"))
    q = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"))
    rel = docs.withColumn("query_id", F.col("doc_id") % 40).join(q, "query_id", "right").select("query_id", "doc_id", F.when(F.col("doc_id") % 3 > 0, 1).otherwise(0).alias("relevance"))
    return retrieval.query_category(rel, docs)


_GRID = {"dim": [256, 512, 768, 1536, 3072], "metric": ["cosine", "dot", "euclidean"], "setup": ["a", "b", "c", "d", "e", "f", "g"]}


@query("""SELECT dim, metric, setup, substr(sha256(concat_ws('|', dim, metric, setup)), 1, 16) AS run_id
FROM (VALUES (256), (512), (768), (1536), (3072)) a(dim), (VALUES ('cosine'), ('dot'), ('euclidean')) b(metric), (VALUES ('a'), ('b'), ('c'), ('d'), ('e'), ('f'), ('g')) c(setup)""")
def experiment_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = retrieval.experiment_grid(spark, **_GRID).withColumn("dim", F.col("dim").cast("int"))
    return grid.select("*", F.substring(F.sha2(F.concat_ws("|", F.col("dim").cast("string"), "metric", "setup"), 256), 1, 16).alias("run_id"))


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    ranked = retrieval.rank(_docs(spark, d), _queries(spark, d), 50)
    tags = _docs(spark, d).select("doc_id", F.array(F.concat(F.lit("t"), F.col("label").cast("string")), F.concat(F.lit("m"), (F.col("label") % 3).cast("string"))).alias("slugs"))
    return ranked.join(tags, "doc_id").select(F.col("query_id").alias("ref"), F.col("doc_id").alias("other"), "slugs", "score")


_VOTES = f"""{_COSINE}, n AS (SELECT r.query_id AS ref, r.score, unnest(['t' || e.label, 'm' || (e.label % 3)]) AS slug FROM r JOIN embeddings e ON e.vec_id = r.doc_id WHERE rank <= 50),
v AS (SELECT ref, slug, sum(power(1 - sqrt(greatest(0, 1 - power(1 - power(sqrt(2) * (1 - score), 2) / 2, 2))), 3)) AS vote FROM n GROUP BY ref, slug)"""


@query(f"{_VOTES} SELECT ref, slug, round(vote, 6) AS vote FROM v")
def knn_tag_votes(spark: SparkSession, d: str) -> DataFrame:
    return labels.votes(_neighbours(spark, d), vector.relevance_weight(F.col("score"), 3.0)).withColumn("vote", F.round("vote", 6))


@query(f"{_VOTES}, k AS (SELECT *, avg(vote) OVER w + 0.3 * stddev_pop(vote) OVER w AS edge FROM v WINDOW w AS (PARTITION BY ref)) SELECT ref, slug FROM k WHERE vote > edge")
def knn_tags(spark: SparkSession, d: str) -> DataFrame:
    v = labels.votes(_neighbours(spark, d), vector.relevance_weight(F.col("score"), 3.0))
    return labels.above_mean(v, ["ref"], "vote", 0.3).select("ref", "slug")


@query(f"{_VOTES.replace('sum(power(1 - sqrt(greatest(0, 1 - power(1 - power(sqrt(2) * (1 - score), 2) / 2, 2))), 3))', 'count(*)')} SELECT ref, slug, CAST(vote AS DOUBLE) AS vote FROM v")
def knn_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return labels.votes(_neighbours(spark, d))


@query("""WITH c AS (SELECT 't' || label AS slug, count(*) AS count FROM embeddings GROUP BY label), n AS (SELECT greatest(1, floor(sqrt(count(*)))) AS sets FROM c)
SELECT slug, count, CAST((row_number() OVER (ORDER BY count DESC, slug) - 1) % sets AS BIGINT) AS part FROM c, n""")
def freq_partitions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.array(F.concat(F.lit("t"), F.col("label").cast("string"))).alias("slugs"))
    return labels.frequency_partitions(labels.label_counts(rows)).withColumn("part", F.col("part").cast("bigint"))


_GOLD = "CASE WHEN quality = 1 AND toxic = 1 THEN ['good', 'toxic'] WHEN quality = 1 THEN ['good'] WHEN toxic = 1 THEN ['toxic'] ELSE [] END"
_PRED = "CASE WHEN n_chars > 1500 AND doc_id % 7 = 0 THEN ['good', 'toxic'] WHEN n_chars > 400 THEN ['good'] ELSE ['other'] END"
_PAIRS = f"WITH p AS (SELECT doc_id AS ref, {_GOLD} AS gold, {_PRED} AS predicted FROM labels JOIN documents USING (doc_id))"
_CONF = f"{_PAIRS}, c AS (SELECT *, len(list_filter(predicted, lambda x: list_contains(gold, x))) AS tp, len(list_filter(predicted, lambda x: NOT list_contains(gold, x))) AS fp, len(list_filter(gold, lambda x: NOT list_contains(predicted, x))) AS fn FROM p)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    one = lambda c, name: F.when(c, F.array(F.lit(name))).otherwise(empty)
    gold = table(spark, d, "labels").select(F.col("doc_id").alias("ref"), F.concat(one(F.col("quality") == 1, "good"), one(F.col("toxic") == 1, "toxic")).alias("slugs"))
    guess = F.when((F.col("n_chars") > 1500) & (F.col("doc_id") % 7 == 0), F.array(F.lit("good"), F.lit("toxic"))).when(F.col("n_chars") > 400, F.array(F.lit("good"))).otherwise(F.array(F.lit("other")))
    return labels.pairs(gold, table(spark, d, "documents").select(F.col("doc_id").alias("ref"), guess.alias("slugs")))


@query(f"{_CONF} SELECT ref, CAST(tp AS INT) AS tp, CAST(fp AS INT) AS fp, CAST(fn AS INT) AS fn FROM c")
def pair_confusion(spark: SparkSession, d: str) -> DataFrame:
    return labels.confusion(_pairs(spark, d)).select("ref", "tp", "fp", "fn")


@query(f"""{_CONF}, s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg((list_sort(gold) = list_sort(predicted))::INT) AS exact FROM c)
SELECT tp, fp, fn, round(exact, 6) AS exact, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(5 * tp / (5 * tp + 4 * fn + fp), 6) AS fbeta FROM s""")
def micro_prf(spark: SparkSession, d: str) -> DataFrame:
    m = labels.micro(_pairs(spark, d))
    return m.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("exact", "precision", "recall", "f1", "fbeta")])


@query(f"""{_PAIRS}, g AS (SELECT ref, unnest(gold) AS slug FROM p), q AS (SELECT ref, unnest(predicted) AS slug FROM p)
SELECT coalesce(g.slug, q.slug) AS slug, count(*) FILTER (g.ref IS NOT NULL AND q.ref IS NOT NULL) AS tp, count(*) FILTER (g.ref IS NULL) AS fp, count(*) FILTER (q.ref IS NULL) AS fn
FROM g FULL JOIN q ON g.ref = q.ref AND g.slug = q.slug GROUP BY 1 UNION ALL SELECT 'unseen', 0, 0, 0""")
def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    universe = spark.createDataFrame([("good",), ("unseen",)], "slug string")
    out = labels.label_stats(_pairs(spark, d), universe)
    return out.select("slug", *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")])


@query("""WITH RECURSIVE e(child, parent) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
a(ref, slug) AS (SELECT c_custkey, 'n' || c_nationkey FROM customer UNION SELECT ref, parent FROM a JOIN e ON slug = child) SELECT ref, slug FROM a""")
def hierarchy_closure(spark: SparkSession, d: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, d, "nation").select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent"))
    edges = edges.union(table(spark, d, "region").select(key("r", "r_regionkey"), F.lit("world")))
    return labels.implied_parents(edges, table(spark, d, "customer").select(F.col("c_custkey").alias("ref"), key("n", "c_nationkey").alias("slug")))



@query(f"""WITH e AS ({_V}), u AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM e), a AS (SELECT label, i, avg(x) AS x FROM u GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS v FROM a GROUP BY label),
d AS (SELECT p.label AS a, q.label AS b, 1 - list_cosine_similarity(p.v, q.v) AS dist FROM c p, c q WHERE p.label <> q.label)
SELECT a AS label, round(sum(dist) / count(*), 6) AS avg_distance, round(min(dist), 6) AS nearest FROM d GROUP BY a""")
def centre_distances(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    c = u.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    dist = cluster.distance_matrix(c, "label", "v").where("a <> b").withColumnRenamed("distance", "dist")
    return dist.groupBy(F.col("a").alias("label")).agg(F.round(F.sum("dist") / F.count("*"), 6).alias("avg_distance"), F.round(F.min("dist"), 6).alias("nearest"))


@query(f"WITH e AS ({_V}) SELECT vec_id, unnest(range(len(v))) AS i, round(unnest(v) / sqrt(list_dot_product(v, v)), 6) AS x FROM e")
def normalise(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(vector.normalize(F.col("embedding"))).alias("i", "x"))
    return e.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query(f"""WITH e AS ({_V}), u AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM e), a AS (SELECT label, i, avg(x) AS x FROM u GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS v FROM a GROUP BY label),
d AS (SELECT p.label AS a, min(1 - list_cosine_similarity(p.v, q.v)) AS near FROM c p, c q WHERE p.label <> q.label GROUP BY 1) SELECT count(*) AS clusters, round(0.7 * (1 - least(abs(count(*) - 20), 40) / 40) + avg(near), 6) AS score FROM d""")
def spread_score(spark: SparkSession, d: str) -> DataFrame:
    """How well separated the labels' centres are, and how near their number is to 20."""
    near = centre_distances(spark, d)
    n = F.count("*")
    return near.agg(n.alias("clusters"), F.round(0.7 * (1 - F.least(F.abs(n - 20), F.lit(40)) / 40) + F.avg("nearest"), 6).alias("score"))


_WEIGHTS = "WITH e AS (SELECT event_id, value / 1000 + 0.6 AS r FROM events), c AS (SELECT event_id, r, 1 - power(sqrt(2) * (1 - r), 2) / 2 AS c FROM e)"


@query(f"{_WEIGHTS} SELECT event_id, round(c, 6) AS cosine, round(power(1 - sqrt(greatest(0, 1 - c * c)), 10), 6) AS sine, round(1 - acos(greatest(-1, least(1, c))) / pi(), 6) AS linear, 1.0::DOUBLE AS naive FROM c")
def vote_weights(spark: SparkSession, d: str) -> DataFrame:
    """Four ways to weigh a neighbour's vote by its relevance."""
    r = F.col("value") / 1000 + 0.6
    cos = vector.relevance_cosine(r)
    return table(spark, d, "events").select("event_id", F.round(cos, 6).alias("cosine"), F.round(vector.relevance_weight(r, 10.0), 6).alias("sine"), F.round(vector.linear_similarity(cos), 6).alias("linear"), F.lit(1.0).alias("naive"))


@query(f"""{_COSINE}, g AS (SELECT unnest([5, 10, 20]) AS k), p AS (SELECT k, query_id, sum(rel) FILTER (rank <= k) / sum(rel) AS recall FROM r, g GROUP BY ALL), a AS (SELECT k, round(avg(recall), 9) AS recall FROM p GROUP BY k)
SELECT k, round(recall, 6) AS recall FROM a ORDER BY recall DESC, k LIMIT 1""")
def best_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The number of neighbours with the highest mean recall, of a grid."""
    docs, queries = _docs(spark, d), _queries(spark, d)
    grid = retrieval.experiment_grid(spark, k=[5, 10, 20])
    wide = retrieval.metrics_by_label(retrieval.rank_by_label(docs, queries, 20)[0], docs, queries, (5, 10, 20)).agg(*[F.round(F.avg(f"recall_{k}"), 9).alias(f"{k}") for k in (5, 10, 20)])
    long = wide.unpivot([], ["5", "10", "20"], "k", "recall").withColumn("k", F.col("k").cast("int"))
    return grid.select(F.col("k").cast("int").alias("k")).join(long, "k").orderBy(F.desc("recall"), "k").limit(1).select("k", F.round("recall", 6).alias("recall"))


_SPACE = {"docs": tuning.Range(5, 100, whole=True), "factor": tuning.Range(0.25, 5), "power": tuning.Range(1, 20)}


def tagging_recall(neighbours: DataFrame, gold: DataFrame, trials: DataFrame, share: float) -> DataFrame:
    """(trial, score): micro recall of tags voted by the first `docs` neighbours, weighed to the `power`, above mean + `factor` deviations.

    Neighbours (ref, rank, score, slugs) meet a few trials; what is summed by trial, ref and label follows. share: of the refs, by hash.
    """
    part = F.pmod(F.xxhash64("ref"), F.lit(1000)) < int(1000 * share)
    weight = F.pow(1 - F.sqrt(F.greatest(F.lit(0.0), 1 - F.pow(vector.relevance_cosine(F.col("score")), 2))), F.col("power"))
    votes = neighbours.where(part).join(F.broadcast(trials), F.col("rank") <= F.col("docs")).select("trial", "ref", "factor", F.explode("slugs").alias("slug"), weight.alias("w"))
    votes = votes.groupBy("trial", "ref", "slug").agg(F.sum("w").alias("vote"), F.first("factor").alias("factor"))
    edges = votes.groupBy("trial", "ref").agg((F.avg("vote") + F.first("factor") * F.stddev_pop("vote")).alias("edge"))
    tagged = votes.join(edges, ["trial", "ref"]).where(F.col("vote") > F.col("edge"))
    wanted = gold.where(part).select("ref", F.explode("slugs").alias("slug"))
    hits = tagged.join(wanted, ["ref", "slug"]).groupBy("trial").agg(F.count("*").alias("hits"))
    size = wanted.agg(F.count("*").alias("all"))
    return trials.select("trial").join(hits, "trial", "left").join(F.broadcast(size)).select("trial", (F.coalesce("hits", F.lit(0)) / F.greatest("all", F.lit(1))).alias("score"))


def _tagging(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    slugs = F.array(F.concat(F.lit("t"), F.col("label").cast("string")), F.concat(F.lit("m"), (F.col("label") % 3).cast("string"))).alias("slugs")
    ranked = retrieval.rank(_docs(spark, d), _queries(spark, d), int(_SPACE["docs"].high))
    near = ranked.join(_docs(spark, d).select("doc_id", slugs), "doc_id").select(F.col("query_id").alias("ref"), "rank", "score", "slugs")
    return cut_lineage(near, "neighbours"), _queries(spark, d).select(F.col("query_id").alias("ref"), slugs)


@query()
def searched_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The setting of the tagger with the highest recall that a search of 200 trials found, with the trials it scored on all queries."""
    near, gold = _tagging(spark, d)
    found = tuning.search(spark, _SPACE, lambda trials, share: tagging_recall(near, gold, trials, share), rounds=5, trials=40, least_share=0.5)
    rows = [(place, int(t.values["docs"]), t.values["factor"], t.values["power"], t.score) for place, t in enumerate(t for t in found if t.share >= 1)]
    return spark.createDataFrame(rows, "place int, docs int, factor double, power double, recall double")
