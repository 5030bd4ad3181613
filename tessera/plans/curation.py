"""Queries on curation and chunking: choices, clusters, comparisons, footnotes, boundaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import registered, text, vector
from ..operators import chunking, cluster, gather, intervals, labels, ordering, ranking, retrieval, select, spans
from .catalog import query, table
from .modelling import _topics
from .relational import _rankings


@query("SELECT 'gold' AS side, doc_id AS ref FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 500) UNION ALL SELECT 'predicted', doc_id FROM documents WHERE n_chars > 500 AND doc_id IN (SELECT doc_id FROM labels)")
def shared_refs(spark: SparkSession, d: str) -> DataFrame:
    """Gold refs that are predicted, and the other way round."""
    gold, predicted = table(spark, d, "labels").select(F.col("doc_id").alias("ref")), table(spark, d, "documents").where("n_chars > 500").select(F.col("doc_id").alias("ref"))
    return labels.keep_shared(gold, predicted).select(F.lit("gold").alias("side"), "ref").union(labels.keep_shared(predicted, gold).select(F.lit("predicted"), "ref"))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 0) > 0")
def relevant_judgements(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return retrieval.relevant_docs(both.withColumn("relevance", F.col("quality"))).select("doc_id")


@query("SELECT p.event_id, c.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'error') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL) c ON p.user_id = c.user_id AND p.ts >= c.ts")
def as_of_events(spark: SparkSession, d: str) -> DataFrame:
    """For every error the user's last click at or before it."""
    e = table(spark, d, "events")
    out = ordering.as_of(e.where("event_type = 'error'"), e.where("event_type = 'click'"), "user_id", "ts", "event_id", "before")
    return out.select("event_id", "before")


@query("SELECT first, count(*) AS n FROM (SELECT conv_id, arg_min(role, turn) AS first FROM conversations GROUP BY conv_id) GROUP BY first")
def first_author_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("authors"))
    return c.groupBy(F.col("authors")[0]["role"].alias("first")).agg(F.count("*").alias("n"))


_HDI = """e AS (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS value FROM events), v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)"""


def _hdi_sql(name: str, mass: float) -> str:
    return f"{name} AS (SELECT a.user_id, min({{'w': h.value - a.value, 'low': a.value, 'high': h.value}}) AS b FROM (SELECT *, greatest(1, CAST(floor(n * {mass}) AS BIGINT)) AS k FROM v) a JOIN v h ON a.user_id = h.user_id AND h.i = a.i + a.k GROUP BY a.user_id)"


@query(f"WITH {_HDI}, {_hdi_sql('x', 0.8)}, {_hdi_sql('y', 0.95)} SELECT v.user_id, avg(value) AS mean, avg((value > 1000)::INT) AS p_above, min(x.b).low AS low_80, min(x.b).high AS high_80, min(y.b).low AS low_95, min(y.b).high AS high_95 FROM v JOIN x USING (user_id) JOIN y USING (user_id) GROUP BY v.user_id")
def effect_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.round(F.col("value") * 100).cast("bigint").alias("value"))
    return ranking.effect_summary(e, ["user_id"], "value", 1000)


@query("SELECT o_custkey AS key, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value FROM orders GROUP BY o_custkey ORDER BY value DESC, key LIMIT 10")
def top_keys(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("value"))
    return sums.orderBy(F.desc("value"), "key").limit(10)


@query("SELECT dim, metric, setup FROM (VALUES (256), (512), (768), (1536), (3072)) a(dim), (VALUES ('cosine'), ('dot'), ('euclidean')) b(metric), (VALUES ('a'), ('b')) c(setup) ORDER BY dim % 7 DESC, metric, setup, dim LIMIT 10")
def top_configurations(spark: SparkSession, d: str) -> DataFrame:
    grid = retrieval.experiment_grid(spark, dim=[256, 512, 768, 1536, 3072], metric=["cosine", "dot", "euclidean"], setup=["a", "b"])
    return grid.orderBy(F.desc(F.col("dim") % 7), "metric", "setup", "dim").limit(10).withColumn("dim", F.col("dim").cast("int"))


_CENTRES = "u AS (SELECT label, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, unnest(range(len(embedding))) AS i FROM embeddings), a AS (SELECT label, i, avg(x) AS x FROM u GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS v FROM a GROUP BY label)"


@query(f"WITH {_CENTRES} SELECT p.label AS a, q.label AS b, round(1 - list_cosine_similarity(p.v, q.v), 6) AS distance FROM c p, c q")
def distance_matrix(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    c = u.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return cluster.distance_matrix(c, "label", "v").withColumn("distance", F.round("distance", 6))


@query("SELECT o_custkey AS topic, o_orderkey AS ref, CASE WHEN o_orderstatus = 'P' THEN -10.0 * n ELSE n - i END::DOUBLE AS weight FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)")
def source_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights by rank; blocked sources weigh less than any other."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("topic"), F.col("o_orderkey").alias("ref"), (F.col("o_orderstatus") == "P").alias("blocked"))
    return select.weighted(o, "topic", "ref", "blocked").select("topic", "ref", "weight")


@query("SELECT n_nationkey AS ref, CASE WHEN n_nationkey % 6 = 0 THEN 5 + dense_rank() OVER (ORDER BY n_nationkey % 6 <> 0, n_nationkey) - 1 ELSE n_regionkey END::BIGINT AS cluster FROM nation")
def primaries_alone(spark: SparkSession, d: str) -> DataFrame:
    """Each primary source gets a cluster of its own after the others."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("ref"), F.col("n_regionkey").cast("bigint").alias("cluster"))
    return cluster.alone(n, F.col("ref") % 6 == 0, "ref")


@query("SELECT n_regionkey AS problem, list_sort([a, b, c]) AS items FROM (SELECT x.n_regionkey, x.n_nationkey AS a, y.n_nationkey AS b, z.n_nationkey AS c FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey JOIN nation z ON z.n_regionkey = x.n_regionkey AND y.n_nationkey < z.n_nationkey)")
def candidate_sets(spark: SparkSession, d: str) -> DataFrame:
    """All sets of three items of a problem, or a thousand drawn ones where there are more."""
    return ranking.candidate_sets(table(spark, d, "nation").select(F.col("n_regionkey").alias("problem"), F.col("n_nationkey").alias("item")), 3, 1000)


@query("WITH r AS (SELECT DISTINCT o_custkey, o_orderkey, l_partkey % 12 AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey), c AS (SELECT item, count(*) AS exposure FROM r GROUP BY item) SELECT item, exposure FROM c ORDER BY exposure, md5(item || ':0'), item LIMIT 4")
def least_exposed(spark: SparkSession, d: str) -> DataFrame:
    seen = _rankings(spark, d).select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("exposure"))
    return ranking.warm_start(seen, 4).select("item", "exposure")


@query()
def comparison_batches(spark: SparkSession, d: str) -> DataFrame:
    """The next sets of three items to compare in every problem: walks over a maximum spanning tree of utilities."""
    s = table(spark, d, "events").select((F.col("user_id") % 7).alias("problem"), F.expr("event_id div 40").alias("draw"), (F.col("event_id") % 8).alias("item"), (F.col("value") / 50).alias("score"))
    u = ranking.pair_utilities(s.groupBy("problem", "draw", "item").agg(F.avg("score").alias("score")))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*df["a"], *df["b"]})
        at = {x: i for i, x in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for a, b, x in zip(df["a"], df["b"], df["utility"], strict=True):
            m[at[a], at[b]] = m[at[b], at[a]] = x
        sets = ranking.next_batch(m, 3, 4, 1)
        return pd.DataFrame([(df["problem"].iloc[0], k, [names[i] for i in s]) for k, s in enumerate(sets)], columns=["problem", "place", "items"])

    return u.groupBy("problem").applyInPandas(run, "problem bigint, place int, items array<bigint>")


@query("SELECT label - 1 AS cluster, count(*) AS size, md5(string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id)) AS items FROM embeddings WHERE label > 0 GROUP BY label")
def labelled_members(spark: SparkSession, d: str) -> DataFrame:
    """Clusters out of labels; the first label is noise."""
    rows = table(spark, d, "embeddings").select(F.lit(0).alias("topic"), F.col("vec_id").alias("id"), (F.col("label") - 1).alias("cluster"))
    return cluster.members(rows).select("cluster", "size", F.md5(F.array_join(F.col("items").cast("array<string>"), ",")).alias("items"))


@query()
def collapsed_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Near clusters of every topic merged at the threshold that spreads them best."""
    rows = _topics(spark, d)
    found = cluster.cluster_groups(rows, "agglomerative", whole=True).join(rows, ["topic", "id"])

    def run(df: pd.DataFrame) -> pd.DataFrame:
        ks = sorted(df["cluster"].unique())
        x = np.stack(df["vector"].to_list()).astype(float)
        t, merged = cluster.best_collapse(np.stack([x[(df["cluster"] == k).to_numpy()].mean(axis=0) for k in ks]))
        to = dict(zip(ks, merged.tolist(), strict=True))
        return pd.DataFrame({"topic": df["topic"], "id": df["id"], "cluster": df["cluster"].map(to), "threshold": t})

    return found.groupBy("topic").applyInPandas(run, "topic bigint, id bigint, cluster int, threshold double")


@query()
def reclustered(spark: SparkSession, d: str) -> DataFrame:
    """The items of clusters that are large beside a topic's others are clustered once more."""
    rows = _topics(spark, d)
    return cluster.recluster_large(rows, cluster.cluster_groups(rows, "density"), "affinity")


@query()
def noise_settled(spark: SparkSession, d: str) -> DataFrame:
    """What density clustering leaves as noise is clustered on its own."""
    rows = _topics(spark, d)
    return cluster.settle_noise(rows, cluster.cluster_groups(rows, "density_leaf"))


@query()
def largest_broken_up(spark: SparkSession, d: str) -> DataFrame:
    rows = _topics(spark, d)
    return cluster.break_largest(rows, cluster.cluster_groups(rows, "agglomerative", whole=True))


@query()
def sidebar_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Linked texts of a page in clusters, and those left out with the reason."""
    e = table(spark, d, "embeddings")
    rows = e.select((F.col("vec_id") % 20).alias("topic"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("label") == 0, "no text").when(F.col("label") == 1, "same book").alias("reason"))
    return cluster.with_ignored(rows, "agglomerative")


@query()
def chosen_in_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Choices made again until all chosen sources are interesting."""
    rows = cluster.cluster_groups(_topics(spark, d), "agglomerative", whole=True).where("cluster >= 0")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id")
        own = [select.Source(str(i), int(c), float(len(df) - k), book=f"b{i % 7}") for k, (i, c) in enumerate(zip(df["id"], df["cluster"], strict=True))]
        got = select.solve_in_rounds(own, lambda s: int(s.ref) % 5 > 0)
        return pd.DataFrame([(df["topic"].iloc[0], int(s.ref), s.cluster) for s in got], columns=["topic", "id", "cluster"])

    return rows.groupBy("topic").applyInPandas(run, "topic bigint, id bigint, cluster int")


@query("SELECT item_id, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS prepared FROM benchmark")
def prepared_segments(spark: SparkSession, d: str) -> DataFrame:
    """Markup, points and runs of white space go."""
    marked = F.concat(F.lit("<b>"), F.replace(F.col("text"), F.lit(" "), F.lit("\n <i> ")), F.lit("</b>"))
    return table(spark, d, "benchmark").select("item_id", chunking.prepare(marked).alias("prepared"))


@query("""WITH b AS (SELECT item_id, text, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS n FROM benchmark)
SELECT item_id AS ref, 1 AS index, 'main' AS kind, text || '  end' AS text FROM b UNION ALL SELECT item_id, 2, 'footnote', 'note one a' FROM b""")
def footnote_segments(spark: SparkSession, d: str) -> DataFrame:
    """Footnotes leave their text and become segments of their own, as many to one as fit."""
    note = lambda k, body: f'<sup class="footnote-marker">{k}</sup><i class="footnote">{body}</i>'
    marked = F.concat("text", F.lit(f" {note(1, 'note one')}{note(2, 'a')} end"))
    out = chunking.with_footnotes(table(spark, d, "benchmark").select(F.col("item_id").alias("ref"), F.lit(1).alias("index"), marked.alias("text")), "ref", "index", "text", 40)
    return out.select("ref", "index", "kind", F.when(F.col("kind") == "footnote", F.regexp_replace("text", r"^\d |(?<= )\d ", "")).otherwise(F.col("text")).alias("text"))


@query("""WITH s AS (SELECT conv_id, turn, row_number() OVER w AS i, role, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), c AS (SELECT *, (i - 1) // 3 AS chunk, count(*) OVER (PARTITION BY conv_id) AS n FROM s)
SELECT conv_id, i AS split_number, chunk + 1 AS chunk_number, coalesce(next <> role, false) AS semantic_boundary_after, i % 3 = 0 AND i < n AS final_boundary_after FROM c""")
def boundary_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every split with its chunk, and whether a boundary by sense or of the final chunks follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", F.row_number().over(w).alias("split"), F.coalesce(F.lead("role").over(w) != F.col("role"), F.lit(False)).alias("semantic"))
    out = chunking.boundaries(rows.withColumn("chunk", F.floor((F.col("split") - 1) / 3)), "conv_id", "split", "chunk", "semantic")
    return out.select("conv_id", F.col("split_number").cast("bigint").alias("split_number"), "chunk_number", "semantic_boundary_after", "final_boundary_after")


@query("SELECT c_nationkey AS problem, md5(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_acctbal DESC, c_custkey)) AS ranking FROM customer GROUP BY c_nationkey")
def score_order(spark: SparkSession, d: str) -> DataFrame:
    """A listwise ranking by a deterministic judge: by score."""
    best_first = F.array_sort(F.collect_list(F.struct((-F.col("c_acctbal")).alias("s"), "c_custkey")))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("problem")).agg(F.transform(best_first, lambda x: x["c_custkey"].cast("string")).alias("r"))
    return c.select("problem", F.md5(F.array_join("r", ",")).alias("ranking"))


@query("SELECT conv_id, string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ':' || turn || ':' || (turn + length(text)), '|' ORDER BY turn) AS spans FROM conversations GROUP BY conv_id")
def ner_spans(spark: SparkSession, d: str) -> DataFrame:
    """A model's spans as labelled spans of a document."""
    own = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("start"), (F.col("turn") + F.length("text")).alias("end"), F.col("role").alias("label"))))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(own.alias("s"))
    one = lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"))
    return c.select("conv_id", F.array_join(F.transform(spans.entity_spans(F.col("s")), one), "|").alias("spans"))


@query("SELECT conv_id, turn, role, trim(s) AS sentence FROM (SELECT conv_id, turn, role, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM conversations) WHERE trim(s) <> ''")
def sentence_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as rows of sentences that keep their metadata."""
    parts = text.split_by_language(F.col("text"), F.lit("en"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.explode(parts).alias("sentence"))


@query("""WITH l AS (SELECT DISTINCT l_partkey AS ref, l_suppkey AS other FROM lineitem WHERE l_returnflag = 'A'), s AS (SELECT s_suppkey, s_suppkey % 40 AS start, s_suppkey % 40 + 3 AS stop, CASE WHEN s_acctbal > 0 THEN s_name END AS author FROM supplier)
SELECT l.ref, l.other, coalesce(s.author, 'An Unknown Author') AS author FROM l JOIN s ON s.s_suppkey = l.other WHERE NOT EXISTS (SELECT 1 FROM (VALUES (5, 9), (20, 20)) x(a, b) WHERE s.start <= x.b AND x.a <= s.stop)""")
def linked_commentaries(spark: SparkSession, d: str) -> DataFrame:
    """The other ends of links that are there in full, without those in excluded ranges; authors default."""
    start = F.col("s_suppkey") % 40
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ref"), F.lit("b").alias("book"), start.alias("start"), (start + 3).alias("end"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("author"))
    out = spark.createDataFrame([("b", 5, 9), ("b", 20, 20)], "book string, start bigint, end bigint")
    free = intervals.without_overlap(s, out).select(F.col("ref").alias("other"), F.coalesce("author", F.lit("An Unknown Author")).alias("author"))
    links = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("ref"), F.col("l_suppkey").alias("other")).distinct()
    return links.join(free, "other").select("ref", "other", "author")


@query("SELECT c_mktsegment AS segment, round(count(*) / sum(1 / (c_acctbal + 1001)), 6) AS mean, CAST(sum(length(c_name)) AS BIGINT) AS letters FROM customer GROUP BY c_mktsegment")
def registered_functions(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate function in Python and a table function, both called from SQL."""
    registered.register(spark)
    table(spark, d, "customer").createOrReplaceTempView("tessera_customer")
    return spark.sql("""WITH l AS (SELECT x.c_mktsegment AS segment, count(*) AS letters FROM tessera_customer x, LATERAL letters_of(x.c_name) GROUP BY x.c_mktsegment),
m AS (SELECT c_mktsegment AS segment, round(harmonic_mean(c_acctbal + 1001), 6) AS mean FROM tessera_customer GROUP BY c_mktsegment) SELECT segment, mean, letters FROM m JOIN l USING (segment)""")


@query(f"""WITH {_CENTRES}, p AS (SELECT e.vec_id, e.label AS own, c.label, 1 - list_cosine_similarity(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), c.v) AS dist FROM embeddings e, c),
m AS (SELECT vec_id, min(dist) FILTER (own = label) AS a, min(dist) FILTER (own <> label) AS b FROM p GROUP BY vec_id) SELECT count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS score FROM m""")
def centre_silhouette(spark: SparkSession, d: str) -> DataFrame:
    """How much nearer vectors are to their own centre than to the nearest other."""
    e = table(spark, d, "embeddings")
    u = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = u.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c")).agg(F.collect_list(F.struct("label", "c")).alias("cs"))
    dist = F.transform("cs", lambda s: F.struct(s["label"].alias("label"), vector.cosine_distance(F.col("embedding"), s["c"]).alias("d")))
    m = e.join(F.broadcast(c)).select("label", dist.alias("d"))
    low = lambda own: F.array_min(F.transform(F.filter("d", lambda s: (s["label"] == F.col("label")) == F.lit(own)), lambda s: s["d"]))
    m = m.select(low(True).alias("a"), low(False).alias("b"))
    return m.agg(F.count("*").alias("n"), F.round(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")), 6).alias("score"))


@query("SELECT slug, count(*) AS n FROM (SELECT lang AS slug FROM documents UNION ALL SELECT source FROM documents) WHERE slug NOT IN ('fr') GROUP BY slug")
def known_slugs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ref"), F.array("lang", "source").alias("slugs"))
    counts = labels.label_counts(rows).withColumnRenamed("count", "n")
    return gather.without_known(counts, spark.createDataFrame([("fr",)], "slug string"), ["slug"])


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
g AS (SELECT conv_id, i, turn, n, n AS room, 1 AS grp FROM r WHERE i = 1 UNION ALL
 SELECT r.conv_id, r.i, r.turn, r.n, CASE WHEN g.room + r.n > 1500 AND g.room > 0 THEN r.n ELSE g.room + r.n END, CASE WHEN g.room + r.n > 1500 AND g.room > 0 THEN g.grp + 1 ELSE g.grp END FROM g JOIN r ON r.conv_id = g.conv_id AND r.i = g.i + 1)
SELECT conv_id AS section, CAST(grp AS BIGINT) AS "group", min(turn) AS first, max(turn) AS last, count(*) AS rows, CAST(sum(n) AS BIGINT) AS size FROM g GROUP BY conv_id, grp""")
def packed_turns(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's turns in groups of at most 1,500 letters, by a table function that takes the table as its argument."""
    registered.register(spark)
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("section"), F.col("turn").alias("place"), F.length("text").alias("size"))
    turns.createOrReplaceTempView("tessera_turns")
    return spark.sql("SELECT * FROM packed(TABLE(tessera_turns), 1500)")
