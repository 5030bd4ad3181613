"""Queries on gathering and curating sources: link joins, roll-ups, orders, samples, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import gather, labels, ordering, ranking
from .catalog import query, table
from .relational import _rankings


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))


@query("""WITH c AS (SELECT o_custkey AS cust, o_orderkey AS chunk, l_partkey AS part, l_returnflag AS flag FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT l.link, min(c.chunk) AS chunk_id FROM (SELECT DISTINCT chunk || '-' || part AS link, cust, part FROM c WHERE flag = 'R') l JOIN c USING (cust, part) GROUP BY l.link""")
def chunk_for_link(spark: SparkSession, d: str) -> DataFrame:
    """A link of a part and a customer is found in that customer's first order that cites the part."""
    both = _lines(spark, d).withColumn("ref", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).withColumn("part", F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    links = both.where("l_returnflag = 'R'").select(F.concat_ws("-", F.col("o_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("link"), F.array("part", "ref").alias("refs")).distinct()
    chunks = both.groupBy(F.col("o_orderkey").alias("chunk_id"), "ref").agg(F.collect_list("part").alias("cited"))
    return gather.chunk_for_link(links, chunks)


@query("""WITH l AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), r AS (SELECT 's' || s_suppkey AS ref FROM supplier WHERE s_acctbal > 5000 UNION SELECT 'p' || p_partkey FROM part WHERE p_size < 10)
SELECT a AS ref, b AS other FROM l WHERE a IN (SELECT ref FROM r) UNION ALL SELECT b, a FROM l WHERE b IN (SELECT ref FROM r)""")
def opposite_ends(spark: SparkSession, d: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    links = table(spark, d, "lineitem").select(key("p", "l_partkey").alias("a"), key("s", "l_suppkey").alias("b")).distinct()
    refs = table(spark, d, "supplier").where("s_acctbal > 5000").select(key("s", "s_suppkey").alias("ref")).union(table(spark, d, "part").where("p_size < 10").select(key("p", "p_partkey")))
    return gather.opposite(links, refs)


@query("SELECT coalesce(l.doc_id, d.doc_id) AS ref, l.quality AS left_value, d.n_chars AS right_value FROM labels l FULL JOIN (SELECT * FROM documents WHERE n_chars > 300) d ON l.doc_id = d.doc_id")
def paired_lists(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "labels").select(F.col("doc_id").alias("ref"), F.col("quality").alias("value"))
    return gather.paired(left, table(spark, d, "documents").where("n_chars > 300").select(F.col("doc_id").alias("ref"), F.col("n_chars").alias("value")))


@query("WITH o AS (SELECT o_custkey AS ref, max(o_orderkey) AS spot FROM orders GROUP BY o_custkey) SELECT c_custkey AS ref, row_number() OVER (ORDER BY spot NULLS LAST, c_custkey) AS rank FROM customer LEFT JOIN o ON ref = c_custkey")
def aligned_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("ref"), F.col("c_custkey").alias("place"))
    return gather.in_order_of(rows, table(spark, d, "orders").select(F.col("o_custkey").alias("ref"), F.col("o_orderkey").alias("place"))).select("ref", "rank")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT e.vec_id AS id, c.vec_id AS centre, 1 - list_cosine_similarity(e.v, c.v) AS distance FROM e, e c WHERE c.vec_id % 50 = 0)
SELECT id, arg_min(centre, (distance, centre)) AS centre, round(min(distance), 6) AS distance FROM p GROUP BY id HAVING min(distance) < 1""")
def closest_centres(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return gather.closest(e, e.where("id % 50 = 0").withColumnRenamed("id", "centre")).withColumn("distance", F.round("distance", 6))


_MARKS = "SELECT doc_id AS ref, [lang, source] AS g, list_distinct([lang, 'src1', 'src2']) AS p, ['en', 'fr', 'src1', 'src2', 'src3'] AS c FROM documents"


def _marks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "ref")
    wide = docs.select("ref", F.array(*map(F.lit, ("en", "fr", "src1", "src2", "src3"))).alias("slugs"))
    return docs.select("ref", F.array("lang", "source").alias("slugs")), docs.select("ref", F.array(F.col("lang"), F.lit("src1"), F.lit("src2")).alias("slugs")), wide


@query(f"""WITH m AS ({_MARKS}), x AS (SELECT ref, list_filter(g, lambda y: list_contains(c, y)) AS g, p FROM m), n AS (SELECT ref, len(g)::INT AS n_gold, len(p)::INT AS n_pred, len(list_intersect(p, g))::INT AS tp FROM x),
s AS (SELECT *, coalesce(tp / nullif(n_pred, 0), 0.0) AS pr, coalesce(tp / nullif(n_gold, 0), 0.0) AS re FROM n)
SELECT ref, n_gold, n_pred, tp, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS score FROM s""")
def example_scores(spark: SparkSession, d: str) -> DataFrame:
    out = gather.example_scores(*_marks(spark, d))
    return out.select("ref", "n_gold", "n_pred", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "score")])


@query(f"WITH m AS ({_MARKS}), u AS (SELECT unnest(list_filter(p, lambda y: NOT list_contains(g, y))) AS slug FROM m) SELECT slug, count(*) AS n FROM u GROUP BY slug")
def false_positive_counts(spark: SparkSession, d: str) -> DataFrame:
    gold, predicted, _ = _marks(spark, d)
    return gather.false_positives(gold, predicted)


@query("SELECT user_id AS ref, md5(string_agg(event_type, ',' ORDER BY event_id)) AS slugs, arg_max(props, event_id) AS text FROM events GROUP BY user_id")
def slugs_by_ref(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("ref"), F.col("event_id").alias("place"), F.col("event_type").alias("slug"), F.col("props").alias("text"))
    return gather.by_ref(rows).withColumn("slugs", F.md5(F.array_join("slugs", ",")))


@query("SELECT c_nationkey AS topic, count(*) AS links FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_nationkey HAVING count(*) >= 20")
def well_linked_topics(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "customer").select(F.col("c_nationkey").alias("topic"), F.col("c_mktsegment").alias("source"))
    return gather.well_linked(links, ["BUILDING", "MACHINERY"], 20)


_RANGE = "l_suppkey AS topic, l_returnflag AS book, l_partkey % 300 AS start, l_partkey % 300 + CAST(l_quantity AS BIGINT) % 4 AS stop"


@query(f"""WITH w AS (SELECT DISTINCT {_RANGE} FROM lineitem WHERE l_linestatus = 'O'), f AS (SELECT DISTINCT {_RANGE} FROM lineitem WHERE l_linestatus = 'F'),
r AS (SELECT topic, count(*) AS recalled FROM f WHERE EXISTS (SELECT 1 FROM w WHERE w.topic = f.topic AND w.book = f.book AND f.start <= w.stop AND w.start <= f.stop) GROUP BY topic)
SELECT topic, count(*) AS wanted, coalesce(max(recalled), 0) AS recalled, round(coalesce(max(recalled), 0) / count(*), 6) AS recall FROM w LEFT JOIN r USING (topic) GROUP BY topic""")
def range_recall(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    start = F.col("l_partkey") % 300
    rows = li.select(F.col("l_suppkey").alias("topic"), F.col("l_returnflag").alias("book"), start.alias("start"), (start + F.col("l_quantity").cast("bigint") % 4).alias("end"), "l_linestatus")
    return gather.range_recall(rows.where("l_linestatus = 'O'"), rows.where("l_linestatus = 'F'")).withColumn("recall", F.round("recall", 6))


@query("SELECT conv_id AS option, round(avg(CASE WHEN turn % 2 = 0 THEN 1.0 ELSE 0.5 * (3 - list_position(['user', 'assistant', 'system'], role) + 1) / 3 END), 6) AS score FROM conversations GROUP BY conv_id")
def curation_scores(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("option")).agg(F.collect_list(F.struct(F.col("role").alias("ref"), (F.col("turn") % 2 == 0).alias("interesting"))).alias("chosen"))
    return gather.curation_score(c.withColumn("ranked", F.array(*map(F.lit, ("user", "assistant", "system"))))).withColumn("score", F.round("score", 6))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return o.cube("status", "priority").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("gid"))


@query("SELECT DISTINCT unnest([lang, source]) AS slug FROM documents")
def label_universe(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_counts(table(spark, d, "documents").select(F.array("lang", "source").alias("slugs"))).select("slug")


@query("SELECT source AS slug, count(*) AS n, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS refs FROM documents GROUP BY source UNION ALL SELECT lang, count(*), md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) FROM documents GROUP BY lang")
def label_refs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ref"), F.array("lang", "source").alias("slugs"))
    return labels.label_refs(rows).withColumn("refs", F.md5(F.array_join(F.col("refs").cast("array<string>"), ",")))


@query("SELECT source, round(avg(quality), 6) AS mean, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND quality IS NOT NULL GROUP BY source HAVING count(*) = count(l.doc_id) UNION ALL SELECT lang, round(avg(n_chars), 6), count(*) FROM documents GROUP BY lang")
def complete_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Means of groups whose members all have a value."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    one = labels.complete_mean(docs, "source", "quality")
    return one.union(labels.complete_mean(table(spark, d, "documents"), "lang", "n_chars")).withColumn("mean", F.round("mean", 6))


@query("WITH r AS (SELECT DISTINCT o_custkey AS problem, o_orderkey, l_partkey % 12 AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey), c AS (SELECT problem, item, count(*) AS exposure FROM r GROUP BY ALL) SELECT problem, item, exposure, min(exposure) OVER (PARTITION BY problem) AS least FROM c")
def exposures(spark: SparkSession, d: str) -> DataFrame:
    return ranking.exposures(_rankings(spark, d), table(spark, d, "lineitem").count())


@query("WITH s AS (SELECT o_custkey AS topic, o_orderkey AS ref, o_orderpriority IN ('1-URGENT') AS top FROM orders) SELECT topic, ref, CAST(row_number() OVER (PARTITION BY topic ORDER BY (NOT top)::INT, ref) AS INT) AS rank FROM s")
def primaries_first(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("topic"), F.col("o_orderkey").alias("ref"), "o_orderpriority")
    return gather.put_first(o, F.col("o_orderpriority") == "1-URGENT", "topic", "ref").select("topic", "ref", "rank")


@query("WITH c AS (SELECT DISTINCT l_suppkey AS cluster, l_partkey AS ref FROM lineitem), n AS (SELECT l_suppkey AS cluster, count(*) AS n FROM lineitem GROUP BY 1) SELECT arg_min(cluster, (-n, cluster)) AS cluster, ref FROM c JOIN n USING (cluster) GROUP BY ref")
def recomposed_clusters(spark: SparkSession, d: str) -> DataFrame:
    return gather.largest_cluster_first(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cluster"), F.col("l_partkey").alias("ref")))


@query("""WITH m AS (SELECT *, (NOT (role = 'user' AND coalesce(lag(role) OVER w, '') = 'user'))::INT AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m)
SELECT conv_id, CAST(run AS BIGINT) AS run, min(role) AS role, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n FROM r GROUP BY conv_id, run""")
def joined_outside_texts(spark: SparkSession, d: str) -> DataFrame:
    return gather.joined_runs(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", "user")


@query("SELECT conv_id, turn, CASE WHEN lag(role) OVER w = 'user' THEN lag(text) OVER w END AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY role <> 'user'")
def contexts_of_sources(spark: SparkSession, d: str) -> DataFrame:
    return gather.with_text_before(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", "user").select("conv_id", "turn", "before")


@query("SELECT item_id, array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:len(regexp_split_to_array(substr(text, 1, strpos(text, ' ') - 1), '\\s+')) + 2], ' ') AS words FROM benchmark")
def windows_around_spans(spark: SparkSession, d: str) -> DataFrame:
    """Two words after the first word of each text."""
    b = table(spark, d, "benchmark")
    return b.select("item_id", text.word_window(F.col("text"), F.lit(0), F.instr("text", " ") - 1, 2).alias("words"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(text) AS n FROM conversations),
p(conv_id, i, grp, room) AS (SELECT conv_id, i, 0, n FROM t WHERE i = 1 UNION ALL SELECT t.conv_id, t.i, CASE WHEN room + n > 800 AND room > 0 THEN grp + 1 ELSE grp END, CASE WHEN room + n > 800 AND room > 0 THEN n ELSE room + n END FROM p JOIN t ON t.conv_id = p.conv_id AND t.i = p.i + 1)
SELECT conv_id, string_agg(CAST(grp AS VARCHAR), ',' ORDER BY i) AS groups FROM p GROUP BY conv_id""")
def greedy_groups(spark: SparkSession, d: str) -> DataFrame:
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("bigint").alias("n")))), lambda x: x["n"])
    c = table(spark, d, "conversations").groupBy("conv_id").agg(sizes.alias("sizes"))
    return c.select("conv_id", F.array_join(ordering.pack_greedy(F.col("sizes"), 800).cast("array<string>"), ",").alias("groups"))


@query("SELECT conv_id, turn, round(avg(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS context FROM conversations")
def sliding_context(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-5, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(F.avg(F.length("text")).over(w), 6).alias("context"))


@query("""WITH i AS (SELECT n_regionkey AS topic, n_nationkey AS item, n_nationkey % 7 AS s FROM nation), w AS (SELECT a.topic, a.item, count(*) FILTER (a.s > b.s) AS wins FROM i a JOIN i b ON a.topic = b.topic GROUP BY ALL)
SELECT topic, item, wins, CAST(row_number() OVER (PARTITION BY topic ORDER BY wins DESC, item) AS INT) AS rank FROM w""")
def judged_order(spark: SparkSession, d: str) -> DataFrame:
    def better(a: Column, b: Column) -> Column:
        return F.when(a % 7 > b % 7, 1).when(a % 7 < b % 7, 2).otherwise(0)

    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("topic"), F.col("n_nationkey").alias("item"))
    return gather.judged_order(rows, "topic", "item", better)


@query("SELECT doc_id FROM documents WHERE n_chars > 400 ORDER BY md5(doc_id || ':17'), doc_id LIMIT 30")
def matching_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of rows that fulfil a condition, without a loop of tries."""
    return ordering.sample_n(table(spark, d, "documents").where("n_chars > 400").select("doc_id"), "doc_id", 30, 17)


@query("SELECT doc_id FROM (SELECT * FROM (SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || ':3'), doc_id LIMIT 60) WHERE lang <> 'en' ORDER BY md5(doc_id || ':3'), doc_id LIMIT 20)")
def oversampled(spark: SparkSession, d: str) -> DataFrame:
    """Three times as many as wanted are drawn, then filtered and cut."""
    return ordering.oversample(table(spark, d, "documents").select("doc_id", "lang"), F.col("lang") != "en", "doc_id", 20, 3, 3).select("doc_id")


@query("""WITH b AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5(source || ':5'), source LIMIT 4)
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':5'), doc_id) AS n FROM documents WHERE source IN (SELECT source FROM b)) WHERE n = 1""")
def two_stage_sample(spark: SparkSession, d: str) -> DataFrame:
    return ordering.two_stage(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 4, 5)


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey || ':0'), c_custkey) AS n FROM customer) WHERE n <= 5")
def cluster_samples(spark: SparkSession, d: str) -> DataFrame:
    return ordering.sample_per(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey", 5, 0)


@query("SELECT 'd' || doc_id AS ref, false AS is_confounder, lang FROM documents UNION ALL SELECT 'b' || item_id, true, NULL FROM benchmark")
def with_confounders(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import readers

    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("ref")
    docs, more = table(spark, d, "documents").select(key("d", "doc_id"), "lang"), table(spark, d, "benchmark").select(key("b", "item_id"))
    none = spark.createDataFrame([], "query_id bigint, doc_id bigint")
    return readers.dataset(docs, more, none, none)["docs"].select("ref", "is_confounder", "lang")


@query("SELECT c_custkey AS item, dense_rank() OVER (ORDER BY round(c_acctbal / 100) DESC) AS true_rank, dense_rank() OVER (ORDER BY c_nationkey DESC) AS posterior_rank FROM customer")
def dense_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.round(F.col("c_acctbal") / 100).alias("t"), F.col("c_nationkey").alias("p"))
    out = ranking.dense_ranks(ranking.dense_ranks(rows, "t", "true_rank"), "p", "posterior_rank")
    return out.select("item", "true_rank", "posterior_rank")


_DRAWN = "CAST('0x' || substr(md5(item || ':' || problem || ':9'), 1, 8) AS BIGINT)"


@query(f"""WITH i AS (SELECT c_nationkey AS problem, c_custkey AS item, c_acctbal / 1000 AS score FROM customer), g AS (SELECT problem, item, score - ln(-ln(({_DRAWN} + 1) / 4294967298.0)) AS s FROM i)
SELECT problem, item, CAST(row_number() OVER (PARTITION BY problem ORDER BY round(s, 9) DESC, item) AS INT) AS place FROM g""")
def simulated_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Rankings drawn one after the other with weights e^score, without replacement."""
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("problem"), F.col("c_custkey").alias("item"), (F.col("c_acctbal") / 1000).alias("score"))
    return ranking.simulate(rows, 9).select("problem", "item", "place")


@query("WITH n AS (SELECT count(*) AS n FROM part), p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) SELECT i AS item, round(1.8 - 3.6 * i / (n - 1) + 0.35 * sin(3.5 * pi() * i / (n - 1)) + 0.18 * (i % 4 - 1.5), 6) AS score FROM p, n")
def score_landscape(spark: SparkSession, d: str) -> DataFrame:
    return ranking.landscape(spark, table(spark, d, "part").count()).withColumn("score", F.round("score", 6))


@query("WITH p AS (SELECT o_custkey AS problem, o_orderkey AS ranking, l_partkey % 12 AS item, min(l_linenumber) AS pos FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3) SELECT problem, ranking, CAST(row_number() OVER (PARTITION BY ranking ORDER BY pos, item) AS INT) AS place, item FROM p")
def observations(spark: SparkSession, d: str) -> DataFrame:
    return _rankings(spark, d).select("problem", "ranking", F.posexplode("items").alias("i", "item")).select("problem", "ranking", (F.col("i") + 1).alias("place"), "item")


@query("SELECT count(*) AS n, count(*) FILTER (upper(substr(text, 1, 1)) <> substr(text, 1, 1)) AS edited FROM conversations")
def edited_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("text", F.concat(F.upper(F.substring("text", 1, 1)), F.expr("substr(text, 2)")).alias("prompt"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("text") != F.col("prompt")).alias("edited"))


@query("SELECT lang, CAST(sum(len(list_filter(regexp_split_to_array(trim(text, ' '), '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> ''))) AS BIGINT) AS words, CAST(sum(length(text) // 3) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def corpus_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(text.word_count(F.col("text"))).alias("words"), F.sum(text.estimated_tokens(F.col("text"))).alias("tokens"))


@query("SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS refs, arg_max(text, turn) AS last FROM conversations GROUP BY conv_id")
def golden_rows(spark: SparkSession, d: str) -> DataFrame:
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(roles, "|").alias("refs"), F.max_by("text", "turn").alias("last"))


@query("SELECT conv_id, turn, CAST(row_number() OVER (ORDER BY conv_id, turn) AS BIGINT) AS idx, substr(text, 1, 100) AS head, role <> 'system' AS resolved FROM conversations")
def profile_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a number over all of them and the head of their text."""
    return ordering.numbered(table(spark, d, "conversations"), "conv_id", ["turn"], "idx").select("conv_id", "turn", "idx", F.substring("text", 1, 100).alias("head"), (F.col("role") != "system").alias("resolved"))


@query("SELECT event_type, max(event_id) AS n, arg_max(user_id, ts) AS latest FROM events GROUP BY event_type")
def latest_jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.max("event_id").alias("n"), F.max_by("user_id", "ts").alias("latest"))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0")
def accepted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a verdict count as accepted."""
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    answer = F.when(F.col("toxic") == 0, "accept").when(F.col("toxic").isNotNull(), "reject")
    return both.where(F.coalesce(answer, F.lit("accept")) == "accept").select("doc_id")


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END AS role FROM conversations")
def mapped_roles(spark: SparkSession, d: str) -> DataFrame:
    role = F.coalesce(arrays.map_label(F.col("role"), {"user": "human", "assistant": "ai"}), F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", role.alias("role"))


@query("SELECT n_nationkey, n_name || ' (' || r_name || '): N/A' AS topic FROM nation JOIN region ON n_regionkey = r_regionkey")
def topic_strings(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", F.concat("n_name", F.lit(" ("), "r_name", F.lit("): N/A")).alias("topic"))


@query("SELECT n_regionkey AS slug, string_agg(n_name, '|' ORDER BY n_nationkey) AS refs, string_agg(CASE WHEN n_nationkey % 3 = 0 THEN 'gold ' || n_name ELSE '-' END, '|' ORDER BY n_nationkey) AS golds FROM nation GROUP BY n_regionkey")
def options_by_slug(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("slug"), F.col("n_nationkey").alias("place"), F.col("n_name").alias("ref"))
    gold = n.where("place % 3 = 0").select("slug", "ref", F.concat(F.lit("gold "), "ref").alias("title"))
    return gather.organised(n, gold).select("slug", F.array_join("refs", "|").alias("refs"), F.array_join("golds", "|", "-").alias("golds"))


_HITS = "SELECT event_id AS hit, event_type AS book, event_id % 500 AS s, event_id % 500 + 1 AS e, value AS score FROM events"
_CANDS = "SELECT p_partkey AS place, t.event_type AS book, p_partkey % 400 AS s, p_partkey % 400 + p_size AS e, p_partkey % 37 AS segment FROM part, (SELECT DISTINCT event_type FROM events) t"


def _hits(spark: SparkSession, d: str, keep: str) -> DataFrame:
    at = F.col("event_id") % 500
    hits = table(spark, d, "events").select(F.col("event_id").alias("hit"), F.col("event_type").alias("book"), at.alias("start"), (at + 1).alias("end"), F.col("value").alias("score"))
    s = F.col("p_partkey") % 400
    cands = table(spark, d, "part").join(hits.select("book").distinct()).select(F.col("p_partkey").alias("place"), "book", s.alias("start"), (s + F.col("p_size")).alias("end"), (F.col("p_partkey") % 37).alias("segment"))
    return gather.first_containing(hits, cands, keep)


_FIRST = f"WITH h AS ({_HITS}), c AS ({_CANDS}), f AS (SELECT hit, arg_min(segment, place) AS segment, min(score) AS score FROM h JOIN c ON h.book = c.book AND c.s <= h.s AND h.e <= c.e GROUP BY hit)"


@query(f"{_FIRST} SELECT segment, arg_min(hit, (-score, hit)) AS hit, max(score) AS score FROM f GROUP BY segment")
def best_hits(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "best")


@query(f"{_FIRST} SELECT segment, min(hit) AS hit, arg_min(score, hit) AS score FROM f GROUP BY segment")
def first_hits(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "first")


@query("""WITH r AS (SELECT event_id, event_id % 13 + 1 AS n, event_id % 5 AS a, event_id % 17 AS b, value > 5 AS held FROM events), x AS (SELECT *, greatest(1, least(a, n)) AS lo FROM r), y AS (SELECT *, greatest(lo, least(b, n)) AS hi FROM x),
z AS (SELECT *, CASE WHEN n = 1 THEN 'auto' WHEN NOT held THEN 'absent' WHEN hi - lo + 1 = n AND n >= 4 THEN 'unresolved' WHEN hi - lo + 1 > 7 THEN 'refine' ELSE 'picked' END AS how FROM y)
SELECT event_id, how, CASE WHEN how = 'auto' THEN 1 WHEN how IN ('picked', 'refine') THEN lo END AS low, CASE WHEN how = 'auto' THEN 1 WHEN how IN ('picked', 'refine') THEN hi END AS high FROM z""")
def resolved_refs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("n", F.col("event_id") % 13 + 1)
    out = gather.resolution(e, F.col("n") == 1, F.col("value") > 5, F.col("event_id") % 5, F.col("event_id") % 17, F.col("n"))
    return out.select("event_id", "how", F.col("low").cast("bigint").alias("low"), F.col("high").cast("bigint").alias("high"))


@query("SELECT l_orderkey || '.' || l_linenumber AS ref, p_name AS base_ref FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'N') LEFT JOIN part ON p_partkey = l_partkey AND p_size > 20")
def commentary_bases(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").where("l_returnflag = 'N'").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    c = c.select(F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("ref"), F.lit("part").alias("title"), F.col("l_partkey").alias("section"))
    return gather.section_links(c, table(spark, d, "part").where("p_size > 20").select(F.lit("part").alias("title"), F.col("p_partkey").alias("section"), F.col("p_name").alias("base_ref")))


@query("SELECT o_custkey AS ref, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'parallel' WHEN count(*) FILTER (o_orderpriority = '1-URGENT') > 0 THEN 'search' END AS how FROM orders GROUP BY o_custkey")
def ordered_strategies(spark: SparkSession, d: str) -> DataFrame:
    """The first strategy that gives an answer."""
    has = lambda c, name: F.when(F.count_if(c) > 0, F.lit(name))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("ref")).agg(F.coalesce(has(F.col("o_orderstatus") == "P", "parallel"), has(F.col("o_orderpriority") == "1-URGENT", "search")).alias("how"))


@query("SELECT page_id, starts_with(url, 'https://') OR length(html) > 2000 AS confirmed FROM pages")
def auto_confirmed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", (F.col("url").startswith("https://") | (F.length("html") > 2000)).alias("confirmed"))


@query("SELECT conv_id, turn, i, answer, coalesce(answer = '', true) AS missing FROM (SELECT conv_id, turn, unnest(range(greatest(len(string_split(text, chr(10))), 1))) AS i, unnest(string_split(text, chr(10))) AS answer FROM conversations)")
def question_answers(spark: SparkSession, d: str) -> DataFrame:
    """Nested answers as rows; blank ones are marked."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode_outer(F.split("text", "\n")).alias("i", "answer"))
    return c.select("conv_id", "turn", F.col("i").cast("bigint").alias("i"), "answer", F.coalesce(F.col("answer") == "", F.lit(True)).alias("missing"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, text, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE (starts_with(text, 'L') OR starts_with(text, 'T')) AND (before IS NULL OR before <> role)")
def pronoun_lint(spark: SparkSession, d: str) -> DataFrame:
    """Texts that begin like a back reference though what came before is another's."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("before", F.lag("role").over(w))
    return c.where(F.col("text").rlike("^[LT]") & (F.col("before").isNull() | (F.col("before") != F.col("role")))).select("conv_id", "turn")


@query("SELECT conv_id, string_agg(n || '. ' || line, chr(10) ORDER BY n) AS prompt FROM (SELECT conv_id, line, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS n FROM (SELECT conv_id, turn, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE role = 'user')) GROUP BY conv_id")
def flattened_questions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.split("text", "\n").alias("lines")))).alias("q"))
    lines = F.flatten(F.transform("q", lambda x: x["lines"]))
    return c.select("conv_id", F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n").alias("prompt"))


@query("""WITH RECURSIVE e(child, parent) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
t(root, slug) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region UNION SELECT 'world', 'world' UNION ALL SELECT root, child FROM t JOIN e ON parent = slug) SELECT root, slug FROM t""")
def tree_slugs(spark: SparkSession, d: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, r, c = (table(spark, d, t) for t in ("nation", "region", "customer"))
    edges = n.select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent")).union(r.select(key("r", "r_regionkey"), F.lit("world"))).union(c.select(key("c", "c_custkey"), key("n", "c_nationkey")))
    return gather.descendants(edges, r.select(key("r", "r_regionkey").alias("slug")).union(spark.createDataFrame([("world",)], "slug string")))


@query("""WITH e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation), h AS (SELECT c_custkey AS ref, 'r' || (c_custkey % 5) AS slug FROM customer UNION SELECT c_custkey, 'n' || c_nationkey FROM customer)
SELECT ref, slug FROM h WHERE slug IN (SELECT parent FROM e) AND NOT EXISTS (SELECT 1 FROM e JOIN h k ON k.slug = e.child WHERE e.parent = h.slug AND k.ref = h.ref)""")
def childless_slugs(spark: SparkSession, d: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    edges = table(spark, d, "nation").select(key("n", F.col("n_nationkey")).alias("child"), key("r", F.col("n_regionkey")).alias("parent"))
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("ref"), key("r", F.col("c_custkey") % 5).alias("slug")).union(c.select("c_custkey", key("n", F.col("c_nationkey")))).distinct()
    return gather.children_missing(edges, rows)


@query("SELECT s_suppkey AS slug, count(*) FILTER (l_discount > 0.05) AS good, count(*) FILTER (l_discount <= 0.05) AS bad FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def good_and_bad_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of each slug, split by a predicate: what is not good is bad."""
    li = table(spark, d, "supplier").join(table(spark, d, "lineitem"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.groupBy(F.col("s_suppkey").alias("slug")).agg(F.count_if(F.col("l_discount") > 0.05).alias("good"), F.count_if(F.col("l_discount") <= 0.05).alias("bad"))
