"""Queries on the relational core: joins, aggregates, windows, samples and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, text, vector
from ..operators import intervals, ordering, spans
from ..session import dealt
from ..sources import readers, writers
from .catalog import query, table


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'en' AND source NOT IN (SELECT DISTINCT source FROM documents WHERE lang = 'en' AND doc_id % 5 = 0)")
def anti_lang_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    english = docs.where("lang = 'en' and doc_id % 5 = 0").select("source").distinct()
    return docs.where("lang <> 'en'").join(english, "source", "left_anti").select("doc_id", "lang")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def inverse_list(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels")
    return table(spark, d, "documents").select("doc_id").join(lab.where("quality = 1"), "doc_id", "left_anti").join(lab.where("toxic = 1"), "doc_id", "left_anti")


@query("SELECT o_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(*) = max(l_linenumber)")
def composite_join(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.max("l_linenumber").alias("last")).where("n = last")
    return table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "n", "total")


@query("SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS a, greatest(a.l_partkey, b.l_partkey) AS b FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey AND a.l_returnflag = 'R' AND b.l_returnflag = 'R'")
def pair_links(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    both = li.join(li.withColumnRenamed("l_partkey", "other"), "l_orderkey").where("l_partkey < other")
    return both.select(F.col("l_partkey").alias("a"), F.col("other").alias("b")).distinct()


_WORDS = "len(list_filter(regexp_split_to_array(trim(text, ' '), '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> ''))"


@query(f"""WITH w AS (SELECT doc_id AS id, lang AS category, {_WORDS} AS words FROM documents), s AS (SELECT *, greatest(8, CAST(round_even(words * 0.15, 0) AS INT)) AS slack FROM w WHERE id % 20 = 0),
b AS (SELECT s.id AS seed_id, w.id, w.category, s.words AS seed_words, w.words, row_number() OVER (PARTITION BY s.id ORDER BY abs(w.words - s.words), w.id) AS place
FROM s JOIN w ON s.category = w.category AND s.id <> w.id AND w.words BETWEEN greatest(1, s.words - slack) AND s.words + slack)
SELECT seed_id, id, category, CAST(seed_words AS INT) AS seed_words, CAST(words AS INT) AS words, CAST(place AS INT) AS place FROM b WHERE place <= 10""")
def confounder_band(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), text.word_count(F.col("text")).alias("words"))
    return intervals.matched_controls(rows.where("id % 20 = 0"), rows)


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3")
def category_cap(spark: SparkSession, d: str) -> DataFrame:
    return ordering.cap_per(table(spark, d, "documents").select("doc_id", "source"), ["source"], [F.col("doc_id")], 3)


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1")
def first_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return ordering.first_per(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], [F.desc("n_chars"), F.asc("doc_id")]).drop("n_chars")


@query("""WITH e AS (SELECT avg(n_chars) + 2 * stddev_samp(n_chars) AS edge FROM documents), t AS (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 3)
SELECT doc_id, n_chars FROM (SELECT *, min((n_chars > edge)::INT) OVER (ORDER BY n_chars DESC, doc_id) AS ok FROM t, e) WHERE ok = 1""")
def take_while_primary(spark: SparkSession, d: str) -> DataFrame:
    return ordering.take_while_above(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query("""WITH s AS (SELECT c_nationkey AS key, count(*) AS n FROM customer GROUP BY 1), a AS (SELECT count(*) AS c, sum(n) AS t FROM s)
SELECT s.key, s.n FROM s WHERE (SELECT count(*) FROM s o WHERE o.key <> s.key) >= 2 AND s.n > (SELECT avg(o.n) + 3 * stddev_samp(o.n) FROM s o WHERE o.key <> s.key)""")
def large_clusters(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("n"))
    return ordering.large_groups(sizes, "key", "n")


@query("SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || ':613'), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return ordering.sample_n(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 50, 613)


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':613'), doc_id) AS n FROM documents) WHERE n <= 2")
def seeded_choice(spark: SparkSession, d: str) -> DataFrame:
    return ordering.sample_per(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 2, 613)


@query("SELECT doc_id, n_chars FROM (SELECT *, sum(n_chars) OVER (ORDER BY md5(doc_id || ':7'), doc_id) AS run FROM documents) WHERE run <= 200000")
def sample_to_size(spark: SparkSession, d: str) -> DataFrame:
    return ordering.sample_to_size(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 200_000, 7)


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(doc_id || ':613'), 1, 8) AS BIGINT) / 4294967296.0 < 0.9 THEN 'train' ELSE 'validation' END AS split FROM documents")
def train_split(spark: SparkSession, d: str) -> DataFrame:
    return ordering.split_rows(table(spark, d, "documents").select("doc_id"), "doc_id", 0.9, 613)


@query("""WITH n AS (SELECT min(c) AS k FROM (SELECT count(*) AS c FROM documents WHERE lang IN ('de', 'es', 'fr') GROUP BY lang)),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':1'), doc_id) AS p FROM documents WHERE lang IN ('de', 'es', 'fr')) SELECT doc_id, lang FROM r, n WHERE p <= k""")
def balanced_concat(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return ordering.balanced([docs.where(F.col("lang") == x) for x in ("de", "es", "fr")], "doc_id", 1).drop("input")


@query("""WITH m AS (SELECT user_id, event_id, ts, (date_diff('microsecond', lag(ts) OVER w, ts) > 600000000)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_event FROM i GROUP BY user_id, island""")
def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return ordering.islands(ev, ["user_id"], "at", 600_000_000).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT event_type, count(*) AS calls, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS tokens, CAST(max(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS most FROM events GROUP BY event_type")
def usage_by_model(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(k).alias("tokens"), F.max(k).alias("most"))


@query("""WITH l AS (SELECT l_orderkey AS g, l_linenumber AS i, l_quantity AS lv, l_extendedprice / 100 AS tk FROM lineitem),
p AS (SELECT g, i, round_even(lv * 100.0 / sum(lv) OVER (PARTITION BY g) * least(1.0, tk / 1500.0), 2) AS p FROM l)
SELECT g AS l_orderkey, count(*) AS n, round(sum(p), 1) AS total FROM p GROUP BY g HAVING sum(p) > 99.5""")
def score_percentages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("level"), (F.col("l_extendedprice") / 100).alias("tokens"))
    w = Window.partitionBy("l_orderkey")
    p = F.bround(F.col("level") * 100.0 / F.sum("level").over(w) * F.least(F.lit(1.0), F.col("tokens") / 1500.0), 2)
    return rows.withColumn("p", p).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("p"), 1).alias("total"), F.sum("p").alias("s")).where("s > 99.5").drop("s")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS lv, l_extendedprice / 100 AS tk FROM lineitem), p AS (SELECT l_orderkey, l_linenumber, round_even(lv * 100.0 / sum(lv) OVER (PARTITION BY l_orderkey) * least(1.0, tk / 1500.0), 2) AS p FROM l)
SELECT l_orderkey, l_linenumber, round_even(p * 100.0 / CASE WHEN sum(p) OVER w = 0 THEN 1 ELSE round(sum(p) OVER w, 6) END, 2) AS percentage FROM p WINDOW w AS (PARTITION BY l_orderkey)""")
def score_percentages_full(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("level"), (F.col("l_extendedprice") / 100).alias("tokens"))
    return ordering.percentages(rows, "l_orderkey", "level", "tokens").select("l_orderkey", "l_linenumber", "percentage")


@query("SELECT lang, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY lang")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("t")))).select("lang", "n", F.round(F.col("n") * 100.0 / F.col("t"), 6).alias("percent"))


@query("SELECT source, array_to_string(list(doc_id ORDER BY doc_id), ',') AS refs, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY source")
def refs_by_category(spark: SparkSession, d: str) -> DataFrame:
    refs = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return table(spark, d, "documents").groupBy("source").agg(refs.alias("refs"), F.count("*").alias("n"), F.max("n_chars").alias("longest"))


@query("SELECT sha256(text) AS text_key, count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("text_key")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, count(*) AS n_queries, count(*) FILTER (l.doc_id IS NOT NULL) AS judged, bool_or(coalesce(toxic, 0) = 1) AS any_toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def ref_summaries(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").join(table(spark, d, "labels").withColumn("has", F.lit(True)), "doc_id", "left")
    return both.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.count("*").alias("n_queries"), F.count("has").alias("judged"), F.bool_or(F.coalesce("toxic", F.lit(0)) == 1).alias("any_toxic"))


@query("""SELECT n_nationkey, coalesce(bool_and(c_acctbal > -900), true) AS all_good, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' GROUP BY n_nationkey""")
def all_of_topic(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    both = table(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return both.groupBy("n_nationkey").agg(F.coalesce(F.bool_and(F.col("c_acctbal") > -900), F.lit(True)).alias("all_good"), F.count("c_custkey").alias("n"))


@query("SELECT o_custkey, round(max(o_totalprice), 2) AS top, round(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*)) AS mean_cents, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '') AS states FROM orders GROUP BY o_custkey HAVING count(*) >= 5")
def passage_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.max("o_totalprice"), 2).alias("top"), F.round(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / F.count("*")).alias("mean_cents"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "").alias("states"), F.count("*").alias("n"))
    return g.where("n >= 5").drop("n")


@query("SELECT source, max_by(lang, doc_id) AS lang, count(*) AS n FROM documents GROUP BY source")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.max_by("lang", "doc_id").alias("lang"), F.count("*").alias("n"))


@query("""SELECT field, array_to_string(list_sort(list(DISTINCT value)), ',') AS range FROM (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY field""")
def metadata_ranges(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "documents").select("lang", "source").unpivot([], ["lang", "source"], "field", "value")
    return long.groupBy("field").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("range"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1' UNION ALL SELECT doc_id FROM documents WHERE n_chars > 5000")
def bag_union(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where("lang = 'en' and source = 'src1'").select("doc_id").unionAll(docs.where("n_chars > 5000").select("doc_id"))


@query("(SELECT 'only_1' AS side, source FROM (SELECT source FROM documents WHERE lang = 'es' EXCEPT SELECT source FROM documents WHERE doc_id % 9 = 0)) UNION ALL (SELECT 'only_2', source FROM (SELECT source FROM documents WHERE doc_id % 9 = 0 EXCEPT SELECT source FROM documents WHERE lang = 'es'))")
def symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    a, b = docs.where("lang = 'es'").select("source"), docs.where("doc_id % 9 = 0").select("source")
    return a.subtract(b).select(F.lit("only_1").alias("side"), "source").union(b.subtract(a).select(F.lit("only_2"), "source"))


@query("""WITH r AS (SELECT l_suppkey AS book, l_partkey AS start, l_partkey + CAST(l_quantity AS BIGINT) AS "end", l_orderkey * 10 + l_linenumber AS ref FROM lineitem WHERE l_returnflag = 'R'),
t AS (SELECT ps.l_suppkey AS book, l_partkey - 5 AS start, l_partkey + 60 AS "end", l_orderkey * 10 + l_linenumber AS ref FROM lineitem ps WHERE l_returnflag = 'A')
SELECT t.ref AS outer_ref, r.ref AS inner_ref FROM t JOIN r ON t.book = r.book AND t.start <= r.start AND r."end" <= t."end" """)
def containment(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("book"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), "l_returnflag")
    inner = li.where("l_returnflag = 'R'").drop("l_returnflag")
    outer = li.where("l_returnflag = 'A'").select("book", (F.col("start") - 5).alias("start"), (F.col("start") + 60).alias("end"), "ref")
    return intervals.containment_join(outer, inner).select(F.col("a_ref").alias("outer_ref"), F.col("b_ref").alias("inner_ref"))


_R = 'SELECT l_suppkey AS book, l_partkey AS start, l_partkey + CAST(l_quantity AS BIGINT) AS "end", l_orderkey * 10 + l_linenumber AS ref FROM lineitem'


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """References that are named once."""
    first = [F.min(c).alias(c) for c in ("book", "start", "end")]
    return _all_refs(spark, d).groupBy("ref").agg(*first, F.count("*").alias("n")).where("n = 1").drop("n")


@query(f"""WITH r AS (SELECT ref, min(book) AS book, min(start) AS start, min("end") AS "end" FROM ({_R}) GROUP BY ref HAVING count(*) = 1) SELECT a.ref FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.book = b.book AND a.ref <> b.ref AND a.start <= b.start AND b."end" <= a."end" AND (b."end" - b.start < a."end" - a.start OR b.ref < a.ref))""")
def nested_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return intervals.drop_containing(_refs(spark, d)).select("ref")


def _all_refs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("book"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"))


@query(f"""WITH r AS ({_R}), m AS (SELECT *, (start - max("end") OVER (PARTITION BY book ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 2)::INT AS new FROM r),
i AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY book ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM m) SELECT book, min(start) AS start, max("end") AS "end", count(*) AS n FROM i GROUP BY book, i""")
def merge_close(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge_close(_all_refs(spark, d), 2)


@query(f"""WITH r AS (SELECT ref, min(book) AS book, min(start) AS start, min("end") AS "end" FROM ({_R}) GROUP BY ref HAVING count(*) = 1) SELECT ref FROM r WHERE NOT EXISTS (SELECT 1 FROM (SELECT l_suppkey AS book, l_partkey AS s, l_partkey + 3 AS e FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08) o WHERE o.book = r.book AND r.start <= o.e AND o.s <= r."end")""")
def free_of_overlap(spark: SparkSession, d: str) -> DataFrame:
    taken = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_discount > 0.08").select(F.col("l_suppkey").alias("book"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 3).alias("end"))
    return intervals.without_overlap(_refs(spark, d), taken).select("ref")


_SPANS = "SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]{2,}'))) AS ref FROM documents"


@query(f"SELECT doc_id, count(*) AS refs, count(*) FILTER (length(ref) >= 8) AS long_refs, array_to_string(list(ref ORDER BY ref), '|') AS listed FROM ({_SPANS}) GROUP BY doc_id")
def span_refs(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{2,}"), 0))).alias("ref"))
    return own.groupBy("doc_id").agg(F.count("*").alias("refs"), F.count_if(F.length("ref") >= 8).alias("long_refs"), F.array_join(F.array_sort(F.collect_list("ref")), "|").alias("listed"))


@query("SELECT event_type AS ref, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id) AS n FROM events) WHERE n = 1")
def span_group_dedupe(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select(F.col("event_type").alias("ref"), "event_id", "value")
    return spans.dedupe_candidates(ev, "ref", "value", "event_id")


@query("""WITH a AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]{2,}')) AS x, list_distinct(regexp_extract_all(text, '[0-9]{4,}')) AS y FROM documents)
SELECT CAST(sum(len(list_intersect(x, y))) AS BIGINT) AS common, CAST(sum(len(x)) AS BIGINT) AS total, round(sum(len(list_intersect(x, y))) / sum(len(x)), 6) AS accuracy FROM a""")
def span_diff_accuracy(spark: SparkSession, d: str) -> DataFrame:
    hits = lambda p: F.array_distinct(F.regexp_extract_all("text", F.lit(p), 0)).alias("spans")
    docs = table(spark, d, "documents")
    out = spans.diff_accuracy(docs.select("doc_id", hits("[0-9]{2,}")), docs.select("doc_id", hits("[0-9]{4,}")), ["doc_id"])
    return out.select(F.col("common").cast("bigint").alias("common"), F.col("total").cast("bigint").alias("total"), F.round("accuracy", 6).alias("accuracy"))


@query("""SELECT conv_id, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS own, round(sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) / greatest(sum(length(text)), 1), 6) AS creativity FROM conversations GROUP BY conv_id""")
def creativity(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("n", F.length("text"))
    return c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("own"), F.round(F.sum(F.when(F.col("role") == "user", F.col("n")).otherwise(0)) / F.greatest(F.sum("n"), F.lit(1)), 6).alias("creativity"))


@query("""SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'user') AS own, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY conv_id""")
def text_views(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    join = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("turn", "text")))), lambda x: x["text"]), "\n\n")
    g = c.groupBy("conv_id").agg(join(F.col("role") == "user").alias("own"), join(F.lit(True)).alias("whole"), F.count_if(F.col("role") == "user").alias("n"))
    return g.select("conv_id", F.when(F.col("n") > 0, F.col("own")).alias("own"), "whole")


@query("SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS before FROM conversations")
def context_of_turn(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lead("role").over(w).alias("next_role"), F.coalesce(F.lag(F.length("text")).over(w), F.lit(-1)).cast("bigint").alias("before"))


_ROUNDS = 10
_RANKS = ", ".join(f"r{i + 1} AS (SELECT dst AS node, 0.15 / max(k) + 0.85 * sum(r / n) AS r FROM e JOIN r{i} ON e.src = r{i}.node JOIN g ON g.src = e.src, k GROUP BY dst)" for i in range(_ROUNDS))


@query(f"""WITH t AS (SELECT DISTINCT o_custkey AS src, l_partkey + 1000000 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey), e AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t),
g AS (SELECT src, count(*) AS n FROM e GROUP BY src), k AS (SELECT count(*) AS k FROM g), r0 AS (SELECT src AS node, 1.0::DOUBLE / k AS r FROM g, k), {_RANKS} SELECT node, round(r * 1000, 6) AS rank FROM r{_ROUNDS}""")
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import cluster

    t = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst"))
    return cluster.page_rank(t.union(t.select("dst", "src"))).select("node", F.round(F.col("rank") * 1000, 6).alias("rank"))


@query("""WITH p AS (SELECT o_custkey AS problem, o_orderkey AS ranking, l_partkey % 12 AS item, min(l_linenumber) AS pos FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
q AS (SELECT problem, ranking, item, row_number() OVER (PARTITION BY ranking ORDER BY pos, item) - 1 AS i, count(*) OVER (PARTITION BY ranking) AS n FROM p)
SELECT problem, item, sum((i < n - 1)::INT) + 1.5::DOUBLE AS shape, sum(least(i + 1, n - 1)) + 1.0::DOUBLE AS rate FROM q GROUP BY problem, item""")
def pl_sufficient_stats(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import ranking

    return ranking.sufficient_statistics(_rankings(spark, d), rows=_lines(spark, d))


def _rankings(spark: SparkSession, d: str) -> DataFrame:
    """Each order ranks its items for its customer. Orders and lines are dealt once, by order, into tasks of a bounded number of lines."""
    lines, n = table(spark, d, "lineitem"), _lines(spark, d)
    orders = dealt(table(spark, d, "orders").select("o_custkey", "o_orderkey"), n, "o_orderkey")
    li = dealt(lines.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 12).alias("item")), n, "l_orderkey")
    p = orders.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey", "item").agg(F.min("l_linenumber").alias("pos"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"])
    return p.groupBy(F.col("o_custkey").alias("problem"), F.col("o_orderkey").alias("ranking")).agg(items.alias("items"))


def _lines(spark: SparkSession, d: str) -> int:
    return table(spark, d, "lineitem").count()


@query("SELECT user_id, event_id % 2 AS side, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value > 10 GROUP BY ALL")
def threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").where(F.col("value") > 10)
    return ev.groupBy("user_id", (F.col("event_id") % 2).alias("side")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming import events

    return events.windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5)")
def slice_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code, CAST(floor((c_acctbal + 1000) / 1100) AS BIGINT) AS decile FROM customer")
def factor_codes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    names = c.select("c_mktsegment").distinct().withColumn("code", (F.dense_rank().over(Window.orderBy("c_mktsegment")) - 1).cast("bigint"))
    return c.join(F.broadcast(names), "c_mktsegment").select("c_custkey", "c_mktsegment", "code", F.floor((F.col("c_acctbal") + 1000) / 1100).alias("decile"))


@query("""WITH v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), k AS (SELECT *, greatest(1, CAST(floor(n * 0.8) AS BIGINT)) AS k FROM v),
b AS (SELECT a.user_id, a.value AS low, h.value AS high FROM k a JOIN k h ON a.user_id = h.user_id AND h.i = a.i + a.k) SELECT user_id, min({'w': high - low, 'low': low, 'high': high}).low AS low, min({'w': high - low, 'low': low, 'high': high}).high AS high FROM b GROUP BY user_id""")
def densest_interval(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import ranking

    return ranking.densest_interval(table(spark, d, "events").select("user_id", "value"), ["user_id"], "value", 0.8)


@query("""WITH s AS (SELECT user_id AS problem, event_id % 40 AS draw, event_id % 5 AS item, avg(value) / 50 AS score FROM events GROUP BY ALL), p AS (SELECT a.problem, a.item AS a, b.item AS b, 1 / (1 + exp(-(a.score - b.score))) AS p FROM s a JOIN s b ON a.problem = b.problem AND a.draw % 8 = b.draw % 8 AND a.item < b.item)
SELECT problem, a, b, round(count(*), 0) AS n FROM p GROUP BY ALL""")
def draw_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("problem"), (F.col("event_id") % 40).alias("draw"), (F.col("event_id") % 5).alias("item")).agg((F.avg("value") / 50).alias("score"))
    a, b = s.select("problem", (F.col("draw") % 8).alias("g"), F.col("item").alias("a")), s.select("problem", (F.col("draw") % 8).alias("g"), F.col("item").alias("b"))
    return a.join(b, ["problem", "g"]).where("a < b").groupBy("problem", "a", "b").agg(F.count("*").cast("double").alias("n"))


@query("""WITH s AS (SELECT user_id AS problem, event_id % 5 AS item, ntile_ AS draw, score FROM (SELECT user_id, event_id, event_id // 5 AS ntile_, value / 50 AS score FROM events)),
p AS (SELECT problem, a.item AS a, b.item AS b, greatest(1e-9, least(1 - 1e-9, 1 / (1 + exp(b.score - a.score)))) AS p FROM s a JOIN s b USING (problem, draw) WHERE a.item < b.item),
m AS (SELECT problem, a, b, avg(p) AS q, avg(-(p * ln(p) + (1 - p) * ln(1 - p))) AS h FROM p GROUP BY ALL) SELECT problem, a, b, round(-(q * ln(q) + (1 - q) * ln(1 - q)) - h, 6) AS utility FROM m""")
def pairwise_mi(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import ranking

    s = table(spark, d, "events").select(F.col("user_id").alias("problem"), F.expr("event_id div 5").alias("draw"), (F.col("event_id") % 5).alias("item"), (F.col("value") / 50).alias("score"))
    return ranking.pair_utilities(s).withColumn("utility", F.round("utility", 6))


@query("""WITH s AS (SELECT user_id AS problem, event_id // 5 AS draw, event_id % 5 AS item, value AS score FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY problem, draw ORDER BY score DESC, item) AS n FROM s) SELECT problem, item, round(avg((n = 1)::INT), 6) AS share FROM r GROUP BY problem, item""")
def best_share(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import ranking

    s = table(spark, d, "events").select(F.col("user_id").alias("problem"), F.expr("event_id div 5").alias("draw"), (F.col("event_id") % 5).alias("item"), F.col("value").alias("score"))
    return ranking.best_share(s).withColumn("share", F.round("share", 6))


@query("""WITH m AS (SELECT 'status' AS factor, o_orderstatus AS level, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, avg(o_totalprice), count(*) FROM orders GROUP BY 2) SELECT factor, level, round(m - avg(m) OVER (PARTITION BY factor), 4) AS effect, n FROM m""")
def main_effects(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import ranking

    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    return ranking.main_effects(o, ["status", "priority"], "o_totalprice").withColumn("effect", F.round("effect", 4))


@query("SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(list_concat([lang, source], ['extra'])), lambda x: x <> 'en')), ',') AS labels FROM documents")
def final_labels(spark: SparkSession, d: str) -> DataFrame:
    out = arrays.final_labels(F.array("lang", "source"), F.array(F.lit("extra")), F.array(F.lit("en")))
    return table(spark, d, "documents").select("doc_id", F.array_join(out, ",").alias("labels"))


@query("SELECT doc_id, len(list_filter(string_split(lang || '$$' || source || '$', '$'), lambda x: x <> ''))::INT AS n FROM documents")
def unpack_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(arrays.unpack(F.concat(F.col("lang"), F.lit("$$"), F.col("source"), F.lit("$")))).alias("n"))


@query("SELECT doc_id, sha256('m|64|doc|' || sha256(text)) AS key FROM documents")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", vector.cache_key("m", 64, "doc", F.col("text")).alias("key"))


@query("SELECT source, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS origin, doc_id FROM documents")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    old = docs.select("source", F.lit("old").alias("origin"), "doc_id")
    return writers.upsert(old, docs.where("doc_id % 2 = 0").select("source", F.lit("new").alias("origin"), "doc_id"), ["doc_id"]).select("source", "origin", "doc_id")


@query("""SELECT conv_id, CAST(turn + 1 AS BIGINT) AS index, length(text) AS n FROM conversations WHERE trim(text) <> ''""")
def segments(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("parts"))
    return readers.segments(c, "parts", "conv_id").select("conv_id", F.col("index").cast("bigint").alias("index"), F.length("text").cast("bigint").alias("n"))


@query("SELECT doc_id, CASE WHEN n_all <= 90 OR n >= n_all - 80 THEN -1 ELSE n // 80 END AS chunk FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, count(*) OVER (PARTITION BY source) AS n_all FROM documents)")
def ref_chunks(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import chunking

    own = Window.partitionBy("source")
    place, n = F.row_number().over(own.orderBy("doc_id")) - 1, F.count("*").over(own)
    return table(spark, d, "documents").select("doc_id", place.alias("n"), n.alias("n_all")).select("doc_id", chunking.ref_chunks(F.col("n_all"), F.col("n")).alias("chunk"))
