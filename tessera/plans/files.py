"""Queries on sources and sinks: whole tables written in a format and read back through the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import gather, ordering, spans
from ..session import new_path
from ..sources import readers, writers
from ..sources.collections import Collection
from .catalog import query, table

_DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@query("SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "json-lines")
    writers.json_lines(table(spark, d, "documents"), path)
    missing = readers.json_lines(spark, f"{path}-missing", _DOC)
    return readers.json_lines(spark, path, _DOC).unionByName(missing).select("doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars")


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 10 <> 3")
def json_lines_with_bad_ones(spark: SparkSession, d: str) -> DataFrame:
    """Blank and broken lines among the good ones are skipped."""
    path = new_path(spark, "json-bad")
    line = F.to_json(F.struct("doc_id", "lang"))
    rows = table(spark, d, "documents").select(F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("{broken "), line)).otherwise(F.concat(line, F.lit("\n"))).alias("value"))
    rows.write.text(path)
    return readers.json_lines(spark, path, "doc_id bigint, lang string", bad="DROPMALFORMED").where("doc_id is not null")


@query("SELECT doc_id AS ref, lang || '|' || source AS slugs FROM documents")
def labelled_refs(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "labelled")
    writers.json_lines(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("ref"), F.array("lang", "source").alias("slugs")), path)
    return readers.json_lines(spark, path, "ref string, slugs array<string>").select(F.col("ref").cast("bigint").alias("ref"), F.array_join("slugs", "|").alias("slugs"))


@query("SELECT n_name AS value, 3 AS n FROM nation")
def first_columns(spark: SparkSession, d: str) -> DataFrame:
    """The same values as CSV, as one JSON document and as JSON lines."""
    names, base = table(spark, d, "nation").select("n_name"), new_path(spark, "first")
    names.write.csv(f"{base}.csv")
    names.agg(F.collect_list("n_name").alias("items")).coalesce(1).write.json(f"{base}.json")
    names.select(F.array("n_name").alias("items")).write.json(f"{base}.jsonl")
    out = None
    for suffix in ("csv", "json", "jsonl"):
        one = readers.first_column(spark, f"{base}.{suffix}")
        out = one if out is None else out.unionAll(one)
    return out.groupBy("value").agg(F.count("*").cast("int").alias("n"))


@query("SELECT doc_id, md5(replace(text, chr(13), '')) AS digest FROM documents WHERE doc_id % 3 <> 0")
def uncurated_rows(spark: SparkSession, d: str) -> DataFrame:
    """CSV whose texts hold quotes, commas and line breaks; rows that are marked as done go."""
    path = new_path(spark, "curated")
    docs = table(spark, d, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\r"), F.lit("")).alias("text"), F.when(F.col("doc_id") % 3 == 0, "yes").otherwise(" ").alias("curated"))
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    got = readers.csv_rows(spark, path, "doc_id bigint, text string, curated string")
    return readers.uncurated(got).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query("SELECT n_regionkey AS type, string_agg(n_name, '|' ORDER BY n_name) AS questions, CAST(sum(CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS categories FROM nation GROUP BY n_regionkey")
def grouped_csv(spark: SparkSession, d: str) -> DataFrame:
    """Questions by type, with their categories as lists, null where there are none."""
    path = new_path(spark, "grouped")
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("type"), F.col("n_name").alias("question"), F.when(F.col("n_nationkey") % 2 == 0, "a,b").otherwise("").alias("cats"))
    n.write.option("header", True).csv(path)
    rows = readers.csv_rows(spark, path, "type int, question string, cats string")
    cats = readers.grouped(rows, "type", "cats", ",").select("type", F.size(F.flatten("values")).cast("bigint").alias("categories"))
    return readers.grouped(rows, "type", "question").select("type", F.array_join("values", "|").alias("questions")).join(cats, "type")


@query("SELECT lang AS key, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY lang")
def files_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Files whose path names their key."""
    path = new_path(spark, "by-key")
    table(spark, d, "documents").select("doc_id", "lang").write.partitionBy("lang").json(path)
    rows = readers.with_file_key(spark, f"{path}/*/*.json", r"lang=([a-z]+)/", "doc_id bigint")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM benchmark) AS queries, (SELECT count(*) FROM labels) AS qrels, 613 AS seed")
def dataset_dump(spark: SparkSession, d: str) -> DataFrame:
    """A dataset written with its manifest, of which the counts are read back."""
    path = new_path(spark, "dataset")
    docs, q, r = (table(spark, d, t) for t in ("documents", "benchmark", "labels"))
    writers.dump(docs, q, r, path, {"seed": 613})
    found = spark.read.json(f"{path}/metadata.json")
    kept = readers.json_lines(spark, f"{path}/documents.jsonl", _DOC).count()
    return found.where(F.col("documents") == kept).select("documents", "queries", "qrels", F.col("seed").cast("int").alias("seed"))


@query("SELECT doc_id, lang, NULL::VARCHAR AS title, n_chars FROM documents")
def fixed_columns(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "columns")
    writers.csv_columns(table(spark, d, "documents").select("n_chars", "lang", "doc_id"), path, ["doc_id", "lang", "title", "n_chars"])
    return readers.csv_rows(spark, path, "doc_id bigint, lang string, title string, n_chars bigint")


@query("SELECT n_name AS a_name, NULL::VARCHAR AS b_name, n_nationkey AS key FROM nation UNION ALL SELECT NULL, r_name, r_regionkey FROM region")
def union_of_columns(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "union")
    parts = [table(spark, d, "nation").select(F.col("n_name").alias("a_name"), F.col("n_nationkey").alias("key")), table(spark, d, "region").select(F.col("r_name").alias("b_name"), F.col("r_regionkey").alias("key"))]
    writers.csv_union(parts, path)
    return readers.csv_rows(spark, path, "a_name string, b_name string, key int")


@query("SELECT 'run' || k AS run_id, count(*) AS n, 0 AS undated FROM documents, (VALUES (1), (2)) v(k) WHERE doc_id % 2 = k % 2 GROUP BY k")
def appended_runs(spark: SparkSession, d: str) -> DataFrame:
    path, docs = new_path(spark, "runs"), table(spark, d, "documents")
    for k in (1, 2):
        writers.append_run(docs.where(F.col("doc_id") % 2 == k % 2).select("doc_id"), path, f"run{k}")
    return spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("written_at").isNull()).cast("int").alias("undated"))


@query("SELECT lang, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY lang")
def overwritten_collection(spark: SparkSession, d: str) -> DataFrame:
    """The second write takes the place of the first."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    held = Collection(spark, new_path(spark, "collection"), ["doc_id"], 8)
    held.replace(docs)
    held.replace(docs.where("lang <> 'en'"))
    return held.read().groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'changed' ELSE 'old' END AS origin, source FROM documents WHERE lang <> 'de'")
def changed_collection(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one language are upserted and those of another deleted; the rest is not written again."""
    docs = table(spark, d, "documents").select("doc_id", F.lit("old").alias("origin"), "source", "lang")
    held = Collection(spark, new_path(spark, "collection"), ["doc_id"], 8)
    held.replace(docs)
    held.upsert(docs.where("lang = 'en'").withColumn("origin", F.lit("changed")))
    held.delete(docs.where("lang = 'de'"))
    return held.read().select("doc_id", "origin", "source")


@query("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Person' ELSE role END, '|' ORDER BY turn) AS labels FROM conversations GROUP BY conv_id")
def relabelled_spans(spark: SparkSession, d: str) -> DataFrame:
    """One label is changed within the arrays of spans."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("start"), F.col("role").alias("label")))).alias("spans"))
    out = c.select("conv_id", spans.relabel(F.col("spans"), "user", "Person").alias("spans"))
    return out.select("conv_id", F.array_join(F.transform("spans", lambda s: s["label"]), "|").alias("labels"))


@query("SELECT n_regionkey AS region, '<table>' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || ' &amp; co</td></tr>', '' ORDER BY n_nationkey) || '</table>' AS html FROM nation GROUP BY n_regionkey")
def html_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), "n_nationkey", F.concat("n_name", F.lit(" & co")).alias("name"))
    return writers.html_table(rows, ["n_nationkey", "name"], "region")


@query("SELECT conv_id, max(text) FILTER (turn = 0) AS \"Option 1\", max(text) FILTER (turn = 1) AS \"Option 2\", max(text) FILTER (turn = 2) AS \"Option 3\" FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations) GROUP BY conv_id")
def option_columns(spark: SparkSession, d: str) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return writers.option_columns(table(spark, d, "conversations").groupBy("conv_id").agg(listed.alias("options")), "options", 3)


@query("SELECT doc_id, CASE WHEN lang <> 'en' THEN lang ELSE '' END AS only_a, CASE WHEN lang <> 'en' THEN 'en' ELSE '' END AS only_b, CASE WHEN lang = 'en' THEN 'en|' ELSE '' END || source AS common FROM documents")
def compared_sets(spark: SparkSession, d: str) -> DataFrame:
    """Two label sets side by side as what only one has and what both have."""
    a, b = F.array("lang", "source"), F.array(F.lit("en"), F.col("source"))
    return writers.set_comparison(table(spark, d, "documents").select("doc_id", a.alias("a"), b.alias("b")), "doc_id", "a", "b")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
def pushed_down_scan(spark: SparkSession, d: str) -> DataFrame:
    """A scan whose filter and columns reach the files."""
    return readers.scan(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"], (F.col("o_totalprice") > 300_000) & (F.col("o_orderstatus") == "F"))


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem")
def full_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.scan(spark, f"{d}/lineitem.parquet").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query("SELECT conv_id FROM conversations WHERE role = 'system' GROUP BY conv_id")
def rows_with_element(spark: SparkSession, d: str) -> DataFrame:
    """Rows one of whose spans fulfils a condition."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("role").alias("type"), (F.col("turn") >= 0).alias("ambiguous"))).alias("spans"))
    return readers.with_element(c, "spans", lambda s: s["ambiguous"] & (s["type"] == "system")).select("conv_id")


@query("SELECT DISTINCT text FROM conversations WHERE role = 'user'")
def distinct_span_texts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", "text")).alias("spans"))
    return spans.sub_spans_distinct(c, "spans", lambda s: s["role"] == "user")


@query("SELECT page_id, 'l' || i AS a, 'r' || page_id AS b FROM pages, (VALUES (0), (1)) v(i) WHERE page_id % 4 <> 0")
def fetched_links(spark: SparkSession, d: str) -> DataFrame:
    """Landed answers of a service: those that are no list go, links are put into one form."""
    link = lambda i: F.concat(F.lit(f'{{"refs": ["l{i}", "r'), F.col("page_id").cast("string"), F.lit('"]}'))
    body = F.when(F.col("page_id") % 4 == 0, F.lit('{"error": "none"}')).otherwise(F.concat(F.lit("["), link(0), F.lit(", "), link(1), F.lit("]")))
    return readers.service_links(table(spark, d, "pages").select("page_id", body.alias("body")), "page_id", "body")


@query("SELECT page_id, trim(array_to_string(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))), ' ')) AS text FROM pages")
def paragraph_texts(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs of fetched pages."""
    return table(spark, d, "pages").select("page_id", readers.paragraphs("html").alias("text"))


@query("SELECT source AS ref, coalesce(max(text) FILTER (lang = 'en' AND n = 1), max(text) FILTER (lang = 'fr' AND n = 1)) AS text FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents WHERE lang IN ('en', 'fr')) GROUP BY source")
def author_segments(spark: SparkSession, d: str) -> DataFrame:
    """The first text of a reference in one language, or else in the other."""
    rows = table(spark, d, "documents").select(F.col("source").alias("ref"), F.col("doc_id").alias("order_id"), "lang", "text")
    return readers.first_in_language(rows, ["en", "fr"])


@query("SELECT doc_id FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE lang = 'de')")
def not_on_disk(spark: SparkSession, d: str) -> DataFrame:
    """What has no file yet."""
    path, docs = new_path(spark, "done"), table(spark, d, "documents")
    docs.where("lang = 'de'").select("source").distinct().write.json(path)
    return gather.without_known(docs, readers.json_lines(spark, path, "source string"), ["source"]).select("doc_id")


@query("SELECT c_custkey AS ref, c_name AS translation FROM customer WHERE c_nationkey <> 3")
def new_translations(spark: SparkSession, d: str) -> DataFrame:
    """Translations from CSV files by title; titles that are there already are left out."""
    path = new_path(spark, "translations")
    c = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("ref"), F.col("c_name").alias("translation"))
    c.write.partitionBy("c_nationkey").option("header", True).csv(path)
    rows = spark.read.option("header", True).schema("ref bigint, translation string, c_nationkey int").csv(path)
    return gather.without_known(rows, spark.createDataFrame([(3,)], "c_nationkey int"), ["c_nationkey"]).select("ref", "translation")


@query("SELECT doc_id, CASE WHEN n_chars > 200 THEN n_chars END AS n FROM documents")
def typed_csv(spark: SparkSession, d: str) -> DataFrame:
    """Empty fields of typed CSV are null."""
    path = new_path(spark, "typed")
    table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 200, F.col("n_chars")).alias("n")).write.option("header", True).option("emptyValue", "").csv(path)
    return readers.csv_rows(spark, path, "doc_id bigint, n bigint")


@query("SELECT c_custkey AS ref, c_mktsegment AS section FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':4'), c_custkey) AS n FROM customer) WHERE n <= 3")
def random_sections(spark: SparkSession, d: str) -> DataFrame:
    """Some rows of every section, written as CSV."""
    path = new_path(spark, "sections")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("ref"), F.col("c_mktsegment").alias("section"))
    writers.csv_columns(ordering.sample_per(rows, ["section"], "ref", 3, 4), path, ["ref", "section"])
    return readers.csv_rows(spark, path, "ref bigint, section string")


@query("SELECT doc_id, lang || '/' || source AS row FROM documents WHERE lang IN ('en', 'fr')")
def checked_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels outside a map are an error; those within are put in."""
    docs = table(spark, d, "documents").where("lang in ('en', 'fr')")
    return docs.select("doc_id", F.concat_ws("/", arrays.map_label(F.col("lang"), {"en": "en", "fr": "fr"}, True), F.col("source")).alias("row"))
