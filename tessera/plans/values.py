"""Queries on single values: text, number, array and map functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, text, vector
from ..operators import gather
from .catalog import query, table

_SHIN, _POINTED = "ש", "שָ"


@query(f"SELECT doc_id, md5(replace(text, 'a', '{_SHIN}')) AS digest FROM documents")
def strip_points(spark: SparkSession, d: str) -> DataFrame:
    """Every a becomes a pointed letter; without points the bare letter is left."""
    pointed = F.replace(F.col("text"), F.lit("a"), F.lit(_POINTED))
    return table(spark, d, "documents").select("doc_id", F.md5(text.strip_diacritics(pointed)).alias("digest"))


@query(f"SELECT doc_id, md5(nfc_normalize(replace(text, 'a', '{_SHIN}'))) AS digest FROM documents")
def strip_marks(spark: SparkSession, d: str) -> DataFrame:
    pointed = F.replace(F.col("text"), F.lit("a"), F.lit(_POINTED))
    return table(spark, d, "documents").select("doc_id", F.md5(text.strip_marks(pointed)).alias("digest"))


@query("SELECT page_id, unnest(x) AS item, unnest(range(len(x)))::INT AS place FROM (SELECT page_id, regexp_extract_all(replace(html, chr(10), ' '), '<li>(.+?)</li>', 1) AS x FROM pages)")
def xml_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.posexplode(text.xml_list(F.col("html"), "li")).alias("place", "item"))


@query("""SELECT doc_id, '{"a": "' || source || '-\\"' || lang || '\\"-x", "b": "y"}' AS fixed FROM documents""")
def escape_quotes(spark: SparkSession, d: str) -> DataFrame:
    broken = F.concat(F.lit('{"a": "'), "source", F.lit('-"'), "lang", F.lit('"-x", "b": "y"}'))
    return table(spark, d, "documents").select("doc_id", text.escape_inner_quotes(broken).alias("fixed"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS n, CASE WHEN doc_id % 5 <> 0 THEN lang END AS s FROM documents")
def fenced_json(spark: SparkSession, d: str) -> DataFrame:
    """Fenced, bare and broken answers."""
    body = F.concat(F.lit('{"n": '), F.col("doc_id").cast("string"), F.lit(', "s": "'), "lang", F.lit('"}'))
    said = F.when(F.col("doc_id") % 5 == 0, F.lit("{broken")).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    got = text.fenced_json(said, "n bigint, s string")
    return table(spark, d, "documents").select("doc_id", got["n"].alias("n"), got["s"].alias("s"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN '[' || doc_id || ', 2]' END AS found FROM documents")
def first_array(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 4 == 0, F.lit("nothing")).otherwise(F.concat(F.lit("so [") , F.col("doc_id").cast("string"), F.lit(", 2] and [3]")))
    return table(spark, d, "documents").select("doc_id", text.first_array(said).alias("found"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '2,0,1' WHEN 1 THEN '0,1,2' END AS ranks FROM documents")
def parse_ranking(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 3 == 0, "```\n[2, 0, 1]\n```").when(F.col("doc_id") % 3 == 1, "[0,1,2]").otherwise("[0, 0, 1]")
    return table(spark, d, "documents").select("doc_id", F.array_join(text.parse_ranking(said, 3).cast("array<string>"), ",").alias("ranks"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id WHEN 1 THEN 4 END AS low, CASE doc_id % 3 WHEN 0 THEN doc_id + 2 WHEN 1 THEN 8 END AS high FROM documents")
def parse_range(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    said = F.when(n % 3 == 0, F.concat(F.lit("7 of them. range: "), n.cast("string"), F.lit(", "), (n + 2).cast("string"))).when(n % 3 == 1, "from 4 to 8, 9 at most").otherwise("none")
    got = text.parse_range(said)
    return table(spark, d, "documents").select("doc_id", got[0].cast("bigint").alias("low"), got[1].cast("bigint").alias("high"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\pL\\pN\\pM_]+'))::INT AS tokens FROM documents")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.token_count(F.col("text")).alias("tokens"))


@query("SELECT conv_id, turn, len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''))::INT AS n FROM conversations")
def sentences_by_language(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.size(text.split_by_language(F.col("text"), F.lit("en"))).alias("n"))


@query("SELECT doc_id, 'I. ' || lang AS one, 'XIV. ' || source AS two FROM documents")
def rejoin_numerals(spark: SparkSession, d: str) -> DataFrame:
    parts = text.rejoin_numerals(F.array(F.lit("I."), "lang", F.lit("XIV."), "source"))
    return table(spark, d, "documents").select("doc_id", parts.alias("p")).select("doc_id", F.col("p")[0].alias("one"), F.col("p")[1].alias("two"))


@query('SELECT item_id, CAST(strpos(text, substr(text, 11, 8)) - 1 AS INT) AS "offset", 1.0::DOUBLE AS ratio FROM benchmark')
def fuzzy_offset(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id", text.best_substring(F.col("text"), F.substring("text", 11, 8)).alias("m"))
    return b.select("item_id", "m.offset", "m.ratio")


@query('SELECT doc_id, 2 AS start, 2 AS "end", \'#\' AS text FROM documents UNION ALL SELECT doc_id, 2 + length(source), 3 + length(source), \'\' FROM documents')
def edit_spans(spark: SparkSession, d: str) -> DataFrame:
    """A mark put in after the language, and one taken away at the end."""
    e = text.edits(F.concat("lang", "source", F.lit("~")), F.concat("lang", F.lit("#"), "source"))
    return table(spark, d, "documents").select("doc_id", F.explode(e).alias("e")).select("doc_id", "e.start", "e.end", "e.text")


@query('SELECT doc_id, 2 AS start, 2 + length(source) AS "end", source AS text FROM documents')
def realigned_spans(spark: SparkSession, d: str) -> DataFrame:
    """The entity after "a, " moves when the comma goes."""
    span = F.array(F.struct(F.lit(3).alias("start"), (F.length("source") + 3).alias("end")))
    moved = text.realign_spans(F.concat(F.lit("a, "), "source"), F.concat(F.lit("a "), "source"), span)
    return table(spark, d, "documents").select("doc_id", F.explode(moved).alias("e")).select("doc_id", "e.start", F.col("e.end").cast("bigint").alias("end"), "e.text")


_WRAPPED = "'{{' || substr(text, 1, 3) || '}}' || substr(text, 4, 2) || '{{' || substr(text, 6, 3) || '}}' || substr(text, 9)"


@query(f"SELECT item_id, {_WRAPPED} AS wrapped, substr(text, 1, 3) AS one, substr(text, 6, 3) AS two FROM benchmark")
def wrapped_entities(spark: SparkSession, d: str) -> DataFrame:
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 3), (5, 8))])
    b = table(spark, d, "benchmark").select("item_id", text.wrap_entities(F.col("text"), spans).alias("wrapped"))
    b = b.withColumn("found", text.parse_entities(F.col("wrapped")))
    return b.select("item_id", "wrapped", F.col("found")[0]["text"].alias("one"), F.col("found")[1]["text"].alias("two"))


@query("SELECT doc_id, text LIKE '%q%u%e%' AS has FROM documents")
def subsequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.is_subsequence(F.lit("que"), F.col("text")).alias("has"))


@query("SELECT doc_id, lang || ', ' || source || '.' AS out FROM documents")
def punctuated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.punctuate(F.concat_ws(" ", "lang", "source"), F.concat("lang", F.lit(", "), "source", F.lit("."))).alias("out"))


@query("SELECT item_id, substr(text, 1, 4) || '<a>' || substr(text, 5, 3) || '<b>' || substr(text, 8) AS out FROM benchmark")
def inserted_tokens(spark: SparkSession, d: str) -> DataFrame:
    places = F.array(*[F.struct(F.lit(n).alias("start"), F.lit(t).alias("text")) for n, t in ((4, "<a>"), (7, "<b>"))])
    return table(spark, d, "benchmark").select("item_id", text.insert_tokens(F.col("text"), places).alias("out"))


@query("SELECT doc_id, '^' || lang || '/' || source || '\\.x\\+' || '(/|$)' AS pattern, regexp_matches(lang || '/' || source || '.x+/y', '^' || lang || '/' || source || '\\.x\\+' || '(/|$)') AS fits FROM documents")
def category_patterns(spark: SparkSession, d: str) -> DataFrame:
    p = text.path_regex(F.array(F.col("lang"), F.concat("source", F.lit(".x+"))))
    rows = table(spark, d, "documents").select("doc_id", p.alias("pattern"), F.concat("lang", F.lit("/"), "source", F.lit(".x+/y")).alias("path"))
    return rows.select("doc_id", "pattern", F.expr("path rlike pattern").alias("fits"))


@query("SELECT doc_id, source || ' - ' || lang AS title FROM documents")
def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.title_cleanup(F.concat(F.lit(' "'), "source", F.lit(" : "), "lang", F.lit('" '))).alias("title"))


@query("SELECT event_type, count(*) FILTER (event_id % 4 < 3) AS limits, count(*) AS n FROM events GROUP BY event_type")
def rate_limit_failures(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    said = F.when(k == 0, "HTTP 429").when(k == 1, "Quota exceeded").when(k == 2, "RESOURCE_EXHAUSTED").otherwise("no such file")
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(text.is_rate_limit(said)).alias("limits"), F.count("*").alias("n"))


@query("SELECT doc_id, md5(text) AS digest, true AS bounded FROM documents WHERE text <> ''")
def broken_up_documents(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<struct<start:int,end:int>>")
    rows = table(spark, d, "documents").where("text <> ''").select("doc_id", text.break_up(F.col("text"), none).alias("p"))
    return rows.select("doc_id", F.md5(F.array_join(F.transform("p", lambda x: x["text"]), "")).alias("digest"), F.forall("p", lambda x: F.length(x["text"]) <= 800).alias("bounded"))


@query("SELECT conv_id, turn, md5(lower(text)) AS folded FROM conversations WHERE role = 'user'")
def folded_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.md5(F.lower("text")).alias("folded"))


@query("SELECT doc_id, array_to_string([CASE WHEN x = 'en' THEN 'EN!' ELSE x END for x in [lang, source, lang]], '|') AS refs FROM documents")
def replaced_refs(spark: SparkSession, d: str) -> DataFrame:
    refs = arrays.replace_ref(F.array("lang", "source", "lang"), F.lit("en"), F.lit("EN!"))
    return table(spark, d, "documents").select("doc_id", F.array_join(refs, "|").alias("refs"))


def _spans(*refs: Column) -> Column:
    kinds = ["term", "citation", "citation"]
    return F.array(*[F.struct(r.alias("ref"), F.lit(k).alias("type"), F.lit(i).alias("start")) for i, (r, k) in enumerate(zip(refs, kinds, strict=True))])


@query("SELECT doc_id, source || '|x|' || source AS every, source || '|x|new' AS one FROM documents")
def replaced_span_refs(spark: SparkSession, d: str) -> DataFrame:
    """The ref lang is put right everywhere, and the source's in the last span only."""
    names = lambda c: F.array_join(F.transform(c, lambda s: s["ref"]), "|")
    rows = table(spark, d, "documents").select("doc_id", _spans(F.col("source"), F.concat("lang", F.lit("?")), F.col("source")).alias("s"), F.concat("lang", F.lit("?")).alias("old"), "source")
    every = arrays.replace_span_ref(F.col("s"), F.col("old"), F.lit("x"))
    return rows.select("doc_id", names(every).alias("every"), names(arrays.replace_span_ref(every, F.col("source"), F.lit("new"), F.lit(2))).alias("one"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS start, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS n FROM documents")
def found_spans(spark: SparkSession, d: str) -> DataFrame:
    """The citation of "en" where there is one, else the first citation; and how many citations are of a set of refs."""
    rows = table(spark, d, "documents").select("doc_id", _spans(F.lit("en"), F.lit("other"), F.col("lang")).alias("s"))
    hit = arrays.span_for_ref(F.col("s"), F.lit("en"))
    return rows.select("doc_id", hit["start"].alias("start"), F.size(arrays.spans_in(F.col("s"), F.array(F.lit("en"), F.lit("zz")))).alias("n"))


@query("SELECT doc_id, array_to_string(list_slice([lang, source, 'x', 'y'], least(greatest(1, doc_id % 7 - 1), 4), greatest(least(greatest(1, doc_id % 7 - 1), 4), least(doc_id % 7 + 1, 4))), '|') AS part FROM documents")
def clamped_slices(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("doc_id") % 7).cast("int")
    return table(spark, d, "documents").select("doc_id", F.array_join(arrays.clamp_slice(F.array(F.col("lang"), F.col("source"), F.lit("x"), F.lit("y")), n - 1, n + 1), "|").alias("part"))


@query("SELECT doc_id, sha256(text || '|' || coalesce(source, '') || '|' || '0,3,' || lang || ';4,9,x') AS doc_key, sha256('0,3,' || lang) AS span_key FROM documents")
def span_hashes(spark: SparkSession, d: str) -> DataFrame:
    spans = F.array(F.struct(F.lit(4).alias("start"), F.lit(9).alias("end"), F.lit("x").alias("label")), F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.col("lang").alias("label")))
    return table(spark, d, "documents").select("doc_id", arrays.doc_key(F.col("text"), F.col("source"), spans).alias("doc_key"), F.sha2(arrays.span_key(spans[1]), 256).alias("span_key"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'English' WHEN lang = 'fr' THEN 'French' END AS label, lang NOT IN ('en', 'fr') AS unknown FROM documents")
def mapped_labels(spark: SparkSession, d: str) -> DataFrame:
    name = arrays.map_label(F.col("lang"), {"en": "English", "fr": "French"})
    return table(spark, d, "documents").select("doc_id", name.alias("label"), name.isNull().alias("unknown"))


@query("SELECT r_name AS root, n_name AS node, 2 AS depth FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_name, r_name, 1 FROM region")
def json_tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every node of a JSON tree of regions with nations as children."""
    kids = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("slug"))).alias("children"))
    trees = table(spark, d, "region").join(kids, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.to_json(F.struct(F.col("r_name").alias("slug"), "children")).alias("tree"))
    return arrays.tree_nodes(trees, "tree", 4)


@query("SELECT lang AS key, 'left' AS value, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY lang UNION ALL SELECT 'en', 'right', count(*) FROM documents UNION ALL SELECT 'zz', 'right', count(*) FROM documents")
def merged_maps(spark: SparkSession, d: str) -> DataFrame:
    left, right = F.create_map(F.col("lang"), F.lit("left")), F.create_map(F.lit("en"), F.lit("right"), F.lit("zz"), F.lit("right"))
    rows = table(spark, d, "documents").select(F.explode(arrays.merge_maps(left, right)).alias("key", "value"))
    return rows.groupBy("key", "value").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS cluster, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY c_nationkey")
def stored_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters as JSON and back."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("cluster")).agg(F.collect_list("c_custkey").alias("items"))
    back = c.select(F.from_json(F.to_json(F.struct("cluster", "items")), "cluster int, items array<bigint>").alias("x")).select("x.*")
    return back.select("cluster", F.size("items").cast("bigint").alias("n"), F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT event_id, round(1 - acos(value / 1000 - 0.3) / pi(), 6) AS similarity FROM events WHERE value / 1000 - 0.3 BETWEEN -1 AND 1")
def linear_similarities(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("value") / 1000 - 0.3
    return table(spark, d, "events").where(c.between(-1, 1)).select("event_id", F.round(vector.linear_similarity(c), 6).alias("similarity"))


@query("SELECT doc_id, greatest(1, n_chars - greatest(8, CAST(round_even(n_chars * 0.15, 0) AS BIGINT))) AS low, n_chars + greatest(8, CAST(round_even(n_chars * 0.15, 0) AS BIGINT)) AS high FROM documents")
def token_bands(spark: SparkSession, d: str) -> DataFrame:
    low, high = vector.token_band(F.col("n_chars"))
    return table(spark, d, "documents").select("doc_id", low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00')) AS BIGINT) AS elapsed FROM events")
def time_stamps(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    elapsed = F.floor((F.unix_micros(ts) - F.lit(1704067200000000)) / 1000000)
    return table(spark, d, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format(ts, "yyyyMMdd_HHmmss").alias("stamp"), elapsed.alias("elapsed"))


@query("SELECT o_custkey, count(*) AS n, CASE WHEN count(*) <= 8 THEN 0 ELSE count(*) - 6 END AS last_start FROM orders GROUP BY o_custkey")
def last_chunk_starts(spark: SparkSession, d: str) -> DataFrame:
    """Where the last chunk of each customer's orders begins, for chunks of 6 with a slack of 2."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.withColumn("last_start", arrays.last_chunk_start(F.col("n"), 6, 2))


@query("SELECT doc_id, array_to_string(list_filter([lang, source, lang, 'zz'], lambda x: x IN ('en', 'fr', 'zz')), '|') AS kept FROM documents")
def projected_labels(spark: SparkSession, d: str) -> DataFrame:
    kept = arrays.project_labels(F.array(F.col("lang"), F.col("source"), F.col("lang"), F.lit("zz")), F.array(*map(F.lit, ("en", "fr", "zz"))))
    return table(spark, d, "documents").select("doc_id", F.array_join(kept, "|").alias("kept"))


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://[^/]+/[a-z]{2}/[0-9]+')")
def valid_refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(arrays.is_ref(F.col("url"), "^https?://[^/]+/[a-z]{2}/[0-9]+")).select("page_id")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') OR source IN ('src3') UNION ALL SELECT doc_id + 1000000000 FROM documents")
def any_category(spark: SparkSession, d: str) -> DataFrame:
    """Rows with one of some categories; no categories at all let every row pass."""
    docs = table(spark, d, "documents").withColumn("categories", F.array("lang", "source"))
    some = docs.where(arrays.any_of(F.col("categories"), ["en", "de", "src3"])).select("doc_id")
    return some.union(docs.where(arrays.any_of(F.col("categories"), [])).select(F.col("doc_id") + 1_000_000_000))


@query("SELECT source, CASE WHEN bool_or(lang = 'en') THEN 'en' ELSE '' END AS chosen, array_to_string(list_sort(list(DISTINCT lang)), ',') AS every FROM documents GROUP BY source")
def chosen_languages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").groupBy("source").agg(F.collect_list("lang").alias("langs"))
    return rows.select("source", F.array_join(text.choose_langs(F.col("langs")), ",").alias("chosen"), F.array_join(text.choose_langs(F.col("langs"), True), ",").alias("every"))


@query("SELECT doc_id, '{\"inputs\":{\"ref\":' || doc_id || '},\"outputs\":{\"slugs\":[\"' || lang || '\",\"' || source || '\"]}}' AS row FROM documents")
def nested_schema(spark: SparkSession, d: str) -> DataFrame:
    inner = F.struct(F.struct(F.col("doc_id").alias("ref")).alias("inputs"), F.struct(F.array("lang", "source").alias("slugs")).alias("outputs"))
    return table(spark, d, "documents").select("doc_id", F.to_json(inner).alias("row"))


@query("SELECT conv_id, CASE WHEN count(*) FILTER (role = 'system') > 0 THEN 'system' ELSE '' END AS first_system, min_by(role, turn) AS first_role FROM conversations GROUP BY conv_id")
def flattened_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The first of a list, or the empty text."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(listed.alias("roles"))
    return rows.select("conv_id", arrays.first_or_empty(F.filter("roles", lambda x: x == "system")).alias("first_system"), arrays.first_or_empty(F.col("roles")).alias("first_role"))


@query("SELECT 'judged' AS scope, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'confounder', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'all', doc_id FROM documents")
def scopes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("judged")).distinct(), "doc_id", "left").withColumn("judged", F.coalesce("judged", F.lit(False)))
    out = [arrays.in_scope(docs, s).select(F.lit(s).alias("scope"), "doc_id") for s in ("judged", "confounder", "all")]
    return out[0].union(out[1]).union(out[2])


@query("SELECT doc_id, lang FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 11 = 0) AND lang NOT IN ('de')")
def without_bad_titles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    rest = gather.without_known(docs, docs.where("doc_id % 11 = 0"), ["source"])
    return gather.without_known(rest, spark.createDataFrame([("de",)], "lang string"), ["lang"]).select("doc_id", "lang")


@query("SELECT doc_id, (lang <> 'en')::INT + 1 AS a_less_b, (lang <> 'en')::INT + 1 AS b_less_a, (lang = 'en')::INT + 1 AS common FROM documents")
def list_differences(spark: SparkSession, d: str) -> DataFrame:
    """How much of one list the other lacks, repeats counting, and what both hold."""
    a, b = F.array(F.col("lang"), F.col("source"), F.lit("q")), F.array(F.lit("en"), F.col("source"), F.lit("zz"))
    rows = table(spark, d, "documents").select("doc_id", a.alias("a"), b.alias("b"))
    return rows.select("doc_id", arrays.count_without("a", "b").alias("a_less_b"), arrays.count_without("b", "a").alias("b_less_a"), F.size(F.array_intersect("a", "b")).alias("common"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 5 + 1 WHEN event_id % 3 = 1 AND event_id % 7 BETWEEN 1 AND 5 THEN event_id % 7 END AS choice FROM events")
def parsed_choices(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    said = F.when(n % 3 == 0, F.concat(F.lit("2 remarks. Choice: "), (n % 5 + 1).cast("string"))).when(n % 3 == 1, F.concat(F.lit("I take "), (n % 7).cast("string"))).otherwise("none of them")
    return table(spark, d, "events").select("event_id", text.choice_number(said, F.lit(5)).alias("choice"))


@query("SELECT doc_id, CASE WHEN length(text) + 300 <= 902 THEN length(text) + 300 WHEN length(text) // 3 >= 300 THEN 900 ELSE length(text) END AS n FROM documents")
def fitted_views(spark: SparkSession, d: str) -> DataFrame:
    whole = F.concat("text", F.repeat(F.lit("q"), F.lit(300)))
    return table(spark, d, "documents").select("doc_id", F.length(text.fit_view(F.col("text"), whole, 300)).cast("bigint").alias("n"))


@query("""WITH t AS (SELECT a.conv_id, lower(a.text) AS x, lower(b.text) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 2),
w AS (SELECT conv_id, list_filter(regexp_split_to_array(trim(x), '\\s+'), lambda z: z <> '') AS x, list_filter(regexp_split_to_array(trim(y), '\\s+'), lambda z: z <> '') AS y FROM t),
g AS (SELECT conv_id, list_transform(range(1, greatest(len(x) - 1, 1)), lambda i: array_to_string(x[i:i + 2], ' ')) AS x, list_transform(range(1, greatest(len(y) - 1, 1)), lambda i: array_to_string(y[i:i + 2], ' ')) AS y FROM w)
SELECT conv_id, list_filter(x, lambda z: list_contains(y, z))[1] AS phrase FROM g""")
def shared_phrases(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    both = c.where("turn = 0").select("conv_id", F.col("text").alias("x")).join(c.where("turn = 2").select("conv_id", F.col("text").alias("y")), "conv_id")
    return both.select("conv_id", text.shared_phrase(F.col("x"), F.col("y")).alias("phrase"))
