"""Queries on texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage
from ..sources import readers
from .catalog import query, table

_WS = "[ \\t\\n\\r\\f\\x0b]+"
_SPLIT = f"list_filter(regexp_split_to_array(trim(text, ' '), '{_WS}'), lambda x: x <> '')"


@query("SELECT page_id, length(regexp_replace(html, '<[^>]+>', ' ', 'g'))::INT AS n, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS digest FROM pages")
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    clean = text.strip_html(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(clean).alias("n"), F.md5(clean).alias("digest"))


@query("SELECT page_id, nullif(regexp_extract(html, '(?s)<title>(.+?)</title>', 1), '') AS title, len(regexp_extract_all(replace(html, chr(10), ' '), '<li>(.+?)</li>', 1))::INT AS items FROM pages")
def xml_tag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.xml_tag(F.col("html"), "title").alias("title"), F.size(text.xml_list(F.col("html"), "li")).alias("items"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?s)<a\\s[^>]*>(.*?)</a>', 1))::INT AS links, array_to_string(list_transform(regexp_extract_all(html, '(?s)<a\\s[^>]*>(.*?)</a>', 1), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))), '|') AS texts FROM pages")
def link_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", readers.link_texts("html").alias("t")).select("page_id", F.size("t").alias("links"), F.array_join("t", "|").alias("texts"))


@query("SELECT page_id, trim(translate(url_decode(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/]*/?', ''), '[?#].*$', '')), '_', ' ')) AS ref FROM pages")
def url_to_ref(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.url_to_ref(F.col("url")).alias("ref"))


@query("SELECT page_id, lower(regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM pages")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.slugify(F.col("url")).alias("slug"))


@query(f"SELECT doc_id, len({_SPLIT})::INT AS words, length(text) // 3 AS tokens FROM documents")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"), text.estimated_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH w AS (SELECT unnest({_SPLIT}) AS g FROM documents), c AS (SELECT g, count(*) AS n FROM w GROUP BY g) SELECT g AS gram, n FROM c ORDER BY n DESC, g LIMIT 2000""")
def ngram_counts_1(spark: SparkSession, d: str) -> DataFrame:
    return _ngrams(table(spark, d, "documents"), 1)


for _n in (2, 3, 4):

    @query(f"""WITH w AS (SELECT {_SPLIT} AS w FROM documents), g AS (SELECT array_to_string(w[i:i + {_n - 1}], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - {_n - 2})) AS i FROM w)), c AS (SELECT g, count(*) AS n FROM g GROUP BY g) SELECT g AS gram, n FROM c ORDER BY n DESC, g LIMIT 2000""", name=f"ngram_counts_{_n}")
    def _counts(spark: SparkSession, d: str, n: int = _n) -> DataFrame:
        return _ngrams(table(spark, d, "documents"), n)


def _ngrams(docs: DataFrame, n: int, top: int = 2000) -> DataFrame:
    """The most frequent n-grams of words; counted over all texts, the cut is the report's. Grams are counted by hash first, so that
    only the words of those that may be among the first are shuffled; where that leaves too many or too few, all are."""
    w = docs.select(F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "").alias("w")).where(F.size("w") >= n)
    if n == 1:
        return w.select(F.explode("w").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(top)
    parts = [F.slice("w", k + 1, F.size("w") - (n - 1)) for k in range(n)]
    grams = w.select(F.explode(F.arrays_zip(*[p.alias(f"w{k}") for k, p in enumerate(parts)])).alias("g")).select("g.*")
    names = [f"`{c}`" for c in grams.columns]
    counted = lambda g: g.groupBy(*names).agg(F.count("*").alias("n")).select(F.concat_ws(" ", *names).alias("gram"), "n").orderBy(F.desc("n"), "gram").limit(top)
    hashed = grams.select("*", F.xxhash64(*names).alias("h"))
    repeated = cut_lineage(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "gram-hashes")
    edge, k = repeated.orderBy(F.desc("n")).limit(top).agg(F.min("n"), F.count("*")).first()
    if k < top or (often := repeated.where(F.col("n") >= edge)).count() > MOST_HASHES:
        return counted(grams)
    # a gram of at least that count has such a hash; so once the last of the found ones reaches it, none is missing
    found = cut_lineage(counted(hashed.join(F.broadcast(often.select("h")), "h", "left_semi")), "grams")
    last, k = found.agg(F.min("n"), F.count("*")).first()
    return found.orderBy(F.desc("n"), "gram") if k == top and last >= edge else counted(grams)


#: Hashes of frequent grams that are sent to all tasks.
MOST_HASHES = 1_000_000


@query("SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\\x{0590}-\\x{05FF}]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 'he' ELSE 'en' END AS script FROM documents")
def detect_script(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.detect_language(F.col("text")).alias("script"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) AS clean FROM documents")
def normalise_space(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.normalize_space(F.col("text")).alias("clean"))


@query("SELECT item_id, len(list_filter(list_transform(string_split(replace(replace(text, ',', ',' || chr(1)), ':', ':' || chr(1)), chr(1)), lambda x: trim(x)), lambda x: x <> ''))::INT AS clauses FROM benchmark")
def clause_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.size(text.clause_split(F.col("text"))).alias("clauses"))


_PLAIN = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
_SMALL = "len(list_filter(regexp_split_to_array(xs[i + 1], '\\s+'), lambda x: x <> '')) < 5"


@query(f"""WITH RECURSIVE s AS (SELECT item_id, {_PLAIN} AS xs FROM benchmark), f(item_id, xs, i, got, small) AS (SELECT item_id, xs, 0, []::VARCHAR[], false FROM s
UNION ALL SELECT item_id, xs, i + 1, CASE WHEN NOT ({_SMALL} OR small) THEN list_append(got, xs[i + 1]) WHEN len(got) = 0 THEN [xs[i + 1]] ELSE list_append(got[1:len(got) - 1], got[-1] || ' ' || xs[i + 1]) END, {_SMALL} FROM f WHERE i < len(xs))
SELECT item_id, array_to_string(got, '|') AS sentences FROM f WHERE i = len(xs)""")
def combine_small_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = text.combine_small(text.split_by_language(F.col("text"), F.lit("en")), 5)
    return table(spark, d, "benchmark").select("item_id", F.array_join(s, "|").alias("sentences"))


_NUMBERING = "([0-9]+|[A-Za-zא-ת])[.)]|[0-9]+([.][0-9]+)+|([A-Za-zא-ת][.]){2,}"


@query(f"""WITH t AS (SELECT conv_id, turn, replace(replace(text, chr(13), ''), chr(39) || chr(39), '"') AS t FROM conversations),
l AS (SELECT conv_id, turn, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM t),
k AS (SELECT conv_id, turn, i, unnest(x) AS token, unnest(range(len(x))) AS j FROM (SELECT conv_id, turn, i, list_filter(regexp_split_to_array(line, '\\s+'), lambda y: y <> '') AS x FROM l)),
e AS (SELECT *, regexp_replace(token, '["''”’)\\]}}»]+$', '') AS bare FROM k),
g AS (SELECT *, coalesce(sum((regexp_matches(bare, '(^|[^.!?])[.!?]$') AND NOT regexp_full_match(bare, '{_NUMBERING}'))::INT) OVER (PARTITION BY conv_id, turn, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM e),
s AS (SELECT conv_id, turn, i, n, string_agg(token, ' ' ORDER BY j) AS s FROM g GROUP BY ALL), a AS (SELECT conv_id, turn, list(s ORDER BY i, n) AS s FROM s GROUP BY ALL),
c AS (SELECT conv_id, turn, list_filter(list_transform(string_split(replace(replace(t, ',', ',' || chr(1)), ':', ':' || chr(1)), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS c FROM t)
SELECT conv_id, turn, array_to_string(CASE WHEN len(coalesce(s, [])) <= 1 AND len(c) > 1 THEN c ELSE coalesce(s, []) END, '|') AS sentences FROM c LEFT JOIN a USING (conv_id, turn)""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.sentences(F.col("text")), "|").alias("sentences"))


@query(f"SELECT doc_id, len({_SPLIT})::INT AS words, CASE WHEN len({_SPLIT}) <= 100 THEN 1 ELSE CAST(ceil(len({_SPLIT}) / ceil(len({_SPLIT}) / ceil(len({_SPLIT}) / 100))) AS INT) END AS parts FROM documents WHERE text <> ''")
def even_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text <> ''")
    return docs.select("doc_id", text.word_count(F.col("text")).alias("words"), F.size(text.even_split(F.col("text"), 100)).alias("parts"))


@query("SELECT doc_id, lang FROM documents WHERE NOT regexp_matches(text, '&lt;|&gt;') AND text NOT LIKE '%###%'")
def filter_escaped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(~F.col("text").rlike("&lt;|&gt;") & ~F.col("text").contains("###")).select("doc_id", "lang")


@query("SELECT event_id, greatest(0, least(4, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'junk' ELSE CAST(event_id % 7 - 1 AS VARCHAR) END AS INT), 0))) AS level FROM events")
def clamp_scores(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, "junk").otherwise((F.col("event_id") % 7 - 1).cast("string"))
    return table(spark, d, "events").select("event_id", text.clamp_score(raw).alias("level"))


@query("SELECT doc_id, substr(text, 1, 5) || '<citation>' || substr(text, 6, 10) || '</citation>' || substr(text, 16) AS marked FROM documents WHERE length(text) > 20")
def mark_citation(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.length("text") > 20)
    return docs.select("doc_id", text.mark_citation(F.col("text"), F.lit(5), F.lit(15)).alias("marked"))


@query(f"SELECT doc_id, array_to_string({_SPLIT}[1:12], ' ') AS head FROM documents")
def truncate_budget(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(words, 1, 12), " ").alias("head"))


@query("SELECT doc_id, concat_ws(' | ', source, lang, text) AS rendered, coalesce(nullif(text, ''), source) AS fallback FROM documents")
def render_variants(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.concat_ws(" | ", "source", "lang", "text").alias("rendered"), F.coalesce(F.nullif(F.col("text"), F.lit("")), "source").alias("fallback"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS phrase, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, phrase ORDER BY i) AS n FROM p) SELECT doc_id, count(*) FILTER (n > 1) AS repeats, count(*) AS lines FROM r GROUP BY doc_id""")
def repeated_phrases(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "phrase"))
    n = F.row_number().over(Window.partitionBy("doc_id", "phrase").orderBy("i"))
    return p.withColumn("n", n).groupBy("doc_id").agg(F.count_if(F.col("n") > 1).alias("repeats"), F.count("*").alias("lines"))


@query("SELECT replace('What is {} about?', '{}', source) AS question, count(*) AS n FROM documents GROUP BY source")
def template_questions(spark: SparkSession, d: str) -> DataFrame:
    q = F.replace(F.lit("What is {} about?"), F.lit("{}"), F.col("source"))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).select(q.alias("question"), "n")
