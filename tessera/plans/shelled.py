"""Queries on the shells around model calls, with stand-ins whose answers SQL can give as well."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import answers, generation, shells
from .catalog import query, table


def _topics(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("r_name").alias("title"), F.col("n_nationkey").alias("ref"), F.col("n_name").alias("text"), F.lower("n_name").alias("lang"))


def _judge(good: Callable[[str], str], odd: Callable[[str], str], broken: Callable[[str], str]) -> Callable[[str], str]:
    """A stand-in that answers by the first byte of the text's SHA-256: as asked, in another shape, unreadably, or not at all."""

    def call(asked: str) -> str:
        import hashlib

        body = asked.partition("<a>")[2].rpartition("</a>")[0]
        k = int(hashlib.sha256(body.encode()).hexdigest()[:2], 16) % 4
        if k == 3:
            raise TimeoutError("no answer")
        return (good, odd, broken)[k](body)

    return call


def _asked(spark: SparkSession, d: str, task: str, call: Callable[[str], str], parse: Callable[[Column], Column]) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", F.col("source").alias("title"))
    return answers.asked(rows, shells.prompt(task), call, parse, "said")


#: k: how the stand-in answers; n: letters of the text.
_KIND = "WITH a AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, CAST('0x' || substr(sha256(coalesce(text, '')), 1, 2) AS INT) % 4 AS k, length(coalesce(text, '')) AS n FROM documents)"


def _fenced(s: str) -> str:
    return f"```json\n{s}\n```"


@query(f"{_KIND} SELECT doc_id, CASE WHEN k < 3 THEN n % 2 = 0 END AS is_complete, CASE k WHEN 0 THEN n || ' letters' WHEN 1 THEN 'so it is' WHEN 2 THEN CASE WHEN n % 2 = 0 THEN 'I think TRUE' ELSE 'not so' END END AS reasoning, k = 3 AS failed FROM a")
def ask_citations(spark: SparkSession, d: str) -> DataFrame:
    """Whether a citation is complete: JSON, fenced JSON, words, or no answer."""
    yes = lambda t: str(len(t) % 2 == 0).lower()
    call = _judge(lambda t: f'{{"is_complete": {yes(t)}, "reasoning": "{len(t)} letters"}}', lambda t: _fenced(f'{{"is_complete": {yes(t)}, "reasoning": "so it is"}}'), lambda t: "I think TRUE" if len(t) % 2 == 0 else "not so")
    out = _asked(spark, d, "citations", call, answers.completeness)
    return out.select("doc_id", "said.is_complete", "said.reasoning", F.col("error").isNotNull().alias("failed"))


@query(f"{_KIND} SELECT doc_id, CASE k WHEN 0 THEN 'T' || n || '|U|V' WHEN 3 THEN NULL ELSE 'Unable to parse|response|properly' END AS titles, CASE k WHEN 0 THEN 'medium' WHEN 3 THEN NULL ELSE 'low' END AS confidence FROM a")
def ask_titles(spark: SparkSession, d: str) -> DataFrame:
    """Likely titles; an answer with two of the three counts as unreadable."""
    call = _judge(lambda t: f'{{"book_titles": ["T{len(t)}", "U", "V"], "confidence": "medium"}}', lambda t: _fenced('{"book_titles": ["T", "U"], "confidence": "high"}'), lambda t: "[T, U, V]")
    return _asked(spark, d, "citations", call, answers.titles).select("doc_id", F.array_join("said.book_titles", "|").alias("titles"), "said.confidence")


@query(f"{_KIND} SELECT doc_id, CASE WHEN k < 2 THEN 'why' END AS reasoning, CASE WHEN k < 2 THEN k = 0 END AS is_complete, CASE k WHEN 0 THEN 'Title ' || n END AS quoted_title, CASE k WHEN 1 THEN 'Canon' END AS canonical_title FROM a")
def ask_reference(spark: SparkSession, d: str) -> DataFrame:
    """A reference analysed; titles without letters are none."""
    call = _judge(lambda t: f'{{"reasoning": "why", "is_complete": true, "quoted_title": " Title {len(t)} ", "canonical_title": "-"}}', lambda t: _fenced('{"reasoning": "why", "is_complete": false, "canonical_title": "Canon"}'), lambda t: '{"reasoning": "why"}')
    return _asked(spark, d, "citations", call, answers.analysis).select("doc_id", "said.*")


@query(f"{_KIND} SELECT doc_id, CASE k WHEN 0 THEN 'about ' || n WHEN 1 THEN 'open ' || n WHEN 2 THEN 'N/A' END AS summary FROM a")
def ask_summary(spark: SparkSession, d: str) -> DataFrame:
    call = _judge(lambda t: f"so: <summary>about {len(t)}</summary>", lambda t: f"<summary>open {len(t)}", lambda t: "nothing to say")
    return _asked(spark, d, "summary", call, answers.summary).select("doc_id", F.col("said").alias("summary"))


@query(f"{_KIND} SELECT doc_id, CASE k WHEN 0 THEN 'remark ' || n WHEN 1 THEN 'first' WHEN 2 THEN 'none' END AS commentary FROM a")
def ask_commentary(spark: SparkSession, d: str) -> DataFrame:
    """The first of several remarks."""
    call = _judge(lambda t: f"<commentary>remark {len(t)}</commentary>", lambda t: "<commentary>first</commentary><commentary>second</commentary>", lambda t: "<other>x</other>")
    return _asked(spark, d, "commentary", call, lambda c: answers.summary(c, "commentary", "none")).select("doc_id", F.col("said").alias("commentary"))


@query(f"{_KIND} SELECT doc_id, CASE WHEN k < 3 THEN k = 0 END AS needed, CASE k WHEN 0 THEN 'after ' || n END AS before FROM a")
def ask_context(spark: SparkSession, d: str) -> DataFrame:
    """Whether a passage needs what comes before it."""
    call = _judge(lambda t: f"<needed> YES </needed><context>after {len(t)}</context>", lambda t: "<needed>no</needed><context>x</context>", lambda t: "perhaps")
    return _asked(spark, d, "context", call, answers.context).select("doc_id", "said.*")


@query(f"{_KIND} SELECT doc_id, CASE k WHEN 0 THEN 'said ' || n WHEN 1 THEN 'said' WHEN 2 THEN 'plain ' || n END AS translation, CASE k WHEN 0 THEN 'en' END AS language FROM a")
def ask_translation(spark: SparkSession, d: str) -> DataFrame:
    call = _judge(lambda t: _fenced(f'{{"translation": "said {len(t)}", "language": "en"}}'), lambda t: '{"translation": "said"}', lambda t: f" plain {len(t)}\n")
    return _asked(spark, d, "translation", call, answers.translation).select("doc_id", "said.*")


@query(f"{_KIND} SELECT doc_id, CASE k WHEN 0 THEN 'Own' WHEN 1 THEN source END AS title, CASE WHEN k < 2 THEN n || ' letters' END AS description FROM a")
def ask_description(spark: SparkSession, d: str) -> DataFrame:
    """A title and a description; the source's name where the answer has no title."""
    call = _judge(lambda t: f'{{"title": "Own", "description": "{len(t)} letters"}}', lambda t: f'{{"title": " ", "description": "{len(t)} letters"}}', lambda t: '{"title": "Own"}')
    return _asked(spark, d, "description", call, lambda c: answers.description(c, F.col("title"))).select("doc_id", "said.*")


@query(f"{_KIND} SELECT doc_id, CASE WHEN k = 0 AND n > 6 THEN '2:5:' || substr(text, 3, 3) WHEN k < 2 THEN '' END AS spans FROM a WHERE NOT contains(text, '{{') AND NOT contains(text, '}}')")
def ask_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities in braces, as places of the text; an answer with other words than the text is none. Texts with braces of their own are not asked about."""
    call = _judge(lambda t: f"{t[:2]}{{{{{t[2:5]}}}}}{t[5:]}" if len(t) > 6 else t, lambda t: t, lambda t: f"Here it is: {t}")
    rows = _asked(spark, d, "entities", call, lambda c: answers.entities(c, F.col("text"))).where("not contains(text, '{') and not contains(text, '}')")
    one = lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["text"])
    return rows.select("doc_id", F.array_join(F.transform("said", one), "|").alias("spans"))


@query(f"{_KIND} SELECT doc_id, CASE k WHEN 0 THEN 'Why ' || n || '?|How?' WHEN 1 THEN 'What?' WHEN 2 THEN '' END AS questions FROM a")
def ask_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions out of numbered lines; lines that ask nothing go, and repeats too."""
    call = _judge(lambda t: f"Here they are:\n1. Why {len(t)}?\n\n 2) How?\n3. How?", lambda t: "- What?\n* What?", lambda t: "None.")
    return _asked(spark, d, "questions", call, answers.questions).select("doc_id", F.array_join("said", "|").alias("questions"))


@query("SELECT a.n_nationkey AS ref, 'What is special about <a>' || a.n_name || '</a> beside <b>' || coalesce(string_agg(b.n_name, ' ' ORDER BY b.n_nationkey), '') || '</b>?' AS prompt FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY a.n_nationkey, a.n_name")
def topic_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Each source's prompt names the topic's others."""
    return shells.with_others(_topics(spark, d), "title", "ref", "text").select("ref", shells.prompt("uniqueness").alias("prompt"))


@query("SELECT conv_id, turn, text AS contextualise FROM conversations")
def ask_contextualise(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", "text", F.col("role").alias("before"))
    return shells.run(c, "contextualise", shells.echo("contextualise", str)).select("conv_id", "turn", "contextualise")


@query("SELECT n_nationkey AS ref, CASE WHEN n_nationkey % 10 < 5 THEN upper(n_name || '!') ELSE n_name || '?' END AS target FROM nation")
def validated_translations(spark: SparkSession, d: str) -> DataFrame:
    """The second call answers where the first gives nothing new."""

    def once(t: str) -> str:
        return f"{t}!".upper() if int(t.rsplit("_", 1)[1]) % 10 < 5 else t

    return shells.validated(_topics(spark, d).select("ref", "text"), "text", "target", once, lambda t: f"{t}?").select("ref", "target")


@query("SELECT c_custkey AS ref, CASE WHEN c_acctbal > 5000 THEN 'page ' || c_mktsegment WHEN c_nationkey < 20 THEN 'source ' || c_nationkey END AS description FROM customer")
def description_cascade(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("ref"), "c_acctbal", "c_mktsegment", "c_nationkey")
    pages = lambda r: r.withColumn("description", F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("page "), "c_mktsegment")))
    sources = lambda r: r.withColumn("description", F.when(F.col("c_nationkey") < 20, F.concat(F.lit("source "), F.col("c_nationkey").cast("string"))))
    return shells.cascade(c, pages, sources, key="ref", value="description")


def _grade(refs: list[str]) -> dict[str, int]:
    """A judge that fails on more than three refs, knows those that end in 0 to 6 only, and adds one nobody asked for."""
    if len(refs) > 3:
        raise ValueError("too many")
    return {r: int(r[-1]) - 1 for r in refs if r[-1] in "0123456"} | {"other": 4}


_GRADES = "SELECT o_custkey AS sheet, 'o' || o_orderkey AS ref, CASE WHEN o_orderkey % 10 <= 6 THEN greatest(0, least(4, o_orderkey % 10 - 1)) ELSE 0 END AS score FROM orders"


@query(f"SELECT sheet, ref, CAST(score AS INT) AS score FROM ({_GRADES})")
def graded_refs(spark: SparkSession, d: str) -> DataFrame:
    """Refs are scored by halves until the judge answers."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sheet")).agg(F.array_sort(F.collect_list(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))).alias("refs"))
    return shells.graded(o, "sheet", "refs", _grade)


@query(f"""WITH g AS ({_GRADES}), s AS (SELECT *, sum(score) OVER (PARTITION BY sheet) AS total, count(*) OVER (PARTITION BY sheet) AS n FROM g)
SELECT sheet, ref, CASE WHEN sheet % 7 = 0 OR n > 20 THEN 0.0 ELSE round_even(score * 100.0 / CASE WHEN total = 0 THEN 1 ELSE total END, 2) END AS percentage, CASE WHEN sheet % 7 = 0 OR n > 20 THEN 'equal' ELSE 'scored' END AS status FROM s
UNION ALL SELECT c_custkey, NULL, NULL, 'failure' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def scored_sheets(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sheet")).agg(F.array_sort(F.collect_list(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))).alias("refs"))
    none = F.array().cast("array<string>")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sheet")).join(o, "sheet", "left").select("sheet", F.coalesce("refs", none).alias("refs"), F.when(F.col("sheet") % 7 == 0, " ").otherwise("own text").alias("original"))
    return shells.scored_sheets(c, _grade, 20)


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS lo, max(turn) OVER (PARTITION BY conv_id) AS hi FROM conversations),
s(conv_id, turn, lo, hi, first, last, steps, i, on_) AS (SELECT conv_id, turn, lo, hi, turn, turn, 0, 0, true FROM t
UNION ALL SELECT conv_id, turn, lo, hi, first - l::INT, last + r::INT, steps + (l OR r)::INT, i + 1, l OR r FROM
(SELECT *, on_ AND (first + last) % 3 IN (0, 1) AND first > lo AS l, on_ AND (first + last) % 3 IN (0, 2) AND last < hi AS r FROM s) WHERE i < 3) SELECT conv_id, turn, first, last, steps FROM s WHERE i = 3""")
def expanded_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Turns widened to the left, right or both, as a stand-in says by the range's sum."""
    says = lambda a, b: F.when((a + b) % 3 == 0, "both").when((a + b) % 3 == 1, "left").otherwise("right")
    out = shells.expanded_context(table(spark, d, "conversations"), "conv_id", "turn", "text", says)
    return out.select("conv_id", "turn", "first", "last", F.col("steps").alias("steps"))


@query("""SELECT conv_id, turn, '{"messages":[{"role":"system","content":"Classify."},{"role":"user","content":"' || role || '"},{"role":"assistant","content":"' || turn || '"}]}' AS chat, '{"prompt":"' || role || '\\n\\n###\\n\\n","completion":" ' || turn || ' END"}' AS completion FROM conversations""")
def fine_tune_lines(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("turn").cast("string")
    return table(spark, d, "conversations").select("conv_id", "turn", shells.chat_example("Classify.", F.col("role"), n).alias("chat"), shells.completion_example(F.col("role"), n).alias("completion"))


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type = 'error' AS bad FROM events),
s(user_id, i, w, c) AS (SELECT DISTINCT user_id, 0, 4, 0 FROM e UNION ALL SELECT e.user_id, e.i, CASE WHEN bad THEN greatest(w - 1, 1) WHEN c + 1 >= 3 AND w < 6 THEN w + 1 ELSE w END, CASE WHEN bad OR c + 1 >= 3 THEN 0 ELSE c + 1 END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, CAST(sum(w) AS BIGINT) AS total, arg_max(w, i) AS last FROM s WHERE i > 0 GROUP BY user_id""")
def adapted_workers(spark: SparkSession, d: str) -> DataFrame:
    runs = F.transform(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_type") == "error").alias("bad")))), lambda x: x["bad"])
    e = table(spark, d, "events").groupBy("user_id").agg(runs.alias("runs")).withColumn("w", shells.adapted_workers(F.col("runs")))
    return e.select("user_id", F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.element_at("w", -1).alias("last"))


@query("SELECT doc_id, lang = 'en' OR doc_id % 2 = 0 AS yes FROM documents")
def split_by_judge(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a yes and the others, put together again."""
    rows = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.col("lang"), (F.col("doc_id") % 2).cast("string")).alias("prompt"))
    yes, no = generation.split_by(rows, "prompt", lambda p: "Yes" if p.startswith("en") or p.endswith("0") else "no")
    return yes.select("doc_id", F.lit(True).alias("yes")).union(no.select("doc_id", F.lit(False)))


@query("SELECT doc_id AS ref, array_to_string(list_filter([lang, source, 'wide'], lambda x: x <> 'wide' OR doc_id % 3 = 0), '|') AS slugs FROM documents")
def two_pass_topics(spark: SparkSession, d: str) -> DataFrame:
    """Over-general labels need a second yes."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ref"), F.array(F.col("lang"), F.col("source"), F.lit("wide")).alias("slugs"), (F.col("doc_id") % 3).cast("string").alias("text"))
    return generation.two_pass(rows, "slugs", ["wide"], lambda p: "true" if p.endswith("\n0") else "True").select("ref", F.array_join("slugs", "|").alias("slugs"))


@query("SELECT doc, ref, CASE WHEN n <= 4 THEN coalesce(score, 0) END AS score FROM (SELECT *, count(*) FILTER (score IS NULL) OVER (PARTITION BY doc) AS n FROM (SELECT o_custkey AS doc, o_orderkey AS ref, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 5 END AS score FROM orders))")
def filled_scores(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ref"), "o_orderstatus")
    return generation.fill_scores(o.select("doc", "ref"), o.where("o_orderstatus <> 'P'").select("doc", "ref", (F.col("ref") % 5).alias("score")))


@query("SELECT doc_id, upper(lang) AS answer FROM documents")
def cached_answers(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct prompt is asked once and kept."""
    from ..session import new_path

    return generation.cached_ask(table(spark, d, "documents").select("doc_id", "lang"), "lang", str.upper, new_path(spark, "answers")).select("doc_id", "answer")


@query("SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE 'turn ' || turn END AS answer, CASE WHEN turn % 5 = 4 THEN 'HTTP 400' END AS error FROM conversations")
def answers_and_failures(spark: SparkSession, d: str) -> DataFrame:
    def call(p: str) -> str:
        if int(p.split()[1]) % 5 == 4:
            raise ValueError("HTTP 400")
        return p

    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("p"))
    return generation.ask(rows, "p", generation.with_retry(call, wait=0.0)).select("conv_id", "turn", "answer", "error")


@query("SELECT conv_id, array_to_string(list_transform(range(1, count(*)::INT + 1), lambda i: 'topic ' || i), ', ') AS tags FROM conversations GROUP BY conv_id")
def free_text_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of an answer, joined."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    rows = c.select("conv_id", F.col("n").cast("string").alias("p"))
    said = generation.ask(rows, "p", lambda p: "\n".join(f"<topic>topic {i + 1}</topic>" for i in range(int(p))))
    return said.select("conv_id", F.array_join(text.xml_list(F.col("answer"), "topic"), ", ").alias("tags"))


@query("SELECT page_id, CASE WHEN contains(html, '<table') THEN replace(html, '<table', '[a table with rows]<table') ELSE html END = html AS same, contains(html, '<table') AS has FROM pages")
def glossed_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Texts that name a term of the glossary are rewritten with its gloss; others stay."""
    glossary = spark.createDataFrame([("<table", "[a table with rows]<table")], "title string, gloss string")
    rows = table(spark, d, "pages").select("page_id", "html")
    out = text.gloss_rewrite(rows, "page_id", "html", glossary, lambda body, title, gloss: F.replace(body, title, gloss))
    return rows.join(out, "page_id").select("page_id", (F.col("html") == F.col("rewritten")).alias("same"), F.col("title").isNotNull().alias("has"))


@query("SELECT doc_id, 16 AS width, true AS bounded FROM documents")
def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    v = shells.embedded(table(spark, d, "documents").select("doc_id", "text"), "text", shells.EMBEDDERS.make("hash", 16))
    return v.select("doc_id", F.size("vector").alias("width"), F.forall("vector", lambda x: F.abs(x) <= 1).alias("bounded"))


@query("SELECT lang, count(*) AS n FROM documents WHERE n_chars > 100 GROUP BY lang")
def piped_steps(spark: SparkSession, d: str) -> DataFrame:
    """A chain of steps, kept at a place and read from there."""
    from ..session import new_path

    long = lambda df, least: df.where(F.col("n_chars") > least)
    count = lambda df, key: df.groupBy(key).agg(F.count("*").alias("n"))
    make = lambda: table(spark, d, "documents").transform(long, 100).transform(count, "lang")
    path = new_path(spark, "steps")
    shells.checkpointed(make, spark, path)
    return shells.checkpointed(make, spark, path)
