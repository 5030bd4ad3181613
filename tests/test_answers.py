"""Answers of every shape, parsed by task, and the glossary against a plain search."""

import random

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import answers


def parsed(spark, parse, *said):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(said)], "i int, a string")
    return [r[0] for r in df.orderBy("i").select(parse(F.col("a"))).collect()]


def test_completeness(spark):
    got = parsed(spark, answers.completeness, '{"is_complete": true, "reasoning": "r"}', '```\n{"is_complete": false, "reasoning": "s"}\n```', "so TRUE", '{"is_complete": true}', None)
    assert [g and tuple(g) for g in got] == [(True, "r"), (False, "s"), (True, "so TRUE"), (True, '{"is_complete": true}'), None]


def test_titles(spark):
    none = (answers.NO_TITLES, "low")
    got = parsed(spark, answers.titles, '{"book_titles": ["a", "b", "c"], "confidence": "high"}', '{"book_titles": ["a", "b"], "confidence": "high"}', '{"book_titles": ["a", "b", "c"], "confidence": "sure"}', "", None)
    assert [g and (list(g[0]), g[1]) for g in got] == [(["a", "b", "c"], "high"), none, none, none, None]


def test_others(spark):
    assert parsed(spark, answers.summary, "<summary>a\nb</summary>", "<summary> x", "<summary></summary>", "x", None) == ["a\nb", "x", "N/A", "N/A", None]
    assert parsed(spark, answers.questions, "1. A?\n2) B?\n- A?\nno\n  * C d?", "", None) == [["A?", "B?", "C d?"], [], None]
    got = parsed(spark, lambda c: answers.entities(c, F.lit("one two one")), "one {{two}} one", "{{one}} two {{one}}", "one two", "one two one", None)
    assert [None if g is None else [(s["start"], s["end"], s["text"]) for s in g] for g in got] == [[(4, 7, "two")], [(0, 3, "one"), (8, 11, "one")], None, [], None]
    got = parsed(spark, answers.context, "<needed>Yes</needed><context>c</context>", "<needed>no</needed>", "x", None)
    assert [g and tuple(g) for g in got] == [(True, "c"), (False, None), (False, None), None]
    got = parsed(spark, lambda c: answers.description(c, F.lit("own")), '{"title": "t", "description": "d"}', '{"title": "", "description": "d"}', '{"title": "t"}', None)
    assert [g and tuple(g) for g in got] == [("t", "d"), ("own", "d"), None, None]


def test_failed_calls_keep_their_rows(spark):
    def call(p):
        if "2" in p:
            raise OSError("gone")
        return f'{{"translation": "{p}", "language": "x"}}'

    rows = spark.range(4).withColumnRenamed("id", "k")
    got = answers.asked(rows, F.col("k").cast("string"), call, answers.translation, "said").orderBy("k").collect()
    assert [r["said"] and r["said"]["translation"] for r in got] == ["0", "1", None, "3"] and [r["error"] for r in got] == [None, None, "gone", None]


def test_glossary_equals_a_plain_search(spark):
    rng = random.Random(1)
    draw = lambda lo, hi: "".join(rng.choice("abc d") for _ in range(rng.randint(lo, hi)))
    texts = [(i % 40, draw(0, 60)) for i in range(60)] + [(99, None)]
    titles = sorted({draw(1, 9) for _ in range(40)} - {""})
    rows = spark.createDataFrame(texts, "k int, t string")
    glossary = spark.createDataFrame([(t, f"<{t}>") for t in [*titles, ""]], "title string, gloss string")
    got = text.gloss_rewrite(rows, "k", "t", glossary, lambda body, title, gloss: F.replace(body, title, gloss))
    want = []
    for k, t in texts:
        hit = max((x for x in titles if x in (t or "")), key=lambda x: (len(x), x.encode()), default=None)
        want.append((k, hit, t.replace(hit, f"<{hit}>") if hit else t))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert got._jdf.queryExecution().toString().count("NestedLoop") == 0
