"""What models answer, parsed by task into typed columns; each task says what becomes of an answer that it cannot read.

A null answer (a call that failed) gives nulls throughout, so rows never go and failures can be counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import generation

# What an unreadable prediction of titles becomes, and the confidences there are.
NO_TITLES, CONFIDENCES = ["Unable to parse", "response", "properly"], ("high", "medium", "low")
TITLES = 3


def _whole(parsed: Column, *fields: str) -> Column:
    """Whether an answer was read and has all fields."""
    ok = parsed.isNotNull()
    for f in fields:
        ok &= parsed[f].isNotNull()
    return ok


def completeness(answer: Column) -> Column:
    """struct(is_complete, reasoning) of a judged citation. An answer that is no such JSON is its own reasoning, and complete if it says true."""
    p = text.fenced_json(answer, "is_complete boolean, reasoning string")
    read = _whole(p, "is_complete", "reasoning")
    said = F.struct(F.when(read, p["is_complete"]).otherwise(F.contains(F.lower(answer), F.lit("true"))).alias("is_complete"), F.when(read, p["reasoning"]).otherwise(answer).alias("reasoning"))
    return F.when(answer.isNotNull(), said)


def titles(answer: Column) -> Column:
    """struct(book_titles, confidence): the likeliest titles, most likely first; low confidence and a note in their place if the answer has not all of them."""
    p = text.fenced_json(answer, "book_titles array<string>, confidence string")
    read = _whole(p, "book_titles", "confidence") & (F.size(p["book_titles"]) == TITLES) & p["confidence"].isin(*CONFIDENCES)
    said = F.struct(F.when(read, p["book_titles"]).otherwise(F.array(*map(F.lit, NO_TITLES))).alias("book_titles"), F.when(read, p["confidence"]).otherwise("low").alias("confidence"))
    return F.when(answer.isNotNull(), said)


def analysis(answer: Column) -> Column:
    """struct(reasoning, is_complete, quoted_title, canonical_title) of a reference; null if any but the titles is missing. Titles without letters are null."""
    p = text.fenced_json(answer, "reasoning string, is_complete boolean, quoted_title string, canonical_title string")
    title = lambda f: F.when(F.rlike(p[f], F.lit(r"\p{L}")), F.trim(p[f])).alias(f)
    return F.when(_whole(p, "reasoning", "is_complete"), F.struct(p["reasoning"].alias("reasoning"), p["is_complete"].alias("is_complete"), title("quoted_title"), title("canonical_title")))


def summary(answer: Column, tag: str = "summary", none: str = "N/A") -> Column:
    """What stands within the tag; of one that is not closed, the rest; a note where there is neither."""
    found = F.coalesce(text.xml_tag(answer, tag), F.when(F.contains(answer, F.lit(f"<{tag}>")), F.nullif(F.trim(F.replace(F.replace(answer, F.lit(f"<{tag}>"), F.lit("")), F.lit(f"</{tag}>"), F.lit(""))), F.lit(""))))
    return F.when(answer.isNotNull(), F.coalesce(found, F.lit(none)))


def context(answer: Column) -> Column:
    """struct(needed, before): whether a passage needs what comes before it, and that in a line; any answer but yes says it does not."""
    needed = F.coalesce(F.lower(F.trim(text.xml_tag(answer, "needed"))) == "yes", F.lit(False))
    return F.when(answer.isNotNull(), F.struct(needed.alias("needed"), F.when(needed, text.xml_tag(answer, "context")).alias("before")))


def translation(answer: Column) -> Column:
    """struct(translation, language); an answer without such JSON is the translation, of no named language."""
    p = text.fenced_json(answer, "translation string, language string")
    read = _whole(p, "translation")
    return F.when(answer.isNotNull(), F.struct(F.when(read, p["translation"]).otherwise(F.regexp_replace(answer, r"^\s+|\s+$", "")).alias("translation"), F.when(read, p["language"]).alias("language")))


def description(answer: Column, title: Column) -> Column:
    """struct(title, description): the given title where the answer has none; null without a description."""
    p = text.fenced_json(answer, "title string, description string")
    return F.when(_whole(p, "description"), F.struct(F.coalesce(F.nullif(F.trim(p["title"]), F.lit("")), title).alias("title"), p["description"].alias("description")))


def entities(answer: Column, body: Column) -> Column:
    """array of struct(start, end, text): what the answer puts in double braces, as places of the body; null if the answer has other words than the body."""
    bare = F.regexp_replace(answer, r"(?s)\{\{(.+?)\}\}", "$1")
    return F.when(bare == body, text.parse_entities(answer))


def questions(answer: Column) -> Column:
    """The questions of an answer, one a line: numbers and dashes before them go, lines that ask nothing too, and repeats after the first."""
    lines = F.transform(F.split(answer, r"\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:\d+[.)]|[-*])\s*", "")))
    return F.array_distinct(F.filter(lines, lambda x: x.endswith("?")))


def asked(rows: DataFrame, prompt: Column, call: Callable[[str], str], parse: Callable[[Column], Column], name: str) -> DataFrame:
    """rows with the parsed answer to a prompt, and an error column that says what went wrong."""
    said = generation.ask(rows.withColumn("__prompt", prompt), "__prompt", call, "__answer")
    return said.withColumn(name, parse(F.col("__answer"))).drop("__prompt", "__answer")
