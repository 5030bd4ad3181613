"""Text functions as column expressions; the few without a built-in form are Arrow UDFs."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import wraps

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Letters of a glossary's title that it is looked up by.
GLOSS_HEAD = 4


def arrow_udf(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """A pandas UDF that is made at its first use, so that importing needs no session."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*cols: Column) -> Column:
            return F.pandas_udf(f, kind)(*cols)

        return call

    return wrap


# Unicode ranges of Hebrew points and letters.
_POINTS = "[\\u0591-\\u05BD\\u05BF-\\u05C7]"
_HEBREW = "[\\u0590-\\u05FF]"


def strip_diacritics(c: Column) -> Column:
    """Without Hebrew points and accents; the joining hyphen U+05BE stays."""
    return F.regexp_replace(c, _POINTS, "")


@arrow_udf("string")
def strip_marks(s: pd.Series) -> pd.Series:
    """Without nonspacing marks of the Hebrew block: decomposed, filtered, composed again."""
    keep = lambda t: "".join(x for x in unicodedata.normalize("NFD", t) if not ("֑" <= x <= "ׇ" and unicodedata.category(x) == "Mn"))
    return s.map(lambda t: unicodedata.normalize("NFC", keep(t)), na_action="ignore")


def detect_language(c: Column) -> Column:
    """he if Hebrew letters outnumber Latin ones, else en."""
    he = F.length(F.regexp_replace(c, f"[^{_HEBREW[1:-1]}]", ""))
    return F.when(he > F.length(F.regexp_replace(c, "[^A-Za-z]", "")), "he").otherwise("en")


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def xml_tag(c: Column, tag: str) -> Column:
    """First non-empty content of a tag, else null."""
    return F.nullif(F.regexp_extract(c, f"(?s)<{tag}>(.+?)</{tag}>", 1), F.lit(""))


def xml_list(c: Column, tag: str) -> Column:
    return F.regexp_extract_all(F.regexp_replace(c, "\n", " "), F.lit(f"<{tag}>(.+?)</{tag}>"), 1)


def word_count(c: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""))


def token_count(c: Column) -> Column:
    """Number of runs of word characters, Unicode-aware."""
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)\b\w+\b"), 0))


def estimated_tokens(c: Column) -> Column:
    """Model tokens where no tokenizer is given: a third of the characters."""
    return F.floor(F.length(c) / 3)


def slugify(c: Column, sep: str = "_") -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", sep), f"^{sep}+|{sep}+$", ""))


def clause_split(c: Column) -> Column:
    """Parts that end in a colon or comma, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(c, "(?<=[:,])"), lambda x: F.trim(x)), lambda x: x != "")


def combine_small(sentences: Column, min_words: int) -> Column:
    """Sentences shorter than min_words join what comes before (or start the list), and so does the sentence after one."""
    glue = lambda out, s: F.when(F.size(out) == 0, F.array(s)).otherwise(F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat_ws(" ", F.element_at(out, -1), s))))

    def step(acc: Column, s: Column) -> Column:
        small = word_count(s) < min_words
        return F.struct(F.when(small | acc["small"], glue(acc["out"], s)).otherwise(F.concat(acc["out"], F.array(s))).alias("out"), small.alias("small"))

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("small"))
    return F.aggregate(sentences, zero, step)["out"]


def even_split(c: Column, most: int) -> Column:
    """Words cut into ceil(n / most) nearly equal runs."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    n = F.size(words)
    size = F.ceil(n / F.greatest(F.ceil(n / F.lit(most)), F.lit(1))).cast("int")
    return F.when(n <= most, F.array(F.trim(c))).otherwise(F.transform(F.sequence(F.lit(1), n, F.greatest(size, F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " ")))


def url_to_ref(c: Column) -> Column:
    """The path of a URL as a reference: no host, no query, decoded, underscores as spaces."""
    path = F.regexp_replace(F.regexp_replace(c, r"^[a-zA-Z]+://[^/]*/?", ""), r"[?#].*$", "")
    return F.trim(F.translate(F.try_url_decode(path), "_", " "))


def clamp_score(c: Column, low: int = 0, high: int = 4) -> Column:
    """A score as an integer between low and high; what is no integer is low."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c.try_cast("int"), F.lit(low))))


def is_rate_limit(c: Column) -> Column:
    return F.lower(c).rlike("429|rate.?limit|quota|resource.?exhausted|too many requests")


def mark_citation(text: Column, start: Column, end: Column, tag: str = "citation") -> Column:
    """text with <tag> around the characters from start to end (0-based, end exclusive)."""
    return F.concat(F.substring(text, F.lit(1), start), F.lit(f"<{tag}>"), F.substring(text, start + 1, end - start), F.lit(f"</{tag}>"), F.substring(text, end + 1, F.length(text)))


def fenced_json(c: Column, schema: str) -> Column:
    """The JSON of an answer, with or without a code fence, as a struct; broken JSON is null."""
    return F.from_json(F.regexp_replace(F.trim(c), r"(?s)^```(?:json)?\s*|\s*```$", ""), schema)


def first_array(c: Column) -> Column:
    """The first [ ... ] in a text, else null."""
    return F.nullif(F.regexp_extract(c, r"(?s)\[.*?\]", 0), F.lit(""))


def parse_ranking(c: Column, k: int) -> Column:
    """A permutation of 0..k-1 out of an answer, else null."""
    ranks = F.from_json(first_array(c), "array<int>")
    return F.when(F.array_sort(ranks) == F.sequence(F.lit(0), F.lit(k - 1)), ranks)


def parse_range(c: Column) -> Column:
    """[a, b] of "Range: a,b", else of the first two integers, else null."""
    said = F.regexp_extract_all(F.regexp_extract(c, r"(?i)range:\s*(\d+\s*,\s*\d+)", 1), F.lit(r"\d+"), 0)
    any_two = F.regexp_extract_all(c, F.lit(r"\d+"), 0)
    pick = lambda a: F.when(F.size(a) >= 2, F.slice(a, 1, 2).cast("array<int>"))
    return F.coalesce(pick(said), pick(any_two))


def title_cleanup(c: Column) -> Column:
    """Without surrounding quotes, and with "a: b" as "a - b"."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), '^["\']+|["\']+$', ""), r"\s*:\s*", " - ")


def truncate_words(c: Column, most: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(c), r"\s+"), 1, most), " ")


def word_window(text: Column, start: Column, end: Column, n: int) -> Column:
    """The words that a character span touches with n more on either side."""
    before = F.size(F.filter(F.split(F.trim(F.substring(text, F.lit(1), start)), r"\s+"), lambda x: x != ""))
    upto = F.size(F.filter(F.split(F.trim(F.substring(text, F.lit(1), end)), r"\s+"), lambda x: x != ""))
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    low = F.greatest(before - n, F.lit(0))
    return F.array_join(F.slice(words, low + 1, upto + n - low), " ")


def path_regex(parts: Column) -> Column:
    """A pattern for a category path: parts escaped and joined by slashes."""
    return F.concat(F.lit("^"), F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, r"([\\.^$|?*+()\[\]{}])", r"\\$1")), "/"), F.lit("(/|$)"))


@arrow_udf("array<struct<start:int,end:int>>")
def footnote_spans(s: pd.Series) -> pd.Series:
    return s.map(find_footnotes, na_action="ignore")


_NOTE = re.compile(r"<sup[^>]*footnote-marker[^>]*>.*?</sup>\s*<i[^>]*footnote[^>]*>", re.S)
_ITALIC = re.compile(r"<i(?=[\s>])|</i\s*>")


def find_footnotes(text: str) -> list[dict]:
    """A marker followed by an <i> note; nested <i> are counted, unbalanced notes and those inside another are left out."""
    out, last = [], -1
    for m in _NOTE.finditer(text):
        if m.start() < last:
            continue
        depth = 1
        for t in _ITALIC.finditer(text, m.end()):
            depth += -1 if t[0].startswith("</") else 1
            if not depth:
                out.append({"start": m.start(), "end": t.end()})
                last = t.end()
                break
    return out


def without_footnotes(text: str) -> str:
    for f in reversed(find_footnotes(text)):
        text = text[: f["start"]] + text[f["end"] :]
    return text


def split_footnotes(note: str) -> str:
    """A footnote's own text: marker and body without markup, white space made one."""
    return " ".join(re.sub("<[^>]+>", " ", note).split())


@arrow_udf("string")
def remove_footnotes(s: pd.Series) -> pd.Series:
    return s.map(without_footnotes, na_action="ignore")


@arrow_udf("string")
def escape_inner_quotes(s: pd.Series) -> pd.Series:
    """Quotes inside the string values of an object get a backslash; a value ends at the first quote before a comma, a brace or a line's end."""
    value = re.compile(r'(?<=:)\s*"(?P<inner>[^\n]*?)"(?=[,}\n])')

    def escape(m: re.Match) -> str:
        head = m[0][: m.start("inner") - m.start()]
        return head + m["inner"].replace('"', '\\"') + '"'

    return s.map(lambda t: value.sub(escape, t), na_action="ignore")


_CLOSERS = "\"'”’)]}»"
_NUMBERING = re.compile(r"(?:\d+|[A-Za-zא-ת])[.)](?=\s|$)|\d+(?:\.\d+)+|(?:[A-Za-zא-ת]\.){2,}")


def split_sentences(text: str) -> list[str]:
    """Sentences by rule: ! ? and line ends close one, a dot does at the end of a token unless it belongs to a number or
    acronym; runs of separators stay inside. A single sentence is split into clauses if that gives several."""
    text = text.replace("\r", "").replace("''", '"')
    out, now = [], []
    for line in text.split("\n"):
        for token in line.split():
            now.append(token)
            bare = token.rstrip(_CLOSERS)
            run = len(bare) - len(bare.rstrip(".!?"))
            if run == 1 and not _NUMBERING.fullmatch(bare):
                out.append(" ".join(now))
                now = []
        if now:
            out.append(" ".join(now))
            now = []
    if len(out) <= 1:
        clauses = [c.strip() for c in re.split("(?<=[:,])", text) if c.strip()]
        return clauses if len(clauses) > 1 else out
    return out


@arrow_udf("array<string>")
def sentences(s: pd.Series) -> pd.Series:
    return s.map(split_sentences, na_action="ignore")


@arrow_udf("array<string>")
def rejoin_numerals(s: pd.Series) -> pd.Series:
    """Sentences that are but a Roman numeral join the next one."""

    def join(items: list[str]) -> list[str]:
        out: list[str] = []
        for x in items:
            if out and re.fullmatch(r"[IVXLCDM]+\.", out[-1]):
                out[-1] = f"{out[-1]} {x}"
            else:
                out.append(x)
        return out

    return s.map(lambda x: join(list(x)), na_action="ignore")


def diff_spans(old: str, new: str) -> list[dict]:
    """Edits that turn old into new: spans of old and the text put there."""
    ops = SequenceMatcher(None, old, new, autojunk=False).get_opcodes()
    return [{"start": a, "end": b, "text": new[c:d]} for tag, a, b, c, d in ops if tag != "equal"]


@arrow_udf("array<struct<start:int,end:int,text:string>>")
def edits(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([diff_spans(a or "", b or "") for a, b in zip(old, new, strict=True)])


def realign(old: str, new: str, spans: list[dict]) -> list[dict]:
    """Spans of old moved to where their text lies in new."""
    moves = SequenceMatcher(None, old, new, autojunk=False).get_opcodes()

    def at(i: int, end: bool) -> int:
        for tag, a, b, c, d in moves:
            if (a <= i < b) or (end and a < i <= b):
                return c + i - a if tag == "equal" else (d if end else c)
        return len(new)

    return [{"start": (s := at(x["start"], False)), "end": (e := at(x["end"], True)), "text": new[s:e]} for x in spans]


@arrow_udf("array<struct<start:int,end:int,text:string>>")
def realign_spans(old: pd.Series, new: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([realign(a, b, list(s)) for a, b, s in zip(old, new, spans, strict=True)])


@arrow_udf("struct<offset:int,ratio:double>")
def best_substring(text: pd.Series, part: pd.Series) -> pd.DataFrame:
    """Where a text holds the most similar run of the part's length; the first of equals."""
    out = []
    for t, p in zip(text, part, strict=True):
        best = (0, -1.0)
        m = SequenceMatcher(None, "", p or "", autojunk=False)
        for i in range(max(1, len(t or "") - len(p or "") + 1)):
            m.set_seq1((t or "")[i : i + len(p or "")])
            if m.real_quick_ratio() > best[1] and (r := m.ratio()) > best[1]:
                best = (i, r)
        out.append(best)
    return pd.DataFrame(out, columns=["offset", "ratio"])


@arrow_udf("string")
def wrap_entities(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Each span between {{ and }}."""

    def wrap(t: str, own: list[dict]) -> str:
        for s in sorted(own, key=lambda x: -x["start"]):
            t = f"{t[: s['start']]}{{{{{t[s['start'] : s['end']]}}}}}{t[s['end'] :]}"
        return t

    return pd.Series([wrap(t, list(s)) for t, s in zip(text, spans, strict=True)])


@arrow_udf("array<struct<start:int,end:int,text:string>>")
def parse_entities(s: pd.Series) -> pd.Series:
    """Spans of {{...}} in the text without the braces."""

    def parse(t: str) -> list[dict]:
        out = []
        for k, m in enumerate(re.finditer(r"\{\{(.+?)\}\}", t, re.S)):
            start = m.start() - 4 * k
            out.append({"start": start, "end": start + len(m[1]), "text": m[1]})
        return out

    return s.map(parse, na_action="ignore")


@arrow_udf("boolean")
def is_subsequence(part: pd.Series, whole: pd.Series) -> pd.Series:
    def test(p: str, w: str) -> bool:
        it = iter(w)
        return all(c in it for c in p)

    return pd.Series([test(p or "", w or "") for p, w in zip(part, whole, strict=True)])


@arrow_udf("string")
def punctuate(bare: pd.Series, punctuated: pd.Series) -> pd.Series:
    """Punctuation of one text carried over to another with the same words, word by word."""

    def carry(b: str, p: str) -> str:
        out, words = [], p.split()
        k = 0
        for w in b.split():
            core = re.sub(r"\W", "", w)
            for j in range(k, len(words)):
                if re.sub(r"\W", "", words[j]) == core:
                    w += re.search(r"\W*$", words[j])[0] if not re.search(r"\W$", w) else ""
                    k = j + 1
                    break
            out.append(w)
        return " ".join(out)

    return pd.Series([carry(b or "", p or "") for b, p in zip(bare, punctuated, strict=True)])


@arrow_udf("string")
def insert_tokens(text: pd.Series, places: pd.Series) -> pd.Series:
    """text with strings put in at character places: array of struct(start, text)."""

    def put(t: str, own: list[dict]) -> str:
        for x in sorted(own, key=lambda y: -y["start"]):
            t = t[: x["start"]] + x["text"] + t[x["start"] :]
        return t

    return pd.Series([put(t, list(p)) for t, p in zip(text, places, strict=True)])


@arrow_udf("array<struct<start:int,text:string,spans:array<struct<start:int,end:int>>>>")
def break_up(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Parts of at most 800 characters cut at white space outside spans, with the spans counted from each part's start."""

    def cut(t: str, own: list[dict], most: int = 800) -> list[dict]:
        out, at = [], 0
        while at < len(t):
            end = min(len(t), at + most)
            if end < len(t):
                free = [m.end() for m in re.finditer(r"\s+", t[at:end])]
                free = [at + f for f in free if not any(s["start"] < at + f < s["end"] for s in own)]
                end = free[-1] if free else end
            mine = [{"start": s["start"] - at, "end": s["end"] - at} for s in own if at <= s["start"] and s["end"] <= end]
            out.append({"start": at, "text": t[at:end], "spans": mine})
            at = end
        return out

    return pd.Series([cut(t, list(s)) for t, s in zip(text, spans, strict=True)])


def split_by_language(c: Column, lang: Column) -> Column:
    """Sentences by the rule-based splitter for Hebrew, at white space after . ! or ? for other languages."""
    plain = F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(lang == "he", sentences(c)).otherwise(plain)


def choose_langs(available: Column, all_of_them: bool = False) -> Column:
    """The languages to use of those available: all, sorted, or Hebrew and else English."""
    if all_of_them:
        return F.array_sort(F.array_distinct(available))
    return F.when(F.array_contains(available, "he"), F.array(F.lit("he"))).when(F.array_contains(available, "en"), F.array(F.lit("en"))).otherwise(F.array().cast("array<string>"))


def choice_number(c: Column, most: Column) -> Column:
    """n of "choice: n", else the first integer of an answer, if it lies between 1 and most, else null."""
    said = F.nullif(F.regexp_extract(c, r"(?i)choice\s*:\s*(\d+)", 1), F.lit(""))
    n = F.coalesce(said, F.nullif(F.regexp_extract(c, r"\d+", 0), F.lit(""))).try_cast("bigint")
    return F.when(n.between(1, most), n)


def fit_view(own: Column, whole: Column, most: int, with_quotes: bool = True) -> Column:
    """The whole text if it is wanted and fits the budget of estimated tokens, else the own part, cut to the budget where that is too long."""
    cut = F.when(estimated_tokens(own) >= most, F.substring(own, 1, most * 3)).otherwise(own)
    return F.when(F.lit(with_quotes) & (estimated_tokens(whole) <= most), whole).otherwise(cut)


def shared_phrase(a: Column, b: Column, words: int = 3) -> Column:
    """The first run of that many words that two texts share, in lower case; null if there is none. A deterministic stand-in for a judge."""
    def runs(c: Column) -> Column:
        w = F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda x: x != "")
        return F.when(F.size(w) >= words, F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), lambda i: F.array_join(F.slice(w, i, words), " "))).otherwise(F.array().cast("array<string>"))

    return F.get(F.array_intersect(runs(a), runs(b)), F.lit(0))


def gloss_rewrite(rows: DataFrame, key: str, body: str, glossary: DataFrame, rewrite: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """(key, title, rewritten): a text that holds titles of the glossary (title, gloss) is rewritten for the longest, others stay with a null title.

    Titles are found by their first four letters: every four letters of a text, and shorter titles, are looked up by
    an equi-join, and only titles that begin so are searched for. Keys may recur; the texts themselves are not grouped.
    """
    spark_rows = rows.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), F.col(body).alias("__body"))
    held = cut_lineage(spark_rows, "gloss-rows")
    size = F.least(F.lit(GLOSS_HEAD), F.length("title"))
    titles = cut_lineage(glossary.where(F.length("title") > 0).select("title", "gloss", size.alias("__n"), F.substring("title", F.lit(1), size).alias("__head")), "gloss-titles")
    sizes = [r[0] for r in titles.select("__n").distinct().collect()]  # four at most
    heads = [F.regexp_extract_all("__body", F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in sizes]  # from every place, in time that grows with the text
    parts = F.array_distinct(F.flatten(F.array(*heads))) if heads else F.array().cast("array<string>")
    met = held.select("__row", F.explode(parts).alias("__head")).join(titles, "__head").select("__row", "title", "gloss")
    hits = met.join(held.select("__row", "__body"), "__row").where(F.col("__body").contains(F.col("title")))
    best = hits.groupBy("__row").agg(F.max_by(F.struct("title", "gloss"), F.struct(F.length("title"), "title")).alias("g"))
    new = F.when(F.col("g.title").isNull(), F.col("__body")).otherwise(rewrite(F.col("__body"), F.col("g.title"), F.col("g.gloss")))
    return held.join(best, "__row", "left").select(F.col("__key").alias(key), F.col("g.title").alias("title"), new.alias("rewritten"))


def run_id(config: dict) -> str:
    """The first 16 hex digits of SHA-256 over the sorted JSON of a configuration."""
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
