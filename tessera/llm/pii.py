"""Personal data by weak supervision.

Four base patterns find spans that always count. Beyond them, broad patterns propose candidates on which
labelers vote: strict patterns, gazetteers of cue words and of mail domains, and context. How reliable each
labeler is for each kind is estimated by expectation-maximisation over the vote patterns of the whole corpus.
A span classifier, fitted on the estimated posteriors, decides which candidates become spans; besides the votes
it sees the span itself: its form, length, separators and the word before it. Candidates of equal votes and
features are counted together; the driver gets the vote patterns, of which there are few, and a bounded number of
the patterns of votes and features, and sends tasks a weight for each input it was fitted on.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]*[\x20().0-9-][0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Broad patterns: kinds written in other ways than the base patterns know. A mail address is found by its bracketed "at".
_AT = re.compile(r"[\[({]\s?at\s?[\])}]", re.I)
_AT_DOMAIN = re.compile(r"\s?[A-Za-z0-9-]++(?:\s?(?:\.|[\[({]\s?dot\s?[\])}])\s?[A-Za-z0-9-]++)++", re.I)
_BROAD = {
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9.])[0-9]{4}(?:[.\x20/-][0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+(])(?:\([0-9]{2,4}\)|00[0-9]{2}|[0-9]{3})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{2,4})?(?![0-9])"),
}
# Cue words (several languages) and common mail domains.
CUES = {
    "email": frozenset("mail email e-mail contact write courriel correo kontakt".split()),
    "ip": frozenset("ip host server address addr adresse".split()),
    "card": frozenset("card visa mastercard amex credit payment carte karte tarjeta iban account konto".split()),
    "phone": frozenset("phone tel call telephone mobile fax ring telefon telefono téléphone handy".split()),
}
AGAINST = frozenset("order invoice isbn version page ref id no number item token section figure".split())
DOMAINS = ("gmail", "yahoo", "hotmail", "outlook", "proton", "example", "mail")
LABELERS = ("shape", "valid", "gazetteer", "cue", "against", "clean")
CONTEXT = 40
#: The classifier is fitted on at most so many patterns of votes and features.
PATTERNS = 20_000


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches of every kind, leftmost and non-overlapping within the kind."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:  # the pattern's match around an @ starts at the earliest character of the run before it
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p) < 30 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def votes(kind: str, text: str, start: int, end: int) -> str:
    """Each labeler's vote on a candidate: "1" for, "0" against, "-" none."""
    span = text[start:end]
    before = text[max(0, start - CONTEXT) : start].lower()
    near = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", before)[-3:]
    digits = re.sub("[^0-9]", "", span)
    shape = "1" if kind in ("email", "ip") or (kind == "card" and re.search(r"[.\x20/-]", span)) or (kind == "phone" and "(" in span) else "-"
    if kind == "card":
        valid = "1" if luhn(digits) else "0"
    elif kind == "phone":
        valid = "1" if 9 <= len(digits) <= 15 and len(set(digits)) > 3 else "0"
    else:
        valid = "-"
    gazetteer = "1" if kind == "email" and any(d in span.lower() for d in DOMAINS) else "1" if kind == "card" and digits[:1] in "3456" else "-"
    cue = "1" if any(w in CUES[kind] for w in near) else "-"
    against = "0" if any(w in AGAINST for w in near) else "-"
    left, right = text[start - 1 : start], text[end : end + 1]
    clean = "1" if not (left.isalnum() or right.isalnum()) else "0"
    return shape + valid + gazetteer + cue + against + clean


def _spelt_mails(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of addresses with a bracketed "at", left to right: dot-parted words before it, a domain after it."""
    last = 0
    for m in _AT.finditer(text):
        end = m.start() - (m.start() > last and text[m.start() - 1].isspace())
        start = end
        while start > last and text[start - 1] in _LOCAL_CHARS and text[start - 1 : start + 1] != "..":
            start -= 1
        if start < end and text[start] == ".":
            start += 1
        if start >= end or text[end - 1] == "." or m.start() < last:
            continue
        d = _AT_DOMAIN.match(text, m.end())
        if d:
            yield start, d.end()
            last = d.end()


def features(kind: str, text: str, start: int, end: int) -> str:
    """What the classifier sees of a span besides the votes, comma-joined: length, form (runs of digits by length, of letters as one), separators, and the cue word next before it."""
    span = text[start:end]
    runs = re.findall(r"[0-9]+|[^\W\d_]+|[\W_]", span)
    form = "".join(str(min(len(r), 9)) if r[0].isdigit() else "a" if r.isalpha() else "-" for r in runs[:12])
    marks = "".join(sorted({"_" if r.isspace() else r for r in runs if not r.isalnum() and r.isascii()} - {","}))
    word = re.findall(r"[^\W\d_]+", text[max(0, start - CONTEXT) : start].lower())[-1:]
    known = word[0] if word and (word[0] in CUES[kind] or word[0] in AGAINST) else "other" if word else "none"
    return f"length:{min(len(span) // 4, 8)},form:{form},marks:{marks},before:{known}"


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, str]]:
    """(start, kind number, end, votes, features) of broad matches that overlap no base span."""
    out = []
    if not re.search(r"[0-9]{3}|at\s?[\])}]|:[0-9A-Fa-f]{1,4}:", text, re.I):
        return out
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for k, kind in enumerate(KINDS):
        for x, y in _spelt_mails(text) if kind == "email" else ((m.start(), m.end()) for m in _BROAD[kind].finditer(text)):
            before = bisect_left(starts, y)
            if not before or reach[before - 1] <= x:
                out.append((x, k, y, votes(kind, text, x, y), features(kind, text, x, y)))
    return out


@dataclass
class Reliability:
    """For one kind: the share of real spans and each labeler's vote probabilities given real or not."""

    prior: float
    rates: list[dict[str, tuple[float, float]]]


def estimate(patterns: dict[tuple[str, str], int], rounds: int = 30) -> dict[str, Reliability]:
    """Expectation-maximisation over vote patterns and their counts; it starts from each labeler being right more often than not."""
    out = {}
    for kind in KINDS:
        own = {p: n for (k, p), n in patterns.items() if k == kind}
        start = {"1": (0.5, 0.15), "0": (0.1, 0.45), "-": (0.4, 0.4)}
        r = Reliability(0.5, [dict(start) for _ in LABELERS])
        total = sum(own.values())
        for _ in range(rounds if total else 0):
            post = {p: posterior(r, p) for p in own}
            real = sum(n * post[p] for p, n in own.items())
            r.prior = min(0.95, max(0.05, (real + 1) / (total + 2)))
            for j in range(len(LABELERS)):
                for v in "10-":
                    a = sum(n * post[p] for p, n in own.items() if p[j] == v)
                    b = sum(n * (1 - post[p]) for p, n in own.items() if p[j] == v)
                    s0, s1 = start[v]  # pseudo-counts keep the meaning of a vote
                    r.rates[j][v] = ((a + 20 * s0) / (real + 20), (b + 20 * s1) / (total - real + 20))
        out[kind] = r
    return out


def posterior(r: Reliability, pattern: str) -> float:
    odds = math.log(r.prior / (1 - r.prior))
    for j, v in enumerate(pattern):
        a, b = r.rates[j][v]
        odds += math.log(a / b)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def _names(kind: str, votes: str, features: str) -> list[str]:
    """The classifier's inputs: the kind, and by kind each vote and each feature."""
    return [f"kind:{kind}", *(f"{kind}:{x}:{y}" for x, y in zip(LABELERS, votes, strict=True) if y != "-"), *(f"{kind}:{x}" for x in features.split(","))]


def chance(weights: dict[str, float], kind: str, votes: str, features: str) -> float:
    """The probability of a span; an input that training did not see counts nothing."""
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(n, 0.0) for n in _names(kind, votes, features))))))


def fit(patterns: dict[tuple[str, str, str], int], reliability: dict[str, Reliability], steps: int = 400, rate: float = 2.0) -> dict[str, float]:
    """The classifier's weight of each input: logistic regression fitted to the posteriors of the votes, with the patterns' counts as weights."""
    keys = sorted(patterns)
    if not keys:
        return {}
    number: dict[str, int] = {}
    rows, cols = [], []
    for i, key in enumerate(keys):
        for name in _names(*key):
            rows.append(i)
            cols.append(number.setdefault(name, len(number)))
    rows, cols = np.array(rows), np.array(cols)
    n = np.array([patterns[k] for k in keys], dtype=float)
    y, w, squares = np.array([posterior(reliability[k], v) for k, v, _ in keys]), np.zeros(len(number)), np.full(len(number), 1e-8)
    predict = lambda: 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=w[cols], minlength=len(keys)), -30, 30)))
    for _ in range(steps):
        grad = np.bincount(cols, weights=(n / n.sum() * (y - predict()))[rows], minlength=len(w)) - 1e-5 * w
        squares += grad * grad
        w += rate * grad / np.sqrt(squares) * 0.1
    return dict(zip(number, w.tolist(), strict=True))


def train(patterns: dict[tuple[str, str, str], int], steps: int = 400, rate: float = 2.0) -> dict[tuple[str, str, str], float]:
    """The classifier's probability for each (kind, votes, features), with the reliabilities estimated on the same patterns."""
    by_votes: dict[tuple[str, str], int] = {}
    for (k, v, _), n in patterns.items():
        by_votes[k, v] = by_votes.get((k, v), 0) + n
    weights = fit(patterns, estimate(by_votes), steps, rate)
    return {key: chance(weights, *key) for key in sorted(patterns)}


_SPAN = "struct<start:int,kind:string,end:int>"


def _proposed(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """keep, base: array of spans, more: array of candidates with what is known of them (votes and features)."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])
    cand = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("votes", pa.string()), ("features", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, more = [], []
            for t in b.column("__text").to_pylist():
                own = base_spans(t or "")
                base.append([{"start": s, "kind": KINDS[k], "end": e} for s, k, e in own])
                more.append([{"start": s, "kind": KINDS[k], "end": e, "votes": v, "features": f} for s, k, e, v, f in candidates(t or "", own)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(base, type=pa.list_(span)), pa.array(more, type=pa.list_(cand))], [*keep, "base", "more"])

    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*schema, f"base array<{_SPAN}>", "more array<struct<start:int,kind:string,end:int,votes:string,features:string>>"]))


def _fitted(proposed: DataFrame, most: int) -> dict[str, float]:
    """The classifier's weights. Reliabilities rest on the votes of all candidates, of which there are at most 3^6 patterns a
    kind; the classifier is fitted on the most patterns of votes and features that most candidates have, ties by their text."""
    counted = common.Staged(proposed.select(F.explode("more").alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count("*").alias("n")), "pii-patterns")
    by_votes = {(r["kind"], r["votes"]): r["n"] for r in counted.df.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()}
    seen = counted.df.orderBy(F.desc("n"), "kind", "votes", "features").limit(most).collect()
    counted.drop()
    return fit({(r["kind"], r["votes"], r["features"]): r["n"] for r in seen}, estimate(by_votes))


def _accepts(weights: dict[str, float], threshold: float) -> Callable[[str, str, str], bool]:
    """Whether a candidate counts, remembered for the patterns met last."""
    return functools.lru_cache(PATTERNS)(lambda kind, votes, features: chance(weights, kind, votes, features) >= threshold)


def find(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", most: int = PATTERNS) -> DataFrame:
    """(id_col, base, spans) of every row: arrays of (start, kind, end) in code points, end exclusive, by start then
    kind's place in KINDS; spans holds the base spans and the candidates that the classifier accepts. Every candidate is
    judged; most bounds the patterns that the classifier is fitted on, and with them the weights that tasks are sent.

    Null counts as the empty text and has no spans; repeated rows stay; an empty table gives an empty result;
    extra columns are ignored; a text of any length is one value of its row, and its candidates are sought in time that grows with it.
    """
    common.prepare(docs.sparkSession)
    scratch = common.Scratch()
    rows = scratch.stage(_proposed(docs, [id_col], text_col), "pii-spans")
    weights, place = _fitted(rows, most), {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = _accepts(weights, threshold)
        for b in batches:
            base, spans = b.column("base"), []
            for own, more in zip(base.to_pylist(), b.column("more").to_pylist(), strict=True):
                found = own + [{x: c[x] for x in ("start", "kind", "end")} for c in more if accepts(c["kind"], c["votes"], c["features"])]
                spans.append(sorted(found, key=lambda s: (s["start"], place[s["kind"]], s["end"])))
            yield pa.RecordBatch.from_arrays([b.column(id_col), base, pa.array(spans, type=base.type)], [id_col, "base", "spans"])

    kind = rows.schema[id_col].dataType.simpleString()
    return scratch.result(rows.mapInArrow(run, f"`{id_col}` {kind}, base array<{_SPAN}>, spans array<{_SPAN}>"), "pii-found")


def joined(spans: Column | str) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, threshold: float = 0.5, text_col: str = "text", most: int = PATTERNS) -> DataFrame:
    """docs with every span found replaced by its kind in square brackets; overlapping spans become one, named by the first.
    The candidates' votes over all of docs decide, as in find(). Columns of any name stay as they came; null and empty texts
    stay as they are, repeated rows are each redacted, an empty table stays empty, and a text of any length is read whole."""
    common.prepare(docs.sparkSession)
    weights = _fitted(_proposed(docs, [], text_col), most)
    at = docs.columns.index(text_col)

    def clean(text: str | None, accepts: Callable[[str, str, str], bool]) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        spans = sorted([*base, *((s, k, e) for s, k, e, v, f in candidates(text, base) if accepts(KINDS[k], v, f))])
        out, last = [], 0
        for s, k, e in spans:
            if s >= last:
                out.append(f"{text[last:s]}[{KINDS[k].upper()}]")
            last = max(last, e)
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = _accepts(weights, threshold)
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([clean(t, accepts) for t in cols[at].to_pylist()], type=cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
