"""Main-text extraction with a tree-structured graphical model.

A page becomes a tree of its elements and text runs. Each node is content or not; its own potential comes
from features of the node, a parent and child share a potential by their labels, and one pass of sum-product
messages up the tree and one down give exact marginals. Weights are fitted on labelled pages by the gradient
of the likelihood (features seen less features expected, both exact on trees).
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "p": frozenset(["p"]),
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
KEEPS_P = frozenset("article aside body button div footer form header main nav section td th table".split())
IN_HEAD = frozenset("html head base link meta title style script noscript template bgsound basefont".split())
FOREIGN = frozenset(["svg", "math"])
NEVER = frozenset("head script style textarea title noscript iframe template svg math select button option object".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_PLAIN = re.compile(r"[^>\"']*+")
_ZEROS = re.compile(r"&#([xX]?)0{2,}")
_NUMERIC = re.compile(r"&#(?:[xX]0*+[0-9a-fA-F]{7,}|0*+[0-9]{8,});?")
#: Elements open at once; what lies deeper counts as a child of the deepest of them, as in browsers.
MAX_DEPTH = 512
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    text: str = ""
    label: int = -1
    keys: list[str] = field(default_factory=list)


class _Tags:
    """The tags of a page one after the other, in time that grows with its length only."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quote = {'"': -1, "'": -1}  # where the quotes next are

    def _quote(self, c: str, at: int) -> int:
        if self.quote[c] < at:
            found = self.page.find(c, at)
            self.quote[c] = found if found >= 0 else len(self.page) + 1
        return self.quote[c]

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next tag; comments and declarations have no name."""
        page = self.page
        while (i := page.find("<", at)) >= 0:
            if page.startswith("<!--", i):
                j = page.find("-->", i + 4)
                return i, j + 3 if j >= 0 else len(page), "", "", ""
            if i > self.last:
                return None
            if page[i + 1 : i + 2] in ("!", "?"):
                return i, page.index(">", i) + 1, "", "", ""
            m = _NAME.match(page, i)
            if m:
                end = self._end(m.end())
                return i, end + 1, m[1], m[2], page[m.end() : end]
            at = i + 1
        return None

    def _end(self, at: int) -> int:
        """The place of the > that ends a tag: none within quotes that close before the page's last >."""
        first = self.page.find(">", at)
        if first < 0:
            return len(self.page)
        while (at := _PLAIN.match(self.page, at).end()) < len(self.page) and self.page[at] != ">":
            close = self._quote(self.page[at], at + 1)
            at = close + 1 if close < self.last else at + 1
        return at if at < len(self.page) else first


def _unescaped(text: str) -> str:
    """Character references decoded; numbers beyond Unicode are U+FFFD, however many digits they have."""
    return html.unescape(_NUMERIC.sub("\ufffd", _ZEROS.sub(r"&#\g<1>0", text))) if "&" in text else text


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first; text runs have tag "#", line breaks too with text "\\n".

    A script, frame, text area or drawing that is never closed takes the rest of the page, as in browsers.
    """
    nodes, stack, at, tags = [Node("#root", -1)], [0], 0, _Tags(page)
    opened: dict[str, int] = {}

    def text(s: str) -> None:
        if s:
            if opened.get("head") and not s.isspace():
                leave_head()
            nodes.append(Node("#", stack[-1], text=_unescaped(s)))

    def drop(k: int) -> None:
        for i in stack[k:]:
            opened[nodes[i].tag] -= 1
        del stack[k:]

    def leave_head() -> None:
        """What cannot stand in a head ends it, closed or not."""
        drop(next(k for k in range(1, len(stack)) if nodes[stack[k]].tag == "head"))

    def close(names: frozenset[str], stop: frozenset[str]) -> None:
        if not any(opened.get(n) for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in names:
                drop(k)
                return
            if tag in stop:
                return

    while found := tags.after(at):
        start, end, slash, name, attributes = found
        text(page[at:start])
        at = end
        if not name:
            continue
        tag = name.lower()
        if slash:
            if opened.get(tag):
                drop(next(k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == tag))
            continue
        if opened.get("head") and tag not in IN_HEAD:
            leave_head()
        if tag == "br":
            nodes.append(Node("#", stack[-1], text="\n"))
            continue
        if tag in CLOSES and tag != "p":
            close(CLOSES[tag], frozenset(["ul", "ol", "dl", "table", "select", "#root"]))
        if tag in ENDS_P:
            close(CLOSES["p"], KEEPS_P)
        names: list[str] = []
        for q in _NAMES.finditer(attributes):
            names.extend(_WORD.findall((q[1] or q[2] or q[3] or "").lower()))
        nodes.append(Node(tag, stack[-1], tuple(names)))
        if tag in RAW:
            if tag in FOREIGN and attributes.endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not attributes.endswith("/") and len(stack) <= MAX_DEPTH:
            stack.append(len(nodes) - 1)
            opened[tag] = opened.get(tag, 0) + 1
    text(page[at:])
    return nodes


def features(nodes: list[Node]) -> None:
    """keys: names of each node's features."""
    n = len(nodes)
    size, linked = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        x = nodes[i]
        if x.tag == "#":
            size[i] = len(x.text)
        elif x.tag == "a":
            linked[i] = size[i]
        p = x.parent
        size[p] += size[i]
        linked[p] += linked[i]
    for i, x in enumerate(nodes):
        if x.tag == "#":
            x.keys = ["text", f"under:{nodes[x.parent].tag}"]
            continue
        dense = 0 if not size[i] else 1 + (linked[i] * 3 > size[i]) + (linked[i] * 3 > 2 * size[i])
        x.keys = [f"tag:{x.tag}", f"links:{dense}", *(f"name:{w}" for w in x.names)]


@dataclass
class Model:
    unary: dict[str, float]
    pair: dict[tuple[str, int, int], float]


def _kind(x: Node) -> str:
    return "text" if x.tag == "#" else "inline" if x.tag in INLINE else "block"


def marginals(nodes: list[Node], model: Model) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """P(content) of each node, and of each node with its parent P(0, 0), P(0, 1), P(1, 0), P(1, 1) (parent's label first)."""
    n, get, exp, log = len(nodes), model.unary.get, math.exp, math.log
    odds = [0.0] * n  # logarithm of what the children say for content over what they say against it
    own0, own1, psi = [1.0] * n, [1.0] * n, [(1.0, 1.0, 1.0, 1.0)] * n
    table = {k: tuple(exp(model.pair.get((k, a, b), 0.0)) for a in (0, 1) for b in (0, 1)) for k in ("text", "inline", "block")}
    for i in range(n - 1, -1, -1):  # children come after their parents
        x = nodes[i]
        score = sum(get(k, 0.0) for k in x.keys)
        score = odds[i] + min(30.0, max(-30.0, score))
        if x.tag in NEVER:
            own0[i], own1[i] = 1.0, 0.0
        else:
            small = exp(-min(600.0, abs(score)))
            own0[i], own1[i] = (small / (1 + small), 1 / (1 + small)) if score > 0 else (1 / (1 + small), small / (1 + small))
        if i:
            p00, p01, p10, p11 = psi[i] = table[_kind(x)]
            odds[x.parent] += log((p10 * own0[i] + p11 * own1[i]) / (p00 * own0[i] + p01 * own1[i]))
    prob, both = [own1[0]] * n, [(0.0, 0.0, 0.0, 0.0)] * n
    for i in range(1, n):
        p00, p01, p10, p11 = psi[i]
        a, b = own0[i], own1[i]
        q = prob[nodes[i].parent]
        m0, m1 = p00 * a + p01 * b, p10 * a + p11 * b  # the belief of the parent less this child's message, times the joint
        r0, r1 = (1 - q) / m0, q / m1
        both[i] = (r0 * p00 * a, r0 * p01 * b, r1 * p10 * a, r1 * p11 * b)
        prob[i] = both[i][1] + both[i][3]
    return prob, both


def fit(pages: list[list[Node]], rounds: int = 25, rate: float = 0.3, decay: float = 1e-3) -> Model:
    """Weights by gradient ascent (AdaGrad) on the likelihood of labelled trees."""
    model, squares = Model({}, {}), {}
    for nodes in pages:
        features(nodes)
    order = random.Random(0)
    for _ in range(rounds):
        order.shuffle(pages)
        for nodes in pages:
            prob, both = marginals(nodes, model)
            grad: dict = {}
            for i, x in enumerate(nodes):
                if x.tag in NEVER:
                    continue
                diff = x.label - prob[i]
                for k in x.keys:
                    grad[k] = grad.get(k, 0.0) + diff
                if i and nodes[x.parent].tag not in NEVER:
                    seen = 2 * nodes[x.parent].label + x.label
                    for c in range(4):
                        k = (_kind(x), c >> 1, c & 1)
                        grad[k] = grad.get(k, 0.0) + (c == seen) - both[i][c]
            for k, g in grad.items():
                weights = model.pair if isinstance(k, tuple) else model.unary
                w = weights.get(k, 0.0)
                g -= decay * w
                squares[k] = squares.get(k, 1e-6) + g * g
                weights[k] = w + rate * g / math.sqrt(squares[k])
    return model


# Labelled pages: fixed lists of what sites call their parts.
_CONTENT_NAMES = ["content", "main", "article", "post", "entry", "story", "body", "text", "entry content", "article body", "post content", "main content"]
_OTHER_NAMES = [
    "ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "sidebar", "side", "widget", "related", "menu", "nav", "navigation", "navbar", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar", "footer", "bottom", "copyright", "cookie", "cookies", "consent", "notice", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe",
    "share", "social", "comments", "comment", "reply", "discussion", "disqus", "login", "search", "form", "tags", "meta", "pagination", "pager", "skip", "toolbar", "outbrain", "recommended",
]
_OTHER_TAGS = ["nav", "header", "footer", "aside", "form", "div", "div", "div", "section", "ul"]


def labelled_pages(n: int = 500, seed: int = 7) -> list[list[Node]]:
    """Pages of many layouts, drawn from rules, whose nodes carry their labels."""
    rng, out = random.Random(seed), []
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    say = lambda lo, hi: " ".join(rng.choices(words, k=rng.randint(lo, hi)))

    for _ in range(n):
        parts: list[tuple[str, int]] = []  # markup, label of what it opens

        def other(tag: str | None = None) -> None:
            tag = tag or rng.choice(_OTHER_TAGS)
            names = rng.sample(_OTHER_NAMES, rng.randint(0 if tag in ("nav", "header", "footer", "aside", "form") else 1, 2))
            attr = f' class="{" ".join(names)}"' if names else ""
            kind = rng.random()
            if tag == "ul" or kind < 0.25:
                items = "".join(f'<li><a href="/{w}">{say(1, 4)}</a></li>' for w in rng.sample(words, rng.randint(2, 9)))
                inner = items if tag == "ul" else f"<ul>{items}</ul>"
            elif kind < 0.35:
                inner = f"<label>{say(1, 3)}</label><input name=q><button>{say(1, 2)}</button>"
            elif kind < 0.55:
                h = rng.choice(["h1", "h2", "h3", "h4"])
                inner = f"<{h}>{say(1, 6)}</{h}>" + "".join(f"<p>{say(1, 40)}</p>" for _ in range(rng.randint(0, 3)))
            elif kind < 0.7:
                inner = "".join(f'<div class="{rng.choice(["comment", "reply", "item", "card"])}"><p>{say(4, 60)}</p></div>' for _ in range(rng.randint(1, 4)))
            else:
                inner = say(1, 40) if rng.random() < 0.5 else "".join(f"<p>{say(1, 60)}</p>" for _ in range(rng.randint(1, 3)))
            parts.append((f"<{tag}{attr}>{inner}</{tag}>", 0))

        def body() -> None:
            inner = [f"<h1>{say(2, 9)}</h1>"] if rng.random() < 0.8 else []
            for _ in range(rng.randint(1, 9)):
                r = rng.random()
                p = say(1, 120) if r < 0.9 else say(1, 3)
                if r < 0.25:
                    p = f"{say(1, 9)} <a href=x>{say(1, 3)}</a> {p}"
                elif r < 0.35:
                    p = f"<b>{p}<br>"  # never closed
                inner.append(rng.choice([f"<p>{p}</p>"] * 6 + [f"<h2>{say(1, 6)}</h2>", f"<ul><li>{say(2, 9)}</li><li>{say(2, 30)}</li></ul>", f"<blockquote>{p}</blockquote>", f"<div>{p}</div>", f"<pre>{p}</pre>", f"<table><tr><td>{say(1, 4)}</td><td>{say(1, 4)}</td></tr></table>"]))
            tag = rng.choice(["article", "article", "main", "div", "section"])
            names = rng.choice(_CONTENT_NAMES) if tag in ("div", "section") or rng.random() < 0.4 else ""
            attr = f' class="{names}"' if names else ""
            cuts = sorted(rng.randint(0, len(inner)) for _ in range(rng.choice([0, 0, 1, 1, 2])))
            open_with = f"<{tag}{attr}>"
            for x, y in zip([0, *cuts], cuts, strict=False):  # boilerplate within the article
                parts.append((open_with + "".join(inner[x:y]), 1))
                open_with = ""
                other(rng.choice(["div", "div", "aside", "form", "nav", "section", "footer"]))
            parts.append((f"{open_with}{''.join(inner[([0, *cuts])[-1] :])}</{tag}>", 1))

        for _ in range(rng.randint(0, 3)):
            other()
        wrap = rng.random() < 0.3
        if wrap:
            parts.append((f'<div class="{rng.choice(["wrap", "page", "container", "site"])}">', 2))
        for _ in range(rng.randint(0, 1)):
            other()
        if rng.random() < 0.06:  # paragraphs without a container
            parts.append(("".join(f"<p>{say(3, 90)}</p>" for _ in range(rng.randint(1, 5))), 1))
        elif rng.random() < 0.96:
            body()
        for _ in range(rng.randint(0, 3)):
            other()
        if wrap:
            parts.append(("</div>", 2))
        head = f"<html><head><title>{say(1, 6)}</title></head><body>" if rng.random() < 0.8 else ""
        marks = "".join(f"\x01{label}{m}" for m, label in [(head, 2), *parts, ("</body></html>", 2)])
        nodes, label, keep = parse(re.sub(r"\x01(\d)", r"<mark-\1></mark-\1>", marks)), 2, []
        place: dict[int, int] = {}
        for i, x in enumerate(nodes):
            if x.tag.startswith("mark-"):
                label = int(x.tag[-1])
                continue
            place[i] = len(keep)
            x.parent = place.get(x.parent, 0 if i else -1)
            x.label = 0 if label == 2 else label
            keep.append(x)
        out.append(keep)
    return out


@lru_cache(maxsize=1)
def trained() -> Model:
    return fit(labelled_pages())


def extract(page: str, model: Model) -> str:
    """The main text: each block's white space is one space, blocks are joined by one space."""
    nodes = parse(page)
    features(nodes)
    prob, _ = marginals(nodes, model)
    out: list[str] = []
    last = 0
    block = [0] * len(nodes)
    for i, x in enumerate(nodes):
        block[i] = block[x.parent] if i and x.tag in INLINE else i
        if x.tag == "#":
            block[i] = block[x.parent]
            if prob[i] >= 0.5 and not _hidden(nodes, i):
                if block[i] != last:
                    out.append(" ")
                    last = block[i]
                out.append(x.text)
        elif x.tag not in INLINE:
            out.append(" ")
    return _SPACES.sub(" ", "".join(out)).strip()


def _hidden(nodes: list[Node], i: int) -> bool:
    while i > 0:
        if nodes[i].tag in NEVER:
            return True
        i = nodes[i].parent
    return False


def extract_pages(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id_col, keep ..., text, n_chars) of every row. Null or empty html gives the empty text; pages without an
    article too; broken markup is read as far as it goes; repeated rows stay; other columns are ignored."""
    common.prepare(pages.sparkSession)
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h or "", model) for h in b.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, type=pa.string()), pa.array(map(len, texts), type=pa.int64())], [*names, "text", "n_chars"])

    names = [id_col, *keep]
    rows = pages.select(*names, F.col(html_col).alias("__html"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{schema}, text string, n_chars bigint")
