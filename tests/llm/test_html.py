"""Main-text extraction: the query over all pages, and pages of unusual shapes."""

import html
import re

import pytest

from tessera.llm import html_extract, queries

DATA = "/root/testdata/sf0.01"
ARTICLE = "<article><h1>Title of it</h1><p>Some text that is long enough to be an article of sorts, with words and words.</p><p>Another paragraph of the text that goes on and on.</p></article>"
TEXT = "Title of it Some text that is long enough to be an article of sorts, with words and words. Another paragraph of the text that goes on and on."


def plain(page):
    """The text of the page's only article, whose markup is headings, paragraphs, bold runs and line breaks."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    assert set(re.findall(r"<([a-z0-9]+)", inner)) <= {"h1", "p", "b", "br"}
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(h1|p|br)>", " ", inner)))).strip()


def test_query_gives_each_page_its_article(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = queries.op5_html(spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r["page_id"]]
        assert r["url"] == page["url"] and r["n_chars"] == len(r["text"])
        assert r["text"] == plain(page["html"])


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>x</title></head><body>{}</body></html>",
        "<html><head><title>x</title><body>{}</body></html>",
        "<html><head><title>x</title><meta charset=utf-8>{}</html>",
        "<html><head><title>x</title></head><body><svg width=1 />{}<math/></body></html>",
        "<html><head><title>x</title></head><body><svg><p>drawn</p></svg>{}<iframe>frame without an end",
        "<html><head><script>a</script><style>b</style></head><body><nav><a href=x>menu</a></nav>{}</body></html>",
    ],
)
def test_page_shapes(page):
    assert html_extract.extract(page.format(ARTICLE), html_extract.trained()) == TEXT


@pytest.mark.parametrize("tag", sorted(html_extract.NEVER - html_extract.RAW))
def test_thousands_of_children(tag):
    model = html_extract.trained()
    for n in (500, 5_000):
        page = f"<html><body>{ARTICLE}<{tag}>{'<p>one two three' * n}</{tag}></body></html>"
        text = html_extract.extract(page, model)
        assert text.startswith(TEXT) and (tag == "head" or text == TEXT)


def test_wide_pages_through_spark(spark):
    rows = [(1, "u", f"<body>{ARTICLE}<select>{'<p>x' * 20_000}</select>", "a"), (2, None, None, "b"), (3, "v", "", "c")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_extract.extract_pages(df).collect()}
    assert got == {1: ("u", TEXT, len(TEXT)), 2: (None, "", 0), 3: ("v", "", 0)}
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_beliefs_of_wide_trees_are_sound():
    nodes = html_extract.parse("<div>" + "<p>word word word</p>" * 30_000 + "</div>")
    html_extract.features(nodes)
    prob, both = html_extract.marginals(nodes, html_extract.trained())
    assert all(0 <= p <= 1 for p in prob)
    assert all(abs(sum(b) - 1) < 1e-6 for b in both[1:])
