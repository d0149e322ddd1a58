"""Page structure: rows of tags, elements that end where they close, one pass over long pages."""

import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sitelens.functions import html as h
from sitelens.operators import contacts
from sitelens.operators.crawlplan import extract_links

PAGE = """<!DOCTYPE html><HTML lang=de><!-- <b>no</b> --><script>var x = "<i>"</script>
<a HREF='/a?x=1&amp;y=2' class="b c" disabled data-x=7 class=late>A &lt;b&gt;</a>plain <br/> text
<form action="/send"><input type="email" name=mail><textarea name='t'></textarea></form><style>p{}</style><p>end"""


class Tags(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows = []

    def handle_starttag(self, tag, attrs):
        found = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        self.rows.append([tag, False, found, ""])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.rows.append([tag, True, {}, ""])

    def handle_data(self, data):
        if self.rows and self.rows[-1][0] not in ("script", "style"):
            self.rows[-1][3] += data


def frame(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_no int, html string")


def rows(spark, page):
    found = h.page_elements(frame(spark, page), "page_no").orderBy("pos").collect()
    return [(r.tag, r.closing, r.attributes, r.text) for r in found]


def test_rows_of_tags_as_a_parser_reads_them(spark):
    parser = Tags()
    parser.feed(PAGE)
    want = [tuple(r) for r in parser.rows if r[0] not in ("script", "style")]
    got = [r for r in rows(spark, PAGE)]
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert ["".join(r[3].split()) for r in got] == ["".join(r[3].split()) for r in want]
    assert rows(spark, "") == rows(spark, None) == rows(spark, "no tags < here") == []


@pytest.mark.parametrize(("page", "text"), [
    ('<div itemtype="https://schema.org/PostalAddress">1 High <div>Street <div></div></div>York</div> no</div>', "1 High Street York"),
    ("<p>x</p><ADDRESS>12 Low <b>Street</b>, Leeds</address><address>other one here</address>", "12 Low Street , Leeds"),
    ("<address>never closed, to the end<p>of it", "never closed, to the end of it"),
    ("<address>one two three <addressee>four</addressee></address>five", "one two three four"),
    ("<p>none</p>", None), ("", None), (None, None),
])
def test_element_text(spark, page, text):
    found = frame(spark, page).select(contacts.postal_address(F.col("html"))["text"]).first()[0]
    assert found == text


def test_links_of_unclosed_anchors(spark):
    page = "<a href='/contact'>Us<a href='/about'>About</a><a name=x>no</a><A class=q href=/privacy >Privacy"
    pages = frame(spark, page).select(F.lit("a.com").alias("site"), "page_no", F.lit("https://a.com/").alias("final_url"), "html")
    assert sorted(r.url for r in extract_links(pages, ("com",)).collect()) == [
        "https://a.com/about", "https://a.com/contact", "https://a.com/privacy"]


@pytest.mark.parametrize("unit", [
    "<div itemtype='PostalAddress'>street <div>x</div> ", "<address>y ", "<script>z ", "<!-- c ", "<a href='/contact'>t ",
    "<form><input name=a>", "<p class='x' id=\"y\">text</p>",
])
def test_long_pages_take_time_in_proportion(spark, unit):
    def seconds(size):
        page = frame(spark, unit * (size // len(unit))).withColumns({
            "site": F.lit("a.com"), "final_url": F.lit("https://a.com/")})
        work = [page.select(F.size(h.elements(F.col("html"))), F.length(h.visible_text(F.col("html")))),
                page.select(contacts.postal_address(F.col("html")), contacts.contact_form(F.col("html"), F.col("final_url"))),
                extract_links(page, ("com",)).groupBy().count()]
        start = time.perf_counter()
        for w in work:
            w.collect()
        return time.perf_counter() - start

    seconds(50_000)
    assert seconds(5_000_000) < 20 * max(seconds(500_000), 0.5)
