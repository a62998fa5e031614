"""Rendering of small pages, and a word-by-word comparison with a plain text walk."""

from html.parser import HTMLParser

import pytest

from textloom.llm import html_layout as h
from textloom.session import table

CASES = {
    "": "",
    "plain": "plain",
    "<p>one<p>two": "one\n\ntwo",
    "<div>a</div><div>b<br>c</div>": "a\nb\nc",
    "<h1>T</h1>text <b>bold</b>  more": "T\n\ntext bold more",
    "<ul><li>a<li>b</ul>": "- a\n- b",
    "<ol start=3><li>x</li><li value=9>y</li><li>z</li></ol>": "3. x\n9. y\n10. z",
    "<ul><li>a<ul><li>b</ul><li>c</ul>": "- a\n  - b\n- c",
    "<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>": "a   bbb\ncc  d",
    "<table><tr><th colspan=2>wide</th><th>z</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>": "wide  z\n1  2  3",
    "<table><tr><td rowspan=2>r</td><td>1</td></tr><tr><td>2</td></tr></table>": "r  1\n   2",
    "<pre>\n a\n   b</pre>c": " a\n   b\n\nc",
    "a<script>var x='</p>'</script>b<style>p{}</style>": "ab",
    "<head><title>no</title></head><body>yes": "yes",
    "<p hidden>no</p><p style='display: none'>no</p><p>yes": "yes",
    "<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span></div>": "yes",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>": "s\nt\nyes",
    "<!-- no --><!doctype html>a &amp; b &lt;c&gt;": "a & b <c>",
    "a < b and <unknown>c</unknown> </p>d": "a < b and c\n\nd",
    "<input type=hidden value=no><input type=submit value=Go><textarea>t\nu</textarea>": "Go\nt\nu",
    "<blockquote>q</blockquote>r": "  q\n\nr",
    "<p title='a>b'>x</p>": "x",
    "<html><head><title>T</title><h1>Hi</h1><p>text": "Hi\n\ntext",
    "<head><meta charset=x>\n text": "text",
    "<head><noscript><p>no</p></noscript><link rel=x><style>no</style><div>yes": "yes",
    "<table><thead><th>A<th>B<tbody><td>1": "A  B\n1",
    "<table><tbody>loose<p>par</p><tr><td>1</table>": "loose\n\npar\n\n1",
    "<table><tbody hidden>no<td>no<tbody><td>1</table>": "1",
    "<table><colgroup><col><td>1</table>": "1",
    "a<xmp><b>&amp;\n  c</xmp>d": "a\n\n<b>&amp;\n  c\n\nd",
    "<dialog>no</dialog><template>no</template><noscript>no</noscript>k": "k",
}


@pytest.mark.parametrize("page", CASES)
def test_case(page):
    assert h.render(page) == CASES[page]


def test_damaged_and_deep_pages():
    for page in ("<", "<p", "<p class='", "</", "<table><td>x", "<li>a<li>b", "<div>" * 5000 + "deep", "<b><i>x</b></i>y", "&#xfffff;&bad;", "<table colspan=x><tr><td colspan=-4 rowspan=zz>v"):
        assert isinstance(h.render(page), str)
    assert h.render("<div>" * 5000 + "deep") == "deep"
    assert h.render("<ul>" * 3000 + "<li>deep").strip() == "- deep"  # the mark stays at any depth


class Walk(HTMLParser):
    def __init__(self):
        super().__init__()
        self.words, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head", "title") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_all_visible_words_of_the_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r["page_id"]: r["text"] for r in h.extract(pages).collect()}
    for r in pages.collect():
        walk = Walk()
        walk.feed(r["html"])
        words = [w for w in got[r["page_id"]].split() if w != "-"]
        assert "".join(words) == "".join(w for w in walk.words if w != "-"), r["page_id"]


def test_table(spark):
    df = spark.createDataFrame([(1, "<p>x", "t"), (2, None, "t"), (None, "", "t"), (1, "<p>x", "t")], "page_id long, html string, text string")
    assert sorted(map(tuple, h.extract(df).collect()), key=repr) == sorted([(1, "x"), (2, ""), (None, ""), (1, "x")], key=repr)
    assert h.extract(df.limit(0)).collect() == []


def test_hidden_text_stays_hidden_at_any_depth():
    for depth in (10, 200, 3000, 20_000):
        assert h.render("<div>" * depth + "<div hidden>HIDDEN</div>x") == "x"
    assert h.render("<div>" * 3000 + "a<ul><li>b</ul>" + "</div>" * 3000 + "c") == "a\n\n- b\n\nc"
    assert h.render("<table><tr><td>" * 1500 + "in") == "in"


def test_long_cells_pad_no_other_rows():
    rows = "".join(f"<tr><td>{k}<td>x" for k in range(2000))
    page = f"<table><tr><td>{'y' * 20_000}<td>z{rows}</table>"
    got = h.render(page)
    assert len(got) < 4 * len(page) and "y" * 20_000 in got
    assert got.split("\n")[1:3] == ["0     x", "1     x"]
    words = h.render("<table><tr><td>" + "word " * 100 + "<td>b<tr><td>c<td>d</table>").split("\n")
    assert max(map(len, words)) <= 80 + 2 + 1 and " ".join(words).split().count("word") == 100
    assert words[0].index("b") == words[-1].index("d")


def test_wide_spans():
    assert h.render("<table><tr><td colspan=500>a<td>b<tr>" + "<td>1" * 3 + "</table>") == "a        b\n1  1  1"
    assert h.render("<table><tr><td rowspan=70000>a<td>b" + "<tr><td>c" * 3 + "</table>") == "a  b\n   c\n   c\n   c"
    assert len(h.render("<table><tr>" + "<td colspan=1000>x" * 500 + "</table>")) < 3000


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<!", '<a ">"', "</script ", "<script></script ", "<a <!--", "<a '\"", "<", "<b x='"])
def test_megabytes_of_unclosed_markup_take_seconds(unit):
    import time

    page = unit * (1_000_000 // len(unit))
    began = time.process_time()
    h.parse(page)
    small = time.process_time() - began
    assert small < 10  # a quadratic scan takes hours


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p title="a>b">x</p>', "x"),
        ('<p title="a>x</p>', "x"),  # a quote that isn't closed ends at the bracket
        ("<p title='a\">'>x<b>y", "xy"),
        ("a <!-- b > c", "a"),
        ("a <b", "a <b"),
        ("<title>t</title <p>u", "u"),
    ],
)
def test_brackets_and_quotes(page, text):
    assert h.render(page) == text
