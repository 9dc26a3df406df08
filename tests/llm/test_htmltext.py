import re

import duckdb
import pytest

from loomframe.llm.htmltext import extracted, op10_layout_text, page_text
from tests.llm.conftest import SF

CASES = [
    ("<p>One<p>Two", "One\n\nTwo"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("a <b>bold</b>\n text", "a bold text"),
    ("a<br>b", "a\nb"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>after", "- x\n- y\n  - z\n\nafter"),
    ("<ol start=3><li>x</li><li>y</li></ol>", "3. x\n4. y"),
    ("<table><tr><th>Name<th>Size<tr><td>a<td>100<tr><td>longer<td>1</table>", "Name    Size\na       100\nlonger  1"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td colspan=2>wide<td>x<tr><td>1<td>2<td>3</table>", "wide  x\n1  2  3"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
    ("<script>var a = '<p>no</p>'</script><style>p{}</style>yes<!-- no -->", "yes"),
    ("<head><title>no</title></head><body>yes", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("a &amp; b &lt;c&gt; &nosuch; &#233;", "a & b <c> &nosuch; é"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<a title='x > y'>link</a>", "link"),
    ("<p>cut <b", "cut"),
    ("<p>a</div>b</p>", "ab"),
    ("", ""),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<h1>H</h1>text<h2>I</h2>", "H\n\ntext\n\nI"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_rendering(page, text):
    assert page_text(page) == text


def test_deep_and_long_pages():
    assert page_text("<div>" * 5000 + "x") == "x"
    assert page_text("<table><tr><td>" * 3000 + "x").strip() == "x"
    assert len(page_text("<p>" + "word " * 200_000)) == 999_999
    assert page_text('<a href="' * 3000 + "x") is not None
    assert page_text("<" * 50_000) == "<" * 50_000


def test_query(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())
    rows = op10_layout_text(spark, SF).collect()
    assert len(rows) == len(pages) and all(r.text == page_text(pages[r.page_id]) for r in rows)
    assert not any("track(" in r.text or "margin:0" in r.text for r in rows)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b")], "page_id long, html string, text string")
    out = extracted(df)
    assert out.columns == ["page_id", "html", "text", "_text"]
    assert sorted((r[0], r[3]) for r in out.collect()) == [(1, None), (2, ""), (2, "")]
    assert extracted(df.where("false")).count() == 0


MORE = [
    ('<div style="visibility:hidden">a<b style="visibility: visible">b</b>c</div>d', "b\nd"),
    ("<svg><title>no</title><text>drawn words</text></svg>", "drawn words"),
    ("<table><tr><td><p>a<p>b<td>x</table>", "a  x\n\nb"),
    ("<table><tr><td colspan=2>a long cell<td>z<tr><td>1<td>2<td>3</table>", "a long cell  z\n1  2         3"),
    ("<table><tr><td rowspan=200>a<td>b" + "<tr><td>c" * 199 + "<tr><td>d<td>e</table>", "\n".join(["a  b", *["   c"] * 199, "d  e"])),
    ("<table><tr><td>" + "w" * 80 + "<td>x<tr><td>y<td>z</table>", "w" * 80 + "  x\ny" + " " * 81 + "z"),
    ('<a href="data:' + "x>y" * 30_000 + '">link</a> after', "link after"),
    ("<p it's>one</p><p don't>two</p>", "one\n\ntwo"),
    ("<section hidden>" + "<div>" * 400 + "never seen" + "</div>" * 400 + "</section>", ""),
    ('<div style="visibility:hidden">' + "<i>" * 400 + "never seen", ""),
]


@pytest.mark.parametrize("page,text", MORE)
def test_visibility_spacing_and_long_markup(page, text):
    assert page_text(page) == text


def test_deep_pages_keep_their_layout():
    page = "<div>" * 3000 + "<ul><li>one<li>two</ul><p>three" + "</div>" * 3000
    assert page_text(page) == "- one\n- two\n\nthree"
    deep = "<ul><li>x" * 2000
    lines = page_text(deep).split("\n")
    assert len(lines) == 2000 and max(map(len, lines)) < 300 and all(x.strip() == "- x" for x in lines)


def test_padding_is_bounded():
    page = "<table>" + "".join(f"<tr><td>{'w' * 200_000 if i == 0 else 'a'}<td>b" for i in range(3000)) + "</table>"
    out = page_text(page)
    assert len(out) < 9 * 220_000 + (1 << 17) and out.count("b") == 3000


def plain_text(page):
    """The words of a page by another parser: the standard library's, with the same rules of what is seen."""
    from html.parser import HTMLParser

    unseen = {"head", "script", "style", "template", "noscript", "iframe", "noembed", "noframes", "title", "datalist", "object", "audio", "video", "canvas", "math", "desc", "metadata", "defs"}
    void = set("area base br col embed hr img input link meta param source track wbr".split())

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.out = [], []

        def handle_starttag(self, tag, attrs):
            a = {k: v or "" for k, v in attrs}
            if tag == "input" and a.get("type", "text") in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number") and not any(h for _, h in self.stack):
                self.out.append(a.get("value", ""))
            if tag in void:
                return
            style = a.get("style", "").replace(" ", "")
            hides = tag in unseen or "hidden" in a or "display:none" in style or "visibility:hidden" in style or (tag in ("details", "dialog") and "open" not in a)
            self.stack.append((tag, hides))

        def handle_endtag(self, tag):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    del self.stack[i:]
                    return

        def handle_data(self, data):
            if not any(h for _, h in self.stack):
                self.out.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    return "".join(" ".join(reader.out).split())


def test_query_has_the_words_of_another_parser(spark):
    """All pages: the characters of the text, without layout (white space, bullets, numbers of lists), are those that another parser finds visible."""
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())
    differ = []
    for r in op10_layout_text(spark, SF).collect():
        page = pages[r.page_id]
        if "<li" in page or "<ol" in page:
            got = "".join(w for line in r.text.split("\n") for w in re.sub(r"^[\s-]*(?:\d+\. |- )?", "", line).split())
            want = plain_text(page)
            ok = re.sub(r"[-\d.]", "", got) == re.sub(r"[-\d.]", "", want)
        else:
            ok = "".join(r.text.split()) == plain_text(page)
        if not ok:
            differ.append(r.page_id)
    assert not differ
