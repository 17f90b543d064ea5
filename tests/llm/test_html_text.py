import html
import random
import re
import time
from html.parser import HTMLParser

from exposure.llm.html_text import extract, page_text


class Plain(HTMLParser):
    """All text outside head, scripts and styles, without any layout."""

    def __init__(self):
        super().__init__()
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def test_query_keeps_every_visible_word(spark):
    from exposure.llm.queries import op5_html_layout

    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op5_html_layout(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        plain = Plain()
        plain.feed(pages[r.page_id])
        assert "".join(re.sub(r"(^|\n)\s*(- |\d+\. )", r"\1", r.text).split()) == "".join(plain.words)


def test_blocks_and_inline():
    assert page_text("<p>a<p>b <b>c</b>d<div>e</div>f<br>g<br><br>h") == "a\n\nb cd\n\ne\nf\ng\n\nh"
    assert page_text("<h1> T  x </h1>\n\n<p>one\n two</p>three") == "T x\n\none two\n\nthree"
    assert page_text("<span>a</span><span> b</span> <i>c</i>.") == "a b c."
    assert page_text("<pre>\n a\n   b &lt;\n</pre>z") == " a\n   b <\n\nz".lstrip("\n")


def test_lists():
    assert page_text("<ul><li>x<ul><li>y<li>z</ul><li>w</ul>") == "- x\n  - y\n  - z\n- w"
    assert page_text("<ol start=3><li>a</li><li>b</ol><p>c") == "3. a\n4. b\n\nc"
    assert page_text("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "a\n  b\nc\n  d"


def test_tables():
    assert page_text("<table><caption>C</caption><tr><th>A<th>Bbb<tr><td>1<td>2<br>3</table>x") == "C\nA | Bbb\n1 | 2\n  | 3\n\nx"
    assert page_text("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>bb<td>c</table>") == "wide cell | z\na | bb | c"
    assert page_text("<table><tr><td>日本<td>x<tr><td>abc<td>y</table>") == "日本 | x\nabc  | y"
    assert page_text("<table><tr><td>a<table><tr><td>b<td>c</table><td>d</table>") == "a     | d\nb | c |"


def test_tables_lose_no_word():
    pages = {
        "<table><tr>a <b>b</b><td>c</td></tr><tbody>d<tr><td>e</table>f": "c\ne\n\na b\nd\n\nf",
        "<table><tr><form><td>a</td></form></tr></table>": "a",
        "<table><tbody><td>a</td><th>b</tr><td>c<tr><td>d</table>": "a | b\nc\nd",
        "<table><tr><table><tr><td>a</table><td>b</table>": "a\n\nb",
        "<table><table><tr><td>x": "x",
        "<table><form><tr><td><table><tr><td>x": "x",
        "<table><b><table><tr><td>x<td>y</table></b><tr><td>z</table>": "z\n\nx | y",
        "<table><tr><td>a</td><div><table><tr><td>b</table></div><caption>c</caption></table>": None,
        "<table><colgroup><col><tr><td>a<td>b</table>": "a | b",
        "<p>a<svg><title/><path d='x'/><text>b</text></svg>c<math><mi>x</mi><mo>=</mo><mn>1</mn></math>": "a\nb\ncx=1",
    }
    for page, want in pages.items():
        plain = Plain()
        plain.feed(page)
        got = page_text(page)
        assert sorted("".join(got.replace("|", "").split())) == sorted("".join(plain.words)), page
        assert want is None or got == want, (page, got)
    assert page_text("<svg><desc>a</desc><a href=x/>b</a></svg><math><annotation>c</annotation></math><desc>d</desc>") == "bd"


def test_loose_content_anywhere():
    r = random.Random(11)
    parts = ["<table>", "<tr>", "<td>", "<th>", "<tbody>", "<tfoot>", "</td>", "</tr>", "</table>", "<form>", "</form>", "<div>", "</div>", "<b>", "</b>", "<caption>", "</caption>", "<colgroup>", "<col>", "<svg>", "<text>", "</svg>"]
    for _ in range(3000):
        page = "".join(r.choice(parts) + (f" w{k}w " if r.random() < 0.4 else "") for k in range(r.randint(1, 30)))
        assert sorted(re.findall(r"w\d+w", page_text(page))) == sorted(re.findall(r"w\d+w", page)), page


def test_hidden():
    assert page_text("<head><title>t</title></head><body>a<script>b</script><style>c</style><div hidden>d</div><p style='x:y; DISPLAY : none'>e</p><i aria-hidden=true>f</i><!-- g --><template>h</template>i") == "ai"
    assert page_text('<input type=hidden value=a><input value="b c"><img alt="d"><textarea>e\n f</textarea>') == "b cd\ne\n f"


def test_implied_and_broken_tags():
    assert page_text("<title>t</title>a<p>b</div></span>c") == "a\n\nbc"
    assert page_text("a < b && c &amp;amp; &eacute; &#x41; &nope;") == "a < b && c &amp; é A &nope;"
    assert page_text("<p title=\"a>b\" x='<p>'>c</p><a href=x/y>d") == "c\n\nd"
    assert page_text("x<a href=\"unclosed") == "x" and page_text("x<!-- unclosed <p>y") == "x" and page_text("x<script>y") == "x"
    assert page_text("<head><meta charset=x>body text") == "body text"
    assert page_text("") == "" and page_text("<") == "<" and page_text("</>") == "</>"


def test_time_is_linear():
    odd = ["<div>" * 60_000 + "x", "<a" * 60_000, '<a b="' * 40_000, "<![CDATA[" * 30_000, "<!--" * 30_000, "<p><b>" * 40_000, "</p>" * 60_000, "<table><tr><td>" * 300, "<ul><li>" * 3_000, "&" * 200_000, "<x y=" * 40_000]
    for page in odd:
        start = time.process_time()
        page_text(page)
        assert time.process_time() - start < 20, page[:20]


def test_never_raises():
    r = random.Random(7)
    parts = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<ul>", "<li>", "</ul>", "<pre>", "</pre>", "text ", "\n", "<br>", "<hr>", "<b", ">", "'", '"', "=", "<q>", "</q>", "<dl><dd>", "</dl>", "<head>", "<body>", "<!--", "-->", "&lt", "<option>", "<select>", "<caption>", "<td colspan=99999999>", "<ol start=x>", "</li>", "<textarea>", "</blockquote>", "<blockquote>"]
    for _ in range(1500):
        page_text("".join(r.choice(parts) for _ in range(r.randint(0, 40))))


def test_rows(spark):
    rows = [(None, None), (1, "<p>a"), (1, "<p>a"), (2, "")]
    got = extract(spark.createDataFrame([(i, h, "x") for i, h in rows], "page_id long, html string, text string")).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", "a"), ("1", "a"), ("2", ""), ("None", "")]
    assert extract(spark.createDataFrame([], "page_id long, html string")).collect() == []
    assert html.unescape("&copy;") == "©"
