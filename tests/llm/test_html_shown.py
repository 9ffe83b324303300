"""What browsers show of a page, and what they don't."""

import random
from html.parser import HTMLParser

import pytest

from lattica.llm.html_text import extract_text, page_text


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<table><tbody><td>x</td></tbody></table>", "x"),
        ("<table><thead><th>A</th><th>B</th></thead><tr><td>1<td>2</table>", "A  B\n1  2"),
        ("<table><td>x<td>y<tr><td>z</table>", "x  y\nz"),
        ("<table><tr><form><td>a</td><td>b</td></form></tr></table>c", "a  b\n\nc"),
        ("<table><tr>one<div>two</div><td>a</td></tr><tbody>three<tr><td>b</td></tbody></table>", "one\ntwo\nthree\n\na\nb"),
        ("<table><tr hidden>one<td>a</td></tr></table>", "one"),
        ("<table><colgroup>one<td>a</table>", "one\n\na"),
        ("<table><tr><td><table><td>in</table></td><td>out</table>", "in  out"),
        ("<table><tr><td>a<table><tr>x<td>b</table></table>", "ax\nb"),
        ("<table><tr><td>a</td><table><tr><td>b</table>", "a\n\nb"),
        ("<table><caption hidden>no</caption><tr><td>a</table>", "a"),
        ("<p title='a hidden gem'>x</p>", "x"),
        ("<p title='use display:none here' data-style='display:none'>x</p>", "x"),
        ("<p aria-hidden=true>x</p>", "x"),
        ("<p class=hidden style='color:red'>x</p>", "x"),
        ("<p style='display:none;display:block'>x</p>", "x"),
        ("<p hidden>x</p>y", "y"),
        ("<p id=a HIDDEN=''>x</p>y", "y"),
        ("<p style=display:none>x</p>y", "y"),
        ('<p style="color:red; Display : NONE !important; display:block">x</p>y', "y"),
        ("<p style='visibility:hidden'>x</p>y", "y"),
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>", "x=2"),
        ("a <textarea>\nb  c\nd</textarea> e", "a\nb  c\nd\ne"),
        ("<p>pick <select><option>a<option selected>b</select> now", "pick\na\nb\nnow"),
        ("<svg><defs/><title>no</title><defs><text>no</text></defs><text>a</text><text>b</text></svg>c", "a\nb\nc"),
        ("<div style='visibility:hidden'>no<p>no</p><p style='visibility:visible'>x</p></div>", "x"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c</tbody><tbody><tr><td>d</table>", "a  b\n   c\nd"),
        ("<table><tr><td colspan=3>a<td>b<tr><td>1<td>2<td>3<td>4</table>", "a        b\n1  2  3  4"),
        ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
        ("<table>" * 300 + "<tr><td>deep", "deep"),
        ("<script>no</script><template>no</template><noscript>no</noscript>x", "x"),
    ],
)
def test_shown(page, want):
    assert page_text(page) == want


def test_extract_text(spark):
    """Null, empty, repeated and long pages, columns of clashing names, an empty table."""
    shape = "page_id long, url string, html string, text long, n_chars string"
    long = "<p>word" * 50_000
    rows = [(1, "u", "<p>a", 5, "x"), (2, None, None, 5, "x"), (None, "u", "", None, None), (1, "u", "<p>a", 5, "x"), (1, "v", "<p>b", 6, "y"), (3, "w", long, 0, "")]
    got = sorted(map(tuple, extract_text(spark.createDataFrame(rows, shape)).collect()), key=repr)
    want = [(1, "u", "a", 1), (2, None, None, None), (None, "u", "", 0), (1, "u", "a", 1), (1, "v", "b", 1), (3, "w", "\n\n".join(["word"] * 50_000), 299_998)]
    assert got == sorted(want, key=repr)
    assert extract_text(spark.createDataFrame([], shape)).count() == 0


class Plain(HTMLParser):
    """The words that a page shows, by a second parser that knows no layout; for well-formed pages without hidden parts."""

    def __init__(self):
        super().__init__()
        self.unseen, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.unseen += tag in ("script", "style", "head", "noscript", "template")

    def handle_endtag(self, tag):
        self.unseen -= tag in ("script", "style", "head", "noscript", "template")

    def handle_data(self, data):
        if not self.unseen:
            self.words += data.split()


def test_same_words_as_another_parser():
    r = random.Random(8)

    def block(depth):
        kind = r.choice("p div ul ol table blockquote section pre h2 span".split()) if depth else "p"
        text = lambda: " ".join(f"w{r.randrange(999)}" for _ in range(r.randrange(1, 6)))
        inner = lambda: block(depth - 1) if depth > 1 else text()
        if kind in ("ul", "ol"):
            return f"<{kind}>" + "".join(f"<li>{inner()}</li>" for _ in range(3)) + f"</{kind}>"
        if kind == "table":
            return "<table>" + "".join("<tr>" + "".join(f"<td>{text()}</td>" for _ in range(2)) + "</tr>" for _ in range(3)) + "</table>"
        if kind in ("p", "pre", "h2", "span"):
            return f"<{kind}>{text()} <b>{text()}</b> &amp; {text()}</{kind}>\n"
        return f"<{kind}>{text()} {inner()} {text()}</{kind}>"

    for _ in range(60):
        page = "<html><head><title>no</title></head><body>" + "".join(block(r.randrange(4)) for _ in range(6)) + "<script>no()</script></body></html>"
        plain = Plain()
        plain.feed(page)
        words = [w for w in page_text(page).split() if w != "-" and not (w[:-1].isdigit() and w[-1] == ".")]
        # cells of several lines are set beside each other, so order is compared where there are none
        assert sorted(words) == sorted(plain.words)
        if "<table" not in page:
            assert words == plain.words
