"""Plain markup takes a short way; it must give the tree that the parser gives."""

import random

from folioq.dom import tree


def shape(e):
    return [e.tag, e.attrs, [shape(c) if isinstance(c, tree.Element) else c for c in e.children]]


def by_parser(html):
    builder = tree._Builder()
    builder.feed(html)
    builder.close()
    return builder.root


PIECES = ["<p>", "</p>", "<P class='a b'>", "<li>", "</li>", "<ul id=\"u\">", "</ul>", "<br/>", "<br />", "<img src=\"/x?a=1\" alt=''>", "<a href=\"/x/1?a=1#f\" data-id='7'>", "</a>", "<td>", "<table>", "</table>", "<h1\n title='x'\n>", "</h1>", "text", " two\nlines ", "&amp;", "&lt;b&gt;", "&nbsp", "& ", "&#65;", "é中", "\x00", "</b>", "<b a='1' a=\"2\">", "<x-y>", "<i a='&amp;'>", "< b", "<", ">", "<a b>", "<a b=c>", "<!-- c -->", "<script>x</p></script>", "<title>t &amp; u</title>", "<a href='/x'b=\"1\">", "</p >", "<p/ >", "<style>", "&", "\r\n\t", "<title>t</title>", "<script src='x'>var t = 1;</script>", "<STYLE>p{}</Style>", "<script/>", "<noscript></noscript>", "<textarea>&lt;b&gt;</textarea>", "<script>a && b</script>", "<title>t</script>"]


def test_both_ways_give_one_tree():
    rng, short = random.Random(7), 0
    for k in range(8000):
        html = "".join(rng.choice(PIECES[:29] + PIECES[-8:-5] if k % 4 else PIECES) for _ in range(rng.randrange(12)))
        assert shape(tree.parse(html)) == shape(by_parser(html)), html
        short += tree._plain(html) is not None
    assert short > 3000


def test_plain_markup_needs_no_parser(monkeypatch):
    monkeypatch.setattr(tree._Builder, "feed", lambda self, data: 1 / 0)
    doc = tree.parse('<div class="list box"><div class="item"><h3>n &amp; m</h3><a href="/x/1?a=1">go</a><p>By <i>b</i></p></div><span id="end">end</span></div>')
    assert [e.tag for e in doc.walk()] == ["div", "div", "h3", "a", "p", "i", "span"] and "".join(doc.texts()) == "n & mgoBy bend"
