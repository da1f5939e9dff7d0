"""Main text by page differencing."""

import random

from folioq.llm import html_extract as E

PAGE = """<html><head><title>T</title></head><body><div id="top-menu">Home About</div><header>Site</header><div class="cookie-notice">We use cookies</div>
<div id="content"><h1>Title &amp; more</h1><p class="ad">Buy</p><p>First   para <b>bold</b>text.</p><div>Shared line here</div><p>Second one<br>goes on</p></div>
<div class="sidebar"><p>Side</p></div><div class="comments"><p>Nice!</p></div><form><p>Mail</p></form><footer>Foot</footer></body></html>"""
ARTICLE = '<body><nav><a href="/x">x</a></nav><article><h1>H</h1><p><b>Open.<br><p>Same paragraph.</p><p>{}</p></article><aside>no</aside><script>var t="</p>";</script><p>outside</p></body>'
SCHEMA = "page_id bigint, url string, html string, text string"


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([rnd.choice(x) for _ in range(rnd.randrange(0, 12))] for x in ("abcde", "abcdf"))
        found = E.shared(a, b)
        rest = iter(b)
        assert len(found) == lcs(a, b) and all(x in rest for x in (a[k] for k in sorted(found)))


def test_lines():
    assert [t for t, _ in E.lines(PAGE)] == ["Title & more", "First para boldtext.", "Shared line here", "Second one goes on"]
    assert [t for t, _ in E.lines(ARTICLE.format("Own."))] == ["H", "Open.", "Same paragraph.", "Own."]
    assert E.lines("") == [] and E.lines("<p>a<span class='ad'>b<span>c</span></span>d") == [("ad", False)] and E.lines("plain &lt;x&gt;") == [("plain <x>", False)] and E.lines("<script>never ends") == []
    assert E.lines("<div style='display:none'>no</div><p>yes</p><div role=navigation>no</div>") == [("yes", False)]


def test_main_and_articles():
    page = "<main><p>crumbs</p><article><header><h1>H</h1></header><p>{}</p></article><article class='comment'><p>nice</p></article></main><div id='site-header'>S</div>"
    assert [t for t, _ in E.lines(page.format("text of the article"))] == ["H", "text of the article"]
    assert [t for t, _ in E.lines("<main><p>a long text that is no article</p><article>x</article></main><p>out</p>")] == ["a long text that is no article", "x"]
    assert [t for t, _ in E.lines("<nav><li>a<div class='menu'><main><li>one<li>two</main>")] == ["one", "two"]
    assert [t for t, _ in E.lines("<ul><li class='ad'>x<ul><li>y</li></ul>z</li><li>w</li></ul>")] == ["w"]
    assert [t for t, _ in E.lines("<div class='page-header'>S</div><div class='post-header'>T</div>")] == ["T"]


def test_neighbours(spark):
    other = PAGE.replace("First", "Other").replace("Second", "Third").replace("Title", "Name")
    rows = [(1, "http://h/a/1", PAGE, "z"), (2, "http://h/a/2", other, "z"), (3, "http://g/", PAGE, "z"), (4, "http://a/1", ARTICLE.format("One."), ""), (5, "http://a/2", ARTICLE.format("Two."), "")]
    got = {r["page_id"]: r["text"] for r in E.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == "Title & more First para boldtext. Second one goes on" and "Shared line here" not in got[2] and "Shared line here" in got[3]
    assert got[4] == "H Open. Same paragraph. One." and got[5] == "H Open. Same paragraph. Two."


def test_every_page_once_however_it_is_cut(spark):
    rows = [(k, f"http://h{k % 3}/p/{k % 40}", ARTICLE.format(f"Text {k}."), "") for k in range(300)]
    want = None
    for n in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted((r["page_id"], r["text"]) for r in E.extract(spark.createDataFrame(rows, SCHEMA)).collect())
        assert len(got) == 300 and (want is None or got == want)
        want = got
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_edges(spark):
    rows = [(1, None, None, "z"), (2, "http://h/a", None, "z"), (2, "http://h/a", None, "z"), (None, "http://h/a", PAGE, "z"), (5, "x", "<p>hi", "z"), (6, "y", "<p>" + "w " * 200_000, "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = E.extract(df).collect()
    assert len(got) == 6 and sorted(r["n_chars"] for r in got)[:3] == [0, 0, 0] and max(r["n_chars"] for r in got) == 399_999 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert E.extract(df.limit(0)).collect() == []


def test_alignment_by_halves(monkeypatch):
    monkeypatch.setattr(E, "BITS", 20)
    test_shared_lines_are_a_longest_common_subsequence()


def test_wrappers_and_names():
    only = lambda html: [t for t, _ in E.lines(html)]
    assert only('<div class="wrapper has-sidebar"><article><p>Real text</p></article></div>') == ["Real text"]
    assert only('<div id="page" class="layout no-comments"><article><p>Real text</p></article></div>') == ["Real text"]
    assert only('<div class="share"><article><p>Real text</p></article></div><p>out</p>') == ["Real text"]
    assert only('<article><p>Mine.</p></article><div class="comments"><article><p>Theirs.</p></article></div>') == ["Mine."]
    assert only('<article><p>One.</p><section class="related-work"><p>Two.</p></section><section class="related"><p>no</p></section><div class="comments-area">no</div></article>') == ["One.", "Two."]
    assert only("<main><header><h1>Head line</h1></header><p>Text.</p></main>") == ["Head line", "Text."]
    assert only("<p>a <math><mi>x</mi></math> b <canvas>old</canvas></p>") == ["a x b old"]
    assert only("<ul><li><a href='/1'>one</a></li></ul><p>t</p>") == ["one", "t"]


def paged(spark, pages):
    df = spark.createDataFrame([(k, f"http://h/d/{k:03d}", html) for k, html in enumerate(pages)], "page_id bigint, url string, html string")
    return [r["text"] for r in sorted(E.extract(df).collect(), key=lambda r: r["page_id"])]


def test_long_menus_copies_and_notices(spark):
    menu = "".join(f"<div>menu {k}</div>" for k in range(20))
    assert paged(spark, [menu + f"<div>own {k}</div>" for k in range(2)]) == ["own 0", "own 1"]
    # a run of copies: its inner pages have the next page of other lines as their mate
    pages = [menu + f"<div>text {k}</div>" for k in (0, 1, 1, 1, 1, 2)]
    assert paged(spark, pages) == ["text 0", "text 1", "text 1", "text 1", "text 1", "text 2"]
    # a near copy among others of the site tells nothing
    near = [f"<div>site</div><div>long text of page {k // 2} that two pages have</div><div>own {k}</div>" for k in range(8)]
    assert paged(spark, near) == [f"long text of page {k // 2} that two pages have own {k}" for k in range(8)]
    # a notice within marked articles goes, an article that many pages carry stays
    notice = "<p>Read our other stories.</p>"
    articles = [f"<article><p>The story of {k}, at length, with much to tell of it and of others too, as stories go.</p>{notice}</article>" for k in range(7)]
    assert all("other stories" not in t and t.startswith("The story") for t in paged(spark, articles))
    same = [f"<article><p>One.</p><p>Two and more.</p><p>Own {k}.</p></article>" for k in range(7)]
    assert paged(spark, same) == [f"One. Two and more. Own {k}." for k in range(7)]


def slow(rows):
    """Every page by a table of all pairs of lines, and mates looked for in the whole list."""
    import collections
    import re

    place = lambda u: re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)([^?#]*))?", u or "").groups("")
    rows = sorted(rows, key=lambda r: (place(r["url"])[0].lower(), place(r["url"])[1], r["url"] or "", r["page_id"]))
    runs = []
    for r in rows:
        page = E.lines(r["html"] or "")
        if not runs or runs[-1][0] != place(r["url"])[0].lower() or [t for t, _ in runs[-1][1]] != [t for t, _ in page]:
            runs.append((place(r["url"])[0].lower(), page, []))
        runs[-1][2].append(r)

    def common(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for k, (host, page, own) in enumerate(runs):
        for r in own:
            around = sorted([(k - j - 1, 0, j) for j in range(k - E.LOOK, k) if j >= 0] + [(j - k - 1, 1, j) for j in range(k + 1, k + 1 + E.LOOK) if j < len(runs)])
            found, seen = [], {tuple(t for t, _ in page)}
            for away, side, j in around:
                texts = tuple(t for t, _ in runs[j][1])
                if runs[j][0] == host and texts not in seen:
                    seen.add(texts)
                    found.append((-E._near(place(r["url"])[1], place(runs[j][2][0]["url"])[1]), away, side, texts))
            mates = [list(t) for *_, t in sorted(found)[: E.MATES]]
            for m in mates:
                got = E.shared([t for t, _ in page], m)
                assert len(got) == common([t for t, _ in page], m)
            yield r["page_id"], E.without_shared(page, mates)


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in E.op1_html_text(spark, sf).collect()}
    assert len(got) == len(rows) and got == {i: (t, len(t)) for i, t in slow(rows)}
    import re
    from html import unescape

    for r in rows:  # these pages mark their articles plainly
        inside = re.search(r"<article>(.*?)(?:</article>|<footer|$)", r["html"], re.S)[1]
        plain = " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inside))).split())
        assert got[r["page_id"]][0] == plain
