"""Files and feeds, built here."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioq.sources import charset, epub, feed, fetch, rulesets, store, txt


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


CONTAINER = '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'


def book(nav="", ncx="", spine='<spine><itemref idref="c1"/><itemref idref="c2"/><itemref idref="c1"/></spine>', extra=None):
    opf = f"""<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title><dc:creator>Me</dc:creator><meta name="cover" content="img"/></metadata><manifest>
    <item id="c1" href="a.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="b.xhtml" media-type="application/xhtml+xml"/><item id="img" href="img/cover.jpg" media-type="image/jpeg"/>
    {nav and '<item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>'}{ncx and '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'}</manifest>{spine}</package>"""
    files = {"META-INF/container.xml": CONTAINER, "OEBPS/content.opf": opf, "OEBPS/img/cover.jpg": "x", "OEBPS/a.xhtml": "<html><head><title>A page</title></head><body><h1>One</h1><script>bad()</script><p onclick='x()'>Text <img src='img/cover.jpg'><img src='other.png'><a href='http://x'>l</a></p></body></html>", "OEBPS/b.xhtml": "<html><body><p>two</p></body></html>"}
    files |= {"OEBPS/nav.xhtml": nav} if nav else {}
    files |= {"OEBPS/toc.ncx": ncx} if ncx else {}
    return zipped(files | (extra or {}))


def test_epub_navigation():
    got = list(epub.chapters(book(nav="<nav><ol><li><a href='a.xhtml'>Nav one</a></li><li><a href='b.xhtml#x'>Nav two</a></li></ol></nav>")))
    assert [(c["index"], c["title"]) for c in got] == [(0, "Nav one"), (1, "Nav two")] and got[0]["cover"] == "OEBPS/img/cover.jpg" and got[0]["author"] == "Me"
    assert "script" not in got[0]["html"] and "onclick" not in got[0]["html"] and "other.png" not in got[0]["html"] and "OEBPS/img/cover.jpg" in got[0]["html"] and "http://x" not in got[0]["html"]


def test_epub_ncx_and_fallback():
    ncx = "<ncx><navMap><navPoint><navLabel><text>Old one</text></navLabel><content src='a.xhtml'/></navPoint></navMap></ncx>"
    assert [c["title"] for c in epub.chapters(book(ncx=ncx))] == ["Old one", "第 2 章"]
    assert [c["title"] for c in epub.chapters(book())] == ["A page", "第 2 章"]


def test_epub_problems():
    assert list(epub.chapters(b"no zip"))[0]["problem"] and list(epub.chapters(book(extra={"../evil": "x"})))[0]["problem"]
    assert epub.safe_join("a/b", "../c.x") == "a/c.x" and epub.safe_join("a", "../../c") is None and epub.safe_join("", "/etc") is None


def test_epub_and_text_files(spark, tmp_path):
    (tmp_path / "b.epub").write_bytes(book())
    assert epub.read(spark, str(tmp_path)).count() == 2
    (tmp_path / "书.txt").write_bytes("﻿开篇\n先说几句。\n第1章 起程\n第一章正文。\n第二章 归来\n第二章正文。\n".encode())
    (tmp_path / "gb.txt").write_bytes("第一章起程\n正文\n第2章归来\n第3章\n".encode("gb18030"))
    (tmp_path / "plain.txt").write_bytes("nothing here\n".encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    books = txt.read(spark, str(tmp_path))
    assert books.count() == 3 and books.where('problem IS NOT NULL').count() == 0  # Spark doesn't list empty files
    got = {r["name"]: r["t"] for r in txt.chapters(books).join(books.select("bookUrl", "name"), "bookUrl").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("index", "title", "content"))).alias("t")).collect()}
    assert [(c["title"], c["content"]) for c in got["书"]] == [("序章", "开篇\n先说几句。"), ("第1章 起程", "第一章正文。"), ("第二章 归来", "第二章正文。")]
    assert [(c["title"], c["content"]) for c in got["gb"]] == [("第一章起程", "正文"), ("第2章归来", ""), ("第3章", "")]
    assert [(c["title"], c["content"]) for c in got["plain"]] == [("正文", "nothing here")]


def test_charsets(spark):
    page = '<html><head><meta charset="gb2312"></head>小说收藏排行榜</html>'.encode("gb18030")
    assert "小说收藏排行榜" in charset.decoded(page) and charset.decoded("飞卢小说".encode("gb18030"), None, "text/html; charset=GBK") == "飞卢小说" and charset.decoded(b"\xff", "nonsense") == "�"
    df = spark.createDataFrame([(1, page), (2, None)], "id int, body binary")
    assert [r["text"] is None for r in charset.with_text(df, "body").orderBy("id").collect()] == [False, True]


def test_feeds(spark):
    rss = '<rss><channel><item><title>A</title><link>http://a</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item><item><title>B</title></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>C</title><link href="http://c"/><updated>2024-01-02T00:00:00Z</updated><summary>s</summary></entry></feed>'
    rows = feed.read(spark.createDataFrame([("r", rss), ("a", atom), ("x", "<broken")], "origin string, body string"), now=7)
    assert {(r["title"], r["link"], r["order"]) for r in rows.collect()} == {("A", "http://a", 1704067200), ("B", None, 7), ("C", "http://c", 1704153600)}
    assert feed.newest(rows, 1).count() == 2


def test_rule_sets(spark):
    old = {"bookSourceUrl": "https://o", "bookSourceName": "Old", "ruleSearchUrl": "/s?q=searchKey&p={1,2}|charset=gbk", "ruleSearchList": ".l", "ruleSearchName": ".n@text", "serialNumber": "3", "bookSourceType": "AUDIO", "httpUserAgent": "UA", "ruleBookContent": "#c"}
    m = rulesets.migrated(old)
    assert m["ruleSearch"] == {"bookList": ".l", "name": ".n@text"} and m["ruleContent"] == {"content": "#c"} and m["bookSourceType"] == 1 and m["customOrder"] == 3 and json.loads(m["header"]) == {"User-Agent": "UA"}
    assert m["searchUrl"] == '/s?q={{key}}&p=<1,2>,{"charset":"gbk"}'
    new = {"bookSourceUrl": "https://n", "ruleSearch": '{"bookList":".x"}', "ruleToc": "null", "weight": "5", "enabled": False}
    assert rulesets.migrated(new)["ruleSearch"] == {"bookList": ".x"} and rulesets.migrated(new)["ruleToc"] == {} and rulesets.migrated(new)["weight"] == 5
    rows = rulesets.read(spark.createDataFrame([(json.dumps({"bookSourceList": [old, new]}),), (json.dumps([new]),), ("oops",)], "value string")).collect()
    assert len(rows) == 4 and sorted(r["bookSourceUrl"] or r["problem"][:7] for r in rows) == ["https://n", "https://n", "https://o", "no JSON"]
    assert [k["title"] for k in rulesets.explore_kinds("排行::/rank&&完本::/done")] == ["排行", "完本"] and rulesets.explore_kinds('[<"title":"a","url":"/x","style":<"w":1>>]') == [{"title": "a", "url": "/x", "style": {"w": 1}}]
    assert [b["bookUrl"] for b in rulesets.recovered('[{"bookUrl":"a"},{"bookUrl":"b"}]{"bookUrl":"a"} junk {"bookUrl": {"bookUrl":"c"}')] == ["a", "b", "c"]


def test_fetching(spark):
    calls = []

    def send(url, method, headers, body):
        calls.append(url)
        return (503, b"", "", url) if len(calls) < 3 else (200, "é".encode(), "text/html", url + "/final")

    got = fetch.fetched({"url": "http://x", "headers": [{"k": "A", "v": "b"}], "retry": 2}, send, 0)
    assert (got["status"], got["attempts"], got["body"], got["url"]) == (200, 3, "é", "http://x/final")
    rows = spark.createDataFrame([("k", 1), ("z", 2)], "key string, page int")
    req = fetch.requests(rows, "https://h/{{key}}?p={{page}}")
    pages = spark.createDataFrame([("https://h/k?p=1", "<p>")], "url string, html string")
    assert {(r["url"], r["status"]) for r in fetch.stored(req, pages).collect()} == {("https://h/k?p=1", 200), ("https://h/z?p=2", 404)}
    assert fetch.fetch(req, lambda u, m, h, b: (200, u.encode(), "", u), 0).count() == 2


def test_store(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("k string, v int")
    t = store.Table(spark, str(tmp_path / "t"), schema, ["k"])
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([("a", 1), ("b", 1)], schema), 1)
    t.upsert(spark.createDataFrame([("a", 2)], schema), 2)
    t.delete(spark.createDataFrame([("b", 0)], schema), 3)
    assert [(r["k"], r["v"]) for r in t.read().collect()] == [("a", 2)]
    rows = store.bundle({"x": t.read(), "y": spark.createDataFrame([(1,)], "z int")})
    assert store.unbundled(rows, "x", schema).collect()[0]["v"] == 2
    t.replace(spark.createDataFrame([("c", 1)], schema))
    assert [r["k"] for r in t.read().collect()] == ["c"]
    books = spark.createDataFrame([("b1",), ("local-x",)], "bookUrl string")
    ch = spark.createDataFrame([("b1", "u1"), ("b1", "u2"), ("local-x", "u1")], "bookUrl string, url string")
    assert {r["bookUrl"]: r["cachedChapterCount"] for r in store.cached_counts(books, ch, ch.where("url = 'u1'")).collect()} == {"b1": 1, "local-x": 0}
    with pytest.raises(Exception):
        store.Table(spark, "nosuch://x", schema, ["k"]).read().count()


def test_listing_and_feed_sources(spark, tmp_path):
    from folioq.sources import files

    (tmp_path / "d").mkdir()
    for name in ("b.txt", "a.txt", ".hidden", "d/c.txt"):
        (tmp_path / name).write_text("x")
    rows = files.listing(spark, str(tmp_path))
    assert sorted(r["name"] for r in rows.collect()) == ["a.txt", "b.txt", "c.txt"]
    assert [(r["name"], r["is_folder"]) for r in files.children(rows, f"file:{tmp_path}").collect()] == [("d", True), ("a.txt", False), ("b.txt", False)]
    feeds = spark.createDataFrame([('{"rssSources":[{"sourceUrl":"u","enabled":false},{"x":1}]}',), ("[",)], "value string")
    assert [(r["sourceUrl"], r["enabled"], r["problem"] is None) for r in rulesets.read_feeds(feeds).collect()] == [("u", False, True), (None, None, False)]
