"""The rule language by example."""

import pytest

from folioq.dom import css, jsonpath, xpath
from folioq.dom.tree import parse
from folioq.rules import evaluate as E, extract as X, links as L, modes as M, replace as R, selector as S, split as P, urlrule as U


@pytest.mark.parametrize(("rule", "kind"), [("@css:.test", "css"), ("@xpath://div", "xpath"), ("$.data.list", "json"), ("/html/body/div", "xpath"), (".class", "css"), ("js:return 1", "js"), ("<js>return 1</js>", "js"), (":<a>", "regex"), ("@regex:x", "regex")])
def test_modes(rule, kind):
    assert M.mode(rule) == kind


def test_mode_by_body():
    assert M.mode("name", '{"a":1}') == "json" and M.mode("name", "<p>") == "css" and M.ordered("-a") == ("a", True)


@pytest.mark.parametrize(("old", "new"), [("class.mod block", ".mod.block"), ("class.test", ".test"), ("id.main", "#main"), ("tag.div", "div"), ("mod block", ".mod.block"), (".x a", ".x a")])
def test_legacy_names(old, new):
    assert S.to_css(old) == new


def test_indexes():
    assert S.indexed(".test.0") == (".test", S.Indexes((0,))) and S.indexed(".test.-1")[1].items == (-1,) and S.indexed(".test!0")[1].exclude
    assert S.indexed("div[-1, 1:3]") == ("div", S.Indexes((-1, S.Range(1, 3))))
    assert S.indexed("a[href]") == ("a[href]", None)
    assert S.Indexes((S.Range(None, None, 2),)).positions(5) == [0, 2, 4] and S.Indexes((S.Range(9, 12),)).positions(3) == [] and S.Indexes((5, -9)).positions(3) == []
    assert S.Indexes((S.Range(3, 1, 1), 0)).positions(5) == [3, 2, 1, 0] and S.Indexes((0,), True).positions(0) == []


LIST = '<div><a href="/1">A</a><a href="/2">B</a><a href="/3">C</a><a href="/4">D</a></div>'


@pytest.mark.parametrize(("rule", "want"), [("a[1:2]@text", "BC"), ("a[!1,2]@text", "AD"), ("a[-1:0]@text", "DCBA"), ("a.0@text&&a.3@text", "AD"), ("a.9@text||a.1@text", "B"), ("a[0:1]@text%%a[2:3]@text", "ACBD"), ("a!0:1@text", "CD"), ("a[0:2]@text%%a.3@text", "ADBC")])
def test_slices_and_combinators(rule, want):
    assert X.texts(parse(LIST), rule) == list(want)


def test_attributes_and_brackets():
    d = parse('<div><a href="/book/1" data-id="q7">Book</a></div>')
    assert [X.texts(d, r) for r in ("a@attr[href]", "a@attr[data-id]", "a@href")] == [["/book/1"], ["q7"], ["/book/1"]]
    assert X.texts(parse('<div data-x="a&&b">Bad</div><span>Good</span>'), 'div[data-x="a&&b"]@text||span@text') == ["Bad"]


def test_extractors():
    e = css.select(parse("<p> a <b> b </b> c<script>s</script></p>"), "p")[0]
    assert X.value(e, "text") == "a b c s" and X.value(e, "ownText") == "a c" and X.value(e, "textNodes") == "a\nb\nc\ns"
    assert X.value(e, "html").startswith("<p> a <b>") and X.value(e, "title") is None
    assert X.field(e, "b") is None and X.texts(parse("<p>x</p>"), "p") == ["x"]
    assert X.texts(parse("<div data-h='&lt;i&gt;in&lt;/i&gt;'></div>"), "div@data-h@@i@text") == ["in"]
    assert X.all_text(parse("<p>a</p><p>b<br>c</p>"), "p") == "a\nb\nc"


def test_tree_is_tolerant():
    d = parse("<ul><li>a<li>b</ul><p><b>x<br><p>y<table><tr><td>1<td>2<tr><td>3</table>")
    assert [e.tag for e in d.elements()] == ["ul", "p", "p", "table"] and len(css.select(d, "li")) == 2 and len(css.select(d, "tr")) == 2 and len(css.select(d, "td")) == 3
    assert parse("").children == [] and css.select(d, ":::") == []


@pytest.mark.parametrize(("sel", "n"), [("a", 4), ("div > a:nth-child(2)", 1), ("a:not([href='/1'])", 3), ("a + a", 3), ("a ~ a", 3), ("a[href$='4'], a[href^='/1']", 2), ("a:last-child", 1), ("a:contains(B)", 1), ("div:has(a)", 1), ("*", 5), ("a:nth-child(odd)", 2)])
def test_css(sel, n):
    assert len(css.select(parse(LIST), sel)) == n


def test_replacement_chains():
    text = "Room 12 of 34"
    assert R.chained(text, *R.chain(r"##\d+##NUM")[1:]) == "Room NUM of NUM" and R.chained(text, *R.chain(r"##\d+##NUM###")[1:]) == "Room NUM of 34"
    assert R.chain("a##x") == ("a", [], False)
    assert R.replaced("ab", "(a)", "[$1$2]") == "[a]b" and R.replaced("ab", "(?=a)", "x") == "ab" and R.replaced("a(", "(", "x") == "a(" and R.replaced("a", "a", "$$") == "$"


def test_regex_list():
    got = E.books('<a href="/book/1">One</a><a href="/book/2">Two</a>', "https://books.example", {"bookList": ':<a href="([^"]+)">([^<]+)</a>', "name": "$2", "bookUrl": "$1"})
    assert [(b["name"], b["bookUrl"]) for b in got] == [("One", "https://books.example/book/1"), ("Two", "https://books.example/book/2")]
    assert E._captured(("/1", "第一章"), "$0") == "$0"


def test_json_rules():
    assert E.field(E.Scope("json", {"data": {"name": "书名", "author": "作者"}}), "作者：{$.data.author}", E.Context()) == "作者：作者"
    got = E.explore('{"data":[{"heading":"山间来信","writer":"作者","code":"q7"}]}', "https://shelf.test/x", {}, {"bookList": "$.data[*]", "name": "heading", "author": "$.writer", "bookUrl": "/work/{{$.code}}"})
    assert [(b["name"], b["bookUrl"]) for b in got] == [("山间来信", "https://shelf.test/work/q7")]
    v = {"a": [{"b": 1, "c": "x"}, {"b": 2}], "d": {"b": 3}}
    assert jsonpath.values(v, "$..b") == [1, 2, 3] and jsonpath.values(v, "$.a[?(@.b > 1)].b") == [2] and jsonpath.values(v, "$.a[-1].b") == [2] and jsonpath.values(v, "$.a[0:1].c") == ["x"]
    assert jsonpath.first(v, "$.d") == '{"b":3}' and jsonpath.first(v, "$.x") is None and jsonpath.embedded(v, "{$.x}") == "" and jsonpath.items(v, "$.a") == v["a"]


def test_stored_values_and_fallback():
    info = E.book_info('<div class="name">Alias</div><div class="author">Tester</div>', "https://b", {"init": "@put:{alias:.name@text}", "name": "Book-@get:{alias}", "author": ".author@text"})
    assert (info["name"], info["author"], info["tocUrl"]) == ("Book-Alias", "Tester", "https://b")
    page = '<div class="name">Lone Page</div><div class="author">A</div>'
    assert [b["name"] for b in E.books(page, "https://b", {"name": ".name@text"})] == ["Lone Page"] and E.books(page, "https://b", {"name": ".name@text"}, "x") == []


def test_chapters():
    rules = {"chapterList": "#chapterlist a", "chapterName": "@text", "chapterUrl": "@href"}
    page = '<div id="chapterlist"><a href="/1">a</a><a href="/2">b</a><a href="/1">c</a></div>'
    got, _ = E.chapters(page, "https://t.example/x", rules)
    assert [(c["index"], c["title"], c["url"]) for c in got] == [(0, "a", "https://t.example/1"), (1, "b", "https://t.example/2")]
    assert [c["title"] for c in E.chapters(page, "https://t.example/x", rules | {"chapterList": "-#chapterlist a"})[0]] == ["b", "a"]
    got, _ = E.chapters('<ul class="dirList"><li><a href="/c1.html">第一章</a></li></ul>', "https://toc.example", {"chapterList": "@css:.dirList li a", "chapterName": "text", "chapterUrl": "href"})
    assert got[0]["url"] == "https://toc.example/c1.html"
    scripted, _ = E.chapters(page, "https://t.example/x", rules | {"formatJs": "up"}, {"up": lambda v, b: f"{b['index']}.{v}"})
    assert [c["title"] for c in scripted] == ["1.a", "2.b"]


def test_xpath():
    xml = '<r><b id="1"><n>A</n></b><b id="2"><n>B</n></b></r>'
    assert xpath.strings(xml, "//b/n") == ["A", "B"] and xpath.strings(xml, "//b[@id='2']/n/text()") == ["B"] and xpath.strings(xml, "//b[last()]/@id") == ["2"] and xpath.strings(xml, "count(//b)") == ["2"]
    assert xpath.strings("<p><b>", "//b") == [] and xpath.strings(xml, "//b[contains(n,'A')]/@id") == ["1"] and xpath.strings(xml, "/r/b[1]/following-sibling::b/n") == ["B"]
    assert [b["name"] for b in E.books(xml, "https://x.example/", {"bookList": "//b", "name": "./n", "bookUrl": "@id"})] == ["A", "B"]


def test_content_pages():
    text, ahead = E.content('<div id="c"><p>one</p><p>two ad</p></div><a class="n" href="1-2.html">next</a>', "https://a.test/chapters/1.html", {"content": "#c", "replaceRegex": "## ad##", "nextContentUrl": ".n@href"})
    assert (text, ahead) == ("one\ntwo", "https://a.test/chapters/1-2.html")
    assert L.next_page_follows("https://a.test/chapters/1.html", ahead) and not L.next_page_follows("https://a.test/chapters/1.html", "https://a.test/chapters/2.html")


@pytest.mark.parametrize(("text", "want"), [("", False), ("null", False), (None, False), ("false", False), ("no", False), ("not", True), ("0", False), ("true", True), ("1", True), ("VIP", True), (" Off ", False)])
def test_truth(text, want):
    assert E.truthy(text) is want


@pytest.mark.parametrize(("base", "link", "want"), [("https://a/b/c", "/x y", "https://a/x%20y"), ("https://a/b/c", "d", "https://a/b/d"), ("https://a/b", "", "https://a/b"), ("https://a", "//h/ü", "https://h/%C3%BC"), ("https://a/b#f", "?q=1", "https://a/b?q=1"), ("https://a/", "https://z/%20##$##x", "https://z/%20")])
def test_resolve(base, link, want):
    assert L.resolve(base, link) == want


def test_urls():
    r = U.compile_url('/search?q={{key}}&page=<1,2,3>,{"headers":{"Referer":"https://r"},"retry":3,"type":"hex"}', "远山", 2, "https://a.test", '{"X-Token":"t"}')
    assert (r.url, r.retry, r.as_hex) == ("https://a.test/search?q=%E8%BF%9C%E5%B1%B1&page=2", 3, "hex") and [k for k, _ in r.headers] == ["User-Agent", "X-Token", "Referer"]
    assert U.compile_url('https://x/s?t=1&k={{key}},{"charset":"gbk"}', "远山").url.endswith("k=%D4%B6%C9%BD")
    assert U.compile_url('https://x/s,{"method":"POST","body":"line1\nline2"}').body == "line1\nline2"
    assert U.compile_url("/find/by/{key}/{page}.html", "河灯", 3, "https://b.test").url == "https://b.test/find/by/%E6%B2%B3%E7%81%AF/3.html"
    assert U.lenient_headers("{'A':'b', 'C': \"d\"}") == {"A": "b", "C": "d"} and U.page_choice("/<a,b>", 9) == "/b" and U.escaped("é 中") == "%E9%20%u4E2D"
    assert U.compile_url("<js>k</js>/x?r=@result", scripts={"k": lambda v, b: "1"}, base="https://h").url == "https://h/x?r=1"


def test_splitting():
    assert P.combined("a[x='&&']&&b") == ("&&", ["a[x='&&']", "b"]) and P.steps("a@b@@c") == ["a", "b@@c"] and P.parses("a@b@@c") == ["a@b", "c"]


def test_a_rule_is_split_once_for_all_rows(monkeypatch):
    rule, seen = "tag.b@text||tag.i@text", []
    monkeypatch.setattr(P, "split", lambda text, mark, real=P.split: (seen.append(text), real(text, mark))[1])
    for k in range(20):
        got = E.rows(f"<p class='r'><i>{k}</i></p>", "https://h.test/", "class.r", {"name": rule, "kind": "@put:{n:tag.i@text}k{{n}}"})
        assert got[0]["name"] == str(k) and E.field(E.document(f"<i>{k}</i>", "css"), "i@text", E.Context()) == str(k)
    assert seen.count(rule) == 1
    P.steps("a@b").append("c")  # a caller's list is its own
    assert P.steps("a@b") == ["a", "b"] and P.combined("a&&b")[1] == ["a", "b"]
