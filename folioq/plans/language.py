"""Queries of the rule language over responses that are built from the tables: URLs, lists, fields, scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from folioq.dom import jsonpath, xpath
from folioq.functions import urls as U
from folioq.operators import rules
from folioq.operators.batches import dealt
from folioq.plans.base import query, table
from folioq.rules import evaluate, links as K, urlrule
from folioq.rules.script import evaluated
from folioq.sources import fetch, rulesets


def _parts(spark: SparkSession, sf_dir: str, body: str, base: str = "https://h.test/b/{k}.html") -> DataFrame:
    """(page_id, url, html): a response for each part; {k}, {name}, {brand}, {size} stand for its columns."""
    def put(text: str):
        out = F.lit(text)
        for mark, c in (("{k}", F.col("p_partkey").cast("string")), ("{name}", F.col("p_name")), ("{brand}", F.col("p_brand")), ("{size}", F.col("p_size").cast("string"))):
            out = F.replace(out, F.lit(mark), c)
        return out

    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"))
    return part.select(F.col("p_partkey").alias("page_id"), put(base).alias("url"), put(body).alias("html"))


def _values(df: DataFrame, out: str, of, kind=StringType(), body: str = "html") -> DataFrame:
    return rules.mapped(df, body, "url" if "url" in df.columns else None, out, kind, of)


LIST = '<div class="list box"><div class="item"><h3>{name}</h3><a href="/x/{k}?a=1">go {size}</a><p>By <i>{brand}</i></p></div><div class="item odd"><h3>Second</h3><a href="y/{k}">z</a></div><span id="end">end</span></div>'


@query("SELECT p_partkey AS page_id, p_name || '|' || 'Second' AS legacy, p_name || '|Second' AS children, 'go ' || p_size AS by_text, p_name || '|' || 'Second' AS css FROM part")
def rule_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy names, children and text steps, and the CSS they stand for."""
    from folioq.dom.tree import parse
    from folioq.rules.extract import texts

    kind = StructType([StructField(c, StringType()) for c in ("legacy", "children", "by_text", "css")])

    def of(body: str, _: str) -> dict:
        doc = parse(body)
        say = lambda rule: "|".join(texts(doc, rule))
        return {"legacy": say("class.item@tag.h3@text"), "children": say("class.list box@children@tag.h3@text"), "by_text": say("text.go @text"), "css": say("@css:.item > h3@text")}

    return _values(_parts(spark, sf_dir, LIST), "_r", of, kind).select("page_id", "_r.*")


@query("SELECT p_partkey AS page_id, 'https://h.test/x/' || p_partkey || '?a=1' AS first, 'https://h.test/b/y/' || p_partkey AS second, p_brand AS inner_ FROM part")
def rule_list_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list rule's fields and their links, resolved against the page."""
    rows = rules.item_rows(_parts(spark, sf_dir, LIST), "class.item", {"bookUrl": "tag.a@href", "inner_": "p@i@text"})
    return rows.groupBy("page_id").agg(F.max(F.when(F.col("seq") == 0, F.col("bookUrl"))).alias("first"), F.max(F.when(F.col("seq") == 1, F.col("bookUrl"))).alias("second"), F.max("inner_").alias("inner_"))


@query("SELECT p_partkey AS page_id, 0::INTEGER AS seq, p_name AS name, p_brand || '-' || p_size AS kind FROM part UNION ALL SELECT p_partkey, 1, 'b', '-' FROM part")
def rule_regex_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regex list: fields are groups, rows with empty names go."""
    body = "<i>{name}</i><b>{brand}</b><u>{size}</u>;<i>b</i><b></b><u></u>;<i></i><b>x</b><u>y</u>;"
    return rules.item_rows(_parts(spark, sf_dir, body), ":<i>(.*?)</i><b>(.*?)</b><u>(.*?)</u>", {"name": "$1", "kind": "$2-$3"})


@query("SELECT p_partkey AS page_id, CAST(k AS INTEGER) AS seq, CASE k WHEN 0 THEN p_name ELSE NULL END AS name, 'https://h.test/v/' || p_partkey || '/' || k AS \"bookUrl\" FROM part, range(2) r(k)")
def rule_xpath_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An XPath list over well-formed XML; rows with empty names stay."""
    body = "<r><v u='/v/{k}/0'><n>{name}</n></v><v u='/v/{k}/1'><n></n></v></r>"
    return rules.item_rows(_parts(spark, sf_dir, body), "//v", {"name": "./n/text()", "bookUrl": "./@u"})


@query("SELECT p_partkey AS page_id, p_name || ',' || p_brand AS strings, '2' AS counted, 'true' AS said, p_brand AS second, p_name AS own FROM part")
def rule_xpath_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XPath values: node sets, numbers, truths, predicates; a field without a rule is its node's text."""
    kind = StructType([StructField(c, StringType()) for c in ("strings", "counted", "said", "second", "own")])

    def of(body: str, _: str) -> dict:
        doc = xpath.parse(body)
        node = xpath.evaluate(doc, "//a")[0]
        return {"strings": ",".join(xpath.strings(body, "//a")), "counted": "".join(xpath.strings(body, "count(//a)")), "said": "".join(xpath.strings(body, "count(//a) = 2")), "second": "".join(xpath.strings(body, "//a[2]")), "own": xpath.string_of(node)}

    return _values(_parts(spark, sf_dir, "<r><a>{name}</a><a c='1'>{brand}</a></r>"), "_r", of, kind).select("page_id", "_r.*")


JSON = '{"data":{"list":[{"id":{k},"n":"{name}","tags":["{brand}","x"],"o":{"s":{size}},"z":null}],"total":1}}'


@query("""SELECT p_partkey AS page_id, p_name AS first, p_brand || chr(10) || 'x' AS joined, '{"s":' || p_size || '}' AS object, NULL AS none, '/b/' || p_partkey || '?n=' || p_name AS embedded, '' AS nothing FROM part""")
def rule_json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSONPath first values and templates of them."""
    kind = StructType([StructField(c, StringType()) for c in ("first", "joined", "object", "none", "embedded", "nothing")])

    def of(body: str, _: str) -> dict:
        import json

        whole = json.loads(body)
        item = whole["data"]["list"][0]
        packed = (jsonpath.first(whole, "$.data.list[0].o") or "").replace(" ", "")
        return {"first": jsonpath.first(whole, "$.data.list[0].n"), "joined": jsonpath.first(whole, "$..tags"), "object": packed, "none": jsonpath.first(whole, "$.data.list[0].z"), "embedded": jsonpath.embedded(item, "/b/{$.id}?n={$.n}"), "nothing": jsonpath.embedded(item, "/b/{$.none}") or ""}

    return _values(_parts(spark, sf_dir, JSON), "_r", of, kind).select("page_id", "_r.*")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, NULL AS none, '/novel/' || event_type || '?id=' || json_extract_string(props, '$.k') AS link FROM events")
def event_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSONPath and an embedded path by the library, over stored JSON."""
    import json

    kind = StructType([StructField(c, StringType()) for c in ("k", "none", "link")])
    df = dealt(table(spark, sf_dir, "events").select("event_id", "event_type", "props")).select("event_id", "event_type", F.to_json(F.struct(F.from_json("props", "map<string,string>").alias("p"), F.col("event_type").alias("t"))).alias("html"))

    def of(body: str, _: str) -> dict:
        x = json.loads(body)
        return {"k": jsonpath.first(x, "$.p.k"), "none": jsonpath.first(x, "$.p.none"), "link": jsonpath.embedded(x, "/novel/{$.t}?id={$.p.k}")}

    return _values(df, "_r", of, kind).select("event_id", "_r.*")


@query("SELECT p_partkey AS page_id, p_name AS name, p_name || '/' || p_brand AS intro, 'k' || p_partkey AS kind, NULL AS author, 'https://h.test/c/' || p_partkey AS \"coverUrl\" FROM part")
def rule_stored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """@put and @get, {{...}} of stored values and of JSON, and the scope that init chooses."""
    found = {"init": "$.data.list[0]", "name": "@put:{who:n,br:$.tags[0]}$.n", "intro": "{{who}}/@get:{br}", "kind": "k{{$.id}}", "author": "@get:{nobody}", "coverUrl": "/c/{$.id}"}
    info = rules.info_rows(_parts(spark, sf_dir, JSON), found)
    return info.select("page_id", "name", "intro", "kind", "author", "coverUrl")


@query("SELECT p_partkey AS page_id, upper(p_name) AS name, 'no. ' || (p_partkey + 1) AS kind, md5(p_brand) AS author FROM part")
def rule_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts behind and within rules, with a library of their rule set and what the host gives them."""
    found = {"name": "h3@text@js:shout(result)", "kind": "{{'no. ' + next(" + "parseInt(baseUrl.match(/(\\d+)\\.html/)[1]))}}", "author": "i@text<js>java.md5Encode(result)</js>", "jsLib": '{"a":"function shout(x) { return x.toUpperCase(); }","b":"var next = n => n + 1;"}'}
    rows = _parts(spark, sf_dir, LIST)
    kind = StructType([StructField(c, StringType()) for c in ("name", "kind", "author")])

    def of(body: str, base: str) -> dict:
        ctx = evaluate.Context(base, library=found["jsLib"])
        scope = evaluate.items(body, "class.item.0", ctx)[0]
        return {c: evaluate.field(scope, found[c], ctx) for c in ("name", "kind", "author")}

    return _values(rows, "_r", of, kind).select("page_id", "_r.*")


@query("SELECT p_partkey AS page_id, 0::INTEGER AS seq, p_name AS name, 'https://h.test/js/' || p_partkey AS \"bookUrl\" FROM part UNION ALL SELECT p_partkey, 1, p_brand, 'https://h.test/js/' || p_size FROM part")
def rule_script_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list that a script makes."""
    body = "{name};{k}\n{brand};{size}"
    script = "<js>result.split('\\n').map(function (line) { var p = line.split(';'); return {name: p[0], link: '/js/' + p[1]}; })</js>"
    return rules.item_rows(_parts(spark, sf_dir, body), script, {"name": "name", "bookUrl": "link"}).select("page_id", "seq", "name", F.col("bookUrl"))


@query("SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 THEN 'cleaned ' || p_name ELSE p_name END AS body, CASE WHEN p_partkey % 2 = 0 THEN 'https://other/' ELSE 'https://h.test/' END AS url FROM part")
def login_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script that rewrites a response before it is parsed."""
    kind = StructType([StructField("body", StringType()), StructField("url", StringType())])
    script = "var r = JSON.parse(result); if (r.body.indexOf('LOGIN') == 0) { r.body = 'cleaned ' + r.body.substring(6); r.url = 'https://other/'; } JSON.stringify(r)"
    rows = _parts(spark, sf_dir, "{name}", "https://h.test/").withColumn("html", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("LOGIN "), "html")).otherwise(F.col("html")))
    return _values(rows, "_r", lambda b, u: dict(zip(("body", "url"), evaluate.checked(b, u, script))), kind).select("page_id", "_r.body", "_r.url")


@query("SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 0 THEN 'https://h.test/b/' || p_partkey || '.html' ELSE 'https://h.test/x/' || p_partkey END AS \"bookUrl\", p_name AS name FROM part")
def rule_detail_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that leads to a book's own page: no items, so the page is the book."""
    item = '<div class="it"><a href="/x/{k}">{name}</a></div>'
    rows = _parts(spark, sf_dir, item).withColumn("html", F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", r'<div class="it"><a [^>]*>([^<]*)</a></div>', "<h1>$1</h1>")).otherwise(F.col("html")))
    both = {"bookList": ".it", "name": "a@text||h1@text", "bookUrl": "a@href"}

    def of(body: str, base: str) -> list:
        found = evaluate.rows(body, base, both["bookList"], {"name": "a@text", "bookUrl": "a@href"})
        return found or [{k: b.get(k) for k in ("name", "bookUrl")} for b in evaluate.books(body, base, {"bookList": ".it", "name": "h1@text"})]

    kind = ArrayType(StructType([StructField("name", StringType()), StructField("bookUrl", StringType())]))
    return _values(rows, "_r", of, kind).select("page_id", F.explode("_r").alias("b")).select("page_id", "b.bookUrl", "b.name")


@query("SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS name FROM part")
def rule_explore_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explore rules where there are any, else those of the search."""
    search, own = {"bookList": ".s", "name": "b@text"}, {"bookList": ".e", "name": "i@text"}
    rows = _parts(spark, sf_dir, '<p class="e"><i>{name}</i></p><p class="s"><b>{brand}</b></p>')
    of = lambda body, base: evaluate.explore(body, base, own if int(base.split("/")[-1].split(".")[0]) % 2 == 0 else {"bookList": "  "}, search)[0]["name"]
    return _values(rows, "name", of).select("page_id", "name")


@query("SELECT p_partkey AS page_id, CAST(k - 1 AS INTEGER) AS \"index\", k || '. ' || CASE k WHEN 1 THEN p_name ELSE p_brand END AS title, 'https://h.test/c/' || k AS url, k = 2 AS \"isVip\" FROM part, range(1, 3) r(k)")
def rule_toc_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of contents whose page a script repairs and whose titles another numbers."""
    body = "<!-- <ul><li><a href='/c/1'>{name}</a></li><li class='vip'><a href='/c/2'>{brand}</a></li></ul> -->"
    toc = {"chapterList": "li", "chapterName": "a@text", "chapterUrl": "a@href", "isVip": "@class", "preUpdateJs": "result.replace('<!--', '').replace('-->', '')", "formatJs": "index + '. ' + title"}
    return rules.chapter_rows(_parts(spark, sf_dir, body), toc).select("page_id", "index", "title", "url", "isVip")


@query("SELECT p_partkey AS page_id, CAST(CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS \"index\", p_name AS title, true AS \"isVolume\", NULL AS next_url FROM part UNION ALL SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER), 'one', false, 'https://h.test/c/1' FROM part")
def rule_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes are rows without links of their own; a leading - turns the list round."""
    body = "<ul><li class='v'>{name}</li><li><a href='/c/1'>one</a></li></ul>"
    toc = {"chapterName": "text", "chapterUrl": "a@href", "isVolume": "@class"}
    rows = _parts(spark, sf_dir, body)
    both = [rules.chapter_rows(rows.where(f"page_id % 2 = {k}"), toc | {"chapterList": rule}) for k, rule in enumerate(("li", "-li"))]
    out = both[0].unionByName(both[1])
    return out.select("page_id", "index", "title", "isVolume", F.when(~F.col("isVolume"), F.col("url")).alias("next_url"))


@query("SELECT p_partkey AS page_id, p_name || chr(10) || 'b' AS content, 'https://h.test/b/' || p_partkey || '-2.html' AS next_url FROM part")
def rule_content_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content cut out by a pattern, cleaned by another, and the link to its next page."""
    body = "<html><!--s--><div id='c'><p>{name}AD</p><p>b</p></div><a id='n' href='{k}-2.html#x'>next</a><!--e--><div id='c'>no</div></html>"
    found = {"content": "#c", "sourceRegex": "(?s)<!--s-->(.*)<!--e-->", "replaceRegex": "##AD##", "nextContentUrl": "#n@href"}
    out = rules.content_rows(_parts(spark, sf_dir, body), found)
    return out.select("page_id", "content", F.regexp_replace("next_url", "#.*$", "").alias("next_url"))


@query("SELECT p_partkey AS page_id, '[' || p_name || ']' AS nested, p_name || '&&' || p_brand AS quoted, p_brand || chr(10) || p_name AS both FROM part")
def rule_splitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinators count outside brackets and quotes only; @@ parses a text anew."""
    from folioq.dom.tree import parse
    from folioq.rules.extract import field, items

    kind = StructType([StructField(c, StringType()) for c in ("nested", "quoted", "both")])

    def of(body: str, _: str) -> dict:
        e = items(parse(body), "article")[0]
        return {"nested": field(e, "textarea@text@@b@text"), "quoted": field(e, "p[title='a&&b']@data-x"), "both": field(e, "i@text&&u@text")}

    body = "<article><textarea>&lt;b&gt;[{name}]&lt;/b&gt;</textarea><p title='a&&b' data-x='{name}&&{brand}'>q</p><u>{name}</u><i>{brand}</i></article>"
    return _values(_parts(spark, sf_dir, body), "_r", of, kind).select("page_id", "_r.*")


# URLs


@query("""WITH e AS (SELECT event_id, event_type AS key, CAST(1 + user_id % 4 AS INTEGER) AS page FROM events), u AS (SELECT *, 'kw=' || url_encode(key || ' é') || '&p=' || CASE page WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END AS body FROM e)
SELECT event_id, 'https://s.test/find/' || key AS url, 'POST' AS method, replace(body, '+', '%20') AS body, 'r=1|ua=T|x-a=1' AS headers, CAST(3 AS INTEGER) AS retry, 'utf-8' AS charset, true AS "webView" FROM u""")
def url_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A URL rule to a whole request: scripts, placeholders, page choice, options with odd JSON, headers, a form's body."""
    rule = '<js>"/find/" + key</js>,{"method":"POST","charset":"utf-8","body":"kw={{key}} é&p=<a,b,c>","headers":{"X-A":"1"},"retry":3,"webView":true}'
    rows = dealt(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("key"), (1 + F.col("user_id") % 4).cast("int").alias("page")))
    got = fetch.requests(rows, rule.replace("</js>,", "</js>@result,"), base="https://s.test/list?x=1", headers="{'r':'1','User-Agent':'T'}")
    names = F.array_join(F.transform(F.filter(F.array_sort(F.transform("request.headers", lambda h: F.struct(F.lower(h["k"]).alias("k"), h["v"].alias("v")))), lambda h: F.lit(True)), lambda h: F.concat(F.replace(h["k"], F.lit("user-agent"), F.lit("ua")), F.lit("="), h["v"])), "|")
    return got.select("event_id", "request.url", "request.method", "request.body", names.alias("headers"), "request.retry", "request.charset", "request.webView")


@query("""SELECT p_partkey AS page_id, 'https://h.test/' || p_partkey AS url, '{"a":"x\\ny","b":' || p_size || '}' AS options, 'T' || p_size AS agent, 'a%20b=' || p_size || '&c=%u4E2D' AS escaped, '{"j":1}' AS kept FROM part""".replace("\\\\", "\\"))
def url_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options behind a URL, also with raw control characters; headers as people write them; bodies that stay and that don't."""
    import json

    kind = StructType([StructField(c, StringType()) for c in ("url", "options", "agent", "escaped", "kept")])

    def of(size: str, base: str) -> dict:
        url, given = urlrule.options(base + ',{"a":"x\ny","b":' + size + "}")
        return {"url": url, "options": json.dumps(given, separators=(",", ":")), "agent": urlrule.lenient_headers("{'User-Agent':'T" + size + "','proxy':'p'}")["User-Agent"], "escaped": urlrule.encoded_body(f"a b={size}&c=中", "escape", []), "kept": urlrule.encoded_body('{"j":1}', None, [])}

    return _values(_parts(spark, sf_dir, "{size}", "https://h.test/{k}"), "_r", of, kind).select("page_id", "_r.*")


@query("""SELECT p_partkey AS page_id, '/s?q={{key}}&p=<1,' || p_size || '>,{"headers":{"A":{"b":1}},"charset":"gbk","method":"POST","body":"k=' || p_partkey || '"}' AS legacy, '/plain/' || p_partkey AS plain FROM part""")
def url_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old URL syntax in today's."""
    kind = StructType([StructField("legacy", StringType()), StructField("plain", StringType())])

    def of(size: str, base: str) -> dict:
        return {"legacy": urlrule.legacy_url(f'/s?q=searchKey&p={{1,{size}}}@Header:{{"A":{{"b":1}}}}@body:k={base}|charset=gbk'), "plain": urlrule.legacy_url(f"/plain/{base}")}

    return _values(_parts(spark, sf_dir, "{size}", "{k}"), "_r", of, kind).select("page_id", "_r.*")


@query("SELECT p_partkey AS page_id, '' AS script, 'data:x' AS data, 'https://c.test/' || p_size AS protocol, 'https://h.test/b/z' AS relative, 'https://h.test/b/' || p_partkey AS cleaned FROM part")
def url_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links made absolute as the fetcher does; a source's URL without control characters."""
    kind = StructType([StructField(c, StringType()) for c in ("script", "data", "protocol", "relative")])
    of = lambda size, base: dict(zip(("script", "data", "protocol", "relative"), (urlrule.absolute(base, u) for u in ("javascript:void(0)", "data:x", f"//c.test/{size}", "z"))))
    rows = _parts(spark, sf_dir, "{size}", "https://h.test/b/{k}?x=1")
    said = U.cleaned(F.concat(F.lit(" \x01https://h.test/b/"), F.col("page_id"), F.lit("\x7f\n")))
    return _values(rows, "_r", of, kind).select("page_id", "_r.*", said.alias("cleaned"))


@query("""WITH u AS (SELECT p_partkey AS page_id, p_size AS n FROM part) SELECT page_id, n % 5 >= 2 AS numbered, n % 5 >= 2 AS under, false AS elsewhere, true AS asked FROM u""")
def next_page_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which links lead to a further page of the same text; as a column and as a function."""
    n = F.col("p_size") % 5
    first = F.concat(F.lit("https://h.test/b/"), F.col("p_partkey"), F.lit(".html"))
    link = F.concat(F.lit("https://h.test/b/"), F.col("p_partkey"), F.lit("-"), n, F.lit(".html"))
    rows = dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), first.alias("html"), link.alias("url")))
    told = rules.mapped(rows, "html", "url", "under", BooleanType(), K.next_page_follows)
    return told.select("page_id", U.next_page_follows(F.col("html"), F.col("url")).alias("numbered"), "under", U.next_page_follows(F.lit("https://other.test/b/1.html"), F.col("url")).alias("elsewhere"), U.next_page_follows(F.col("html"), F.concat("html", F.lit("?page=2"))).alias("asked"))


@query("SELECT p_partkey AS page_id, CAST(k AS INTEGER) AS seq, CASE k WHEN 0 THEN p_name ELSE p_brand END AS title, '/e/' || k AS url FROM part, range(2) r(k)")
def explore_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explore categories from JSON, from JSON with angle brackets, and from lines, by the part's number."""
    kind = ArrayType(StructType([StructField("title", StringType()), StructField("url", StringType())]))
    bodies = ('[{"title":"{name}","url":"/e/0"},{"title":"{brand}","url":"/e/1"},{"title":" "}]', '[<"title":"{name}","url":"/e/0">,<"title":"{brand}","url":"/e/1">]', "{name}::/e/0&&{brand}::/e/1\n::x")
    rows = None
    for k, body in enumerate(bodies):
        some = _parts(spark, sf_dir, body).where(f"page_id % 3 = {k}")
        rows = some if rows is None else rows.unionByName(some)
    of = lambda b, _: [{"title": x["title"], "url": x["url"]} for x in rulesets.explore_kinds(b)]
    return _values(rows, "_r", of, kind).select("page_id", F.posexplode("_r").alias("seq", "x")).select("page_id", "seq", "x.*")


@query("SELECT doc_id, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS n, upper(lang) || '/' || doc_id AS said FROM documents WHERE regexp_matches(text, '^[\\x00-\\x7F]*$')".replace("\\\\", "\\"))
def script_over_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script over whole texts (those in ASCII: what white space is differs beyond), with bindings."""
    kind = StructType([StructField("n", StringType()), StructField("said", StringType())])
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\A[\x00-\x7F]*\z")).select("doc_id", F.concat_ws("|", "lang", "doc_id").alias("url"), F.col("text").alias("html"))

    def of(text: str, both: str) -> dict:
        lang, number = both.split("|")
        return {"n": evaluated("result.trim().split(/\\s+/).length", text), "said": evaluated("`${lang.toUpperCase()}/${id}`", "", {"lang": lang, "id": int(number)})}

    return _values(docs, "_r", of, kind).select("doc_id", F.col("_r.n").cast("long").alias("n"), "_r.said")
