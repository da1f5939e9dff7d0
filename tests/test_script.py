"""The script interpreter, alone and in rules."""

import pytest

from folioq.rules import evaluate as V
from folioq.rules.script import ScriptError, evaluated as run

CASES = [
    ("result.replace(/o/g, '0')", "foo boo", "f00 b00"),
    ("var parts = result.split(';'); parts.map(function (p) { return p.trim() + '!'; }).join('|')", "x; y", "x!|y!"),
    ("JSON.stringify({n: 1, list: [2, 2.5, 'z'], none: null})", "", '{"n":1,"list":[2,2.5,"z"],"none":null}'),
    ("let s = 0; for (let i = 0; i < 6; i++) { if (i % 2) continue; if (i > 4) break; s += i } s", "", "6"),
    ("`${title}/${index + 1}`", "", "T/3"),
    ("(function () { var m = result.match(/(\\d+)-(\\d+)/); return m ? m[2] : 'no' })()", "a 12-34 b", "34"),
    ("[3, 1, 2].sort((a, b) => b - a).filter(x => x > 1).reduce((a, b) => a + b, 0)", "", "5"),
    ("if (result == 'go') { 'yes' } else 'no'", "stop", "no"),
    ("try { nothing.there } catch (e) { 'caught' }", "", "caught"),
    ("var o = {}; o.a = {b: 1}; o.a.c = [1]; o.a.c.push(2); JSON.stringify(o)", "", '{"a":{"b":1,"c":[1,2]}}'),
    ("parseInt('17px') + Number('0x10') + Math.floor(2.7)", "", "35"),
    ("java.md5Encode('a').substring(0, 4) + java.base64Decode(java.base64Encode('é'))", "", "0cc1é"),
    ("kv_put('k', 'v'); kv_get('k') + cache.get('k') + (cache.get('none') || '-')", "", "vv-"),
    ("result.replace(/(\\w+) (\\w+)/, '$2 $1')", "one two", "two one"),
    ("result.replace(/\\d/g, d => d * 2)", "a1b2", "a2b4"),
    ("typeof unknown === 'undefined' ? 'u' : 'd'", "", "u"),
    ("'1' == 1 && '1' !== 1 && null == undefined && !(null == 0)", "", "true"),
    ("null", "", ""),
    ("var a = [1]; a[2] = 3; a.length + ':' + a", "", "3:1,,3"),
    ("for (var k in {x: 1, y: 2}) { var last = k } last", "", "y"),
    ("encodeURIComponent('a b&é') + decodeURIComponent('%C3%A9')", "", "a%20b%26%C3%A9é"),
]


@pytest.mark.parametrize("script, value, want", CASES)
def test_scripts(script, value, want):
    assert run(script, value, {"title": "T", "index": 2}) == want


@pytest.mark.parametrize("script", ["while (true) {}", "nothing()", "1 +", "class A {}", "throw 'x'", "null.x", "break"])
def test_what_fails(script):
    with pytest.raises(ScriptError):
        run(script)


def test_library():
    assert run("twice(3)", library="function twice(x) { return 2 * x }") == "6"
    assert run("a() + b", library='{"one":"function a() { return 1 }","two":"var b = 2","far":"https://x/y.js"}') == "3"


def test_in_rules():
    ctx = V.Context("https://h/1", bindings={"key": "K"})
    scope = V.items("<p class='a'>text</p>", ".a", ctx)[0]
    assert V.field(scope, "text@js:result + '/' + baseUrl", ctx) == "text/https://h/1"
    assert V.field(scope, "{{key.toLowerCase()}}-{{1 + 1}}", ctx) == "k-2" and V.field(scope, "text@js:broken(", ctx) is None
    given = V.Context("", scripts={"mine": lambda value, env: value.upper()})
    assert V.field(scope, "text@js:mine", given) == "TEXT"


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    from folioq.streaming import incremental as I

    schema = "name string, author string, source_index int"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kind = spark.createDataFrame([], schema).schema
    seen = []

    def go():
        I.search(I.arriving(spark, str(tmp_path / "in"), kind, 1), str(tmp_path / "out"), str(tmp_path / "offsets"), 4, on_batch=lambda *x: seen.append(x)).awaitTermination()

    put(0, [("a", "x", 0), ("b", "x", 0), ("A ", "x", 0)])
    go()
    put(1, [("c", "x", 1), ("a", "x", 1)])
    go()
    put(2, [("d", "x", 2), ("e", "x", 2)])
    go()
    put(3, [("f", "x", 3)])
    go()
    assert [t for _, t, _ in seen] == [2, 3, 5] and [last for _, _, last in seen] == [0, 1, 2]
    assert I.progress(spark, str(tmp_path / "out"), kind, enough=4) == {"total": 5, "last": 2, "has_more": False}


def test_chapter_books_keeps_repeated_chapters(spark):
    from folioq.operators.joins import chapter_books

    chapters = spark.createDataFrame([("http://h/a/b/1", 1), ("http://h/a/b/1", 1), ("http://h/a", 2), ("http://g/a/b/1", 3), (None, 4)], "url string, k int")
    books = spark.createDataFrame([("http://h/a/b", 2), ("http://h/a/b/1", 1), ("http://h/z", 0)], "bookUrl string, seq int")
    got = sorted((r["k"], r["bookUrl"]) for r in chapter_books(chapters, books).collect())
    assert got == [(1, "http://h/a/b/1"), (1, "http://h/a/b/1"), (2, "http://h/a/b/1")]


def test_places_and_sums_of_one_large_group(spark):
    from folioq.operators.positions import placed, summed_before

    rows = [("hot" if k % 10 else None, (k * 7919) % 5000, k % 13) for k in range(5000)]
    df = spark.createDataFrame(rows, "g string, o int, n int").repartition(7)
    got = {r["o"]: r for r in summed_before(placed(df, ["g"], ["o"]), ["g"], ["o"], "n").collect()}
    for g in ("hot", None):
        before = 0
        for place, (_, o, n) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1])):
            assert (got[o]["place"], got[o]["before"]) == (place, before)
            before += n
    assert placed(df.limit(0), ["g"], ["o"]).collect() == [] and placed(df, [], ["o"]).agg({"place": "max"}).first()[0] == 4999
