"""Operators by example: merges, graphs, chapters, functions, streams."""


import pytest
from pyspark.sql import functions as F

from folioq.functions import host, text as T, titles, urls as U
from folioq.operators import books, graph, joins, merge, recurse, windows
from folioq.streaming import incremental, ratelimit


def one(spark, c, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(c.alias("x")).first()["x"]


def test_characters(spark):
    rows = spark.createDataFrame([(1, "克莱恩", "周明瑞", "学生", "短", "low"), (2, " 克莱恩 ", None, "", "更长的描述", "high"), (3, "路人", None, "活", "x", "none")], "seq int, name string, alias string, status string, description string, importance string")
    got = {r["name"]: r for r in merge.characters(rows).collect()}
    assert got["克莱恩"]["status"] == "学生" and got["克莱恩"]["description"] == "更长的描述" and got["克莱恩"]["importance"] == "high" and got["克莱恩"]["aliases"] == ["周明瑞"] and len(got) == 2
    rel = spark.createDataFrame([(1, "a", "b", "兄妹", "old"), (2, "b", "a", "兄妹", "new"), (3, "a", "a", "x", "")], "seq int, source string, target string, relation string, status string")
    assert [(r["source"], r["target"], r["status"]) for r in merge.relationships(rel).collect()] == [("a", "b", "new")]
    loc = spark.createDataFrame([(1, "公寓", "市", "x", "p"), (2, "公寓", None, "longer", "q")], "seq int, name string, parentName string, description string, character string")
    r = merge.locations(loc).first()
    assert (r["parentName"], r["description"], r["relatedCharacters"]) == ("市", "longer", ["p", "q"])


def test_graph(spark):
    people = spark.createDataFrame([(1, "林舟", "d"), (2, "沈月", "d")], "seq int, name string, detail string")
    places = spark.createDataFrame([(1, "北境", "d")], "seq int, name string, detail string")
    links = spark.createDataFrame([(1, "林舟", "沈月", "盟友"), (2, "林舟", "北境", graph.LOCATED), (3, "林舟", "林舟", "x"), (4, "林舟", "沈月", "盟友")], "seq int, source string, target string, label string")
    e = graph.edges(links)
    assert {(r["source"], r["target"], r["label"]) for r in e.collect()} == {("林舟", "沈月", "盟友"), ("林舟", "北境", "位于")}
    assert {(r["id"], r["kind"]) for r in graph.nodes([(people, "name", "character", "detail"), (places, "name", "location", "detail")]).collect()} == {("林舟", "character"), ("沈月", "character"), ("北境", "location")}
    assert {r["id"]: r["degree"] for r in graph.degrees(e).collect()}["林舟"] == 2
    h = spark.createDataFrame([("王国", None), ("市", "王国"), ("学校", "市"), ("a", "b"), ("b", "a"), ("孤", "none")], "name string, parent string")
    assert {(r["name"], r["depth"]) for r in graph.hierarchy(h).collect()} == {("王国", 0), ("市", 1), ("学校", 2), ("孤", 0)}


def test_text_functions(spark):
    assert one(spark, T.version(F.lit("v1.10.0")) > T.version(F.lit("1.9.9")), a=1) and not one(spark, T.version(F.lit("1.0.5")) > T.version(F.lit("v1.0.5-rc")), a=1)
    assert one(spark, T.replaced_once(F.lit("a1b2"), r"\d", "<$0>"), a=1) == "a<1>b2" and one(spark, T.tokens(F.lit("a, b；a;；c")), a=1) == ["a", "b", "c"]
    assert one(spark, T.with_token(F.lit("小说,精品"), "失效"), a=1) == "小说,精品,失效" and one(spark, T.without_token(F.lit("小说,失效"), "失效"), a=1) == "小说"
    assert one(spark, T.chunks(F.lit("一。二！" + "长" * 150 + "。"), 70), a=1) == ["一。二！", "长" * 70, "长" * 70, "长" * 10 + "。"]
    assert one(spark, T.author_key(F.lit("作者：张 三")), a=1) == "张三" and one(spark, T.entity_key(F.lit(" A·b C")), a=1) == "a.bc" and len(one(spark, T.merged_summary(F.lit("o"), F.lit("x" * 3000)), a=1)) == 1200
    assert one(spark, F.array(titles.ordinal(F.lit("第一千零三十章 x")), titles.ordinal(F.lit("12、x")), titles.ordinal(F.lit("序章"))), a=1) == [1030, 12, None]
    assert one(spark, F.array(titles.outside(F.lit("番外 一")), titles.outside(F.lit("序章")), titles.outside(F.lit("上架感言"))), a=1) == [True, False, True]
    assert one(spark, F.array(U.cookie_domain(F.lit("https://a.b.com.cn/x")), U.cookie_domain(F.lit("http://1.2.3.4/")), U.cookie_domain(F.lit("https://w.x.org"))), a=1) == ["b.com.cn", "1.2.3.4", "x.org"]
    assert one(spark, U.resolved(F.lit("https://h/a/b?c"), F.lit("d")), a=1) == "https://h/a/d" and one(spark, U.query(F.lit("a=1 2&b")), a=1) == "a=1%202&b"


def test_host_functions(spark):
    import base64

    assert one(spark, host.base64_decode(host.base64_encode(F.lit("é"))), a=1) == "é" and one(spark, host.decode_component(host.encode_component(F.lit("a b+é"))), a=1) == "a b+é" and one(spark, host.encode_uri(F.lit("http://h/é?q=a b")), a=1) == "http://h/%C3%A9?q=a%20b"
    key, iv = "f041c49714d39908", "0123456789abcdef"
    made = spark.sql(f"SELECT base64(aes_encrypt('http://x', '{key}', 'CBC', 'PKCS', '{iv}')) AS c").first()["c"]
    bare = base64.b64encode(base64.b64decode(made)[16:]).decode()
    assert one(spark, host.aes_cbc_decrypt(F.lit(bare), key, iv), a=1) == "http://x"
    assert one(spark, F.array(host.time_format(F.lit(1704067200)), host.time_format(F.lit(1704067200000))), a=1) == ["2024-01-01 00:00"] * 2


def test_front_loaded(spark):
    rows = [(1, k, t) for k, t in enumerate(["1414.第1414章", "1415.x", "1416.x", "1.第1章 绯红", "2.第2章"])]
    df = spark.createDataFrame(rows, "b int, i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", titles.front_loaded(F.col("t"), "i", ["b"]).alias("s")).collect()}
    assert [got[k] for k in range(5)] == [True, True, True, False, False]


def test_recursion(spark):
    links = spark.createDataFrame([("p1", "p2"), ("p2", "p3"), ("p3", "p1"), ("q1", None)], "url string, next string")
    starts = spark.createDataFrame([("p1", "P"), ("q1", "Q")], "url string, chain string")
    chain = recurse.followed(starts, links)
    assert {(r["chain"], r["url"], r["depth"]) for r in chain.collect()} == {("P", "p1", 0), ("P", "p2", 1), ("P", "p3", 2), ("Q", "q1", 0)}
    ch = spark.createDataFrame([("p1", 0, "c1", "A"), ("p2", 0, "c1", "A"), ("p2", 1, "c2", "B")], "url string, pos int, chapter_url string, title string")
    assert [(r["index"], r["title"]) for r in recurse.catalogue(ch, chain).orderBy("index").collect()] == [(0, "A"), (1, "B")]


def test_recursion_goes_on_to_the_end(spark):
    links = spark.range(3000).selectExpr("concat('p', id) AS url", "CASE WHEN id < 2999 THEN concat('p', id + 1) END AS next")
    starts = spark.createDataFrame([("p1", "P"), ("p2990", "Q")], "url string, chain string")
    got = recurse.followed(starts, links).groupBy("chain").agg({"depth": "max", "url": "count"}).collect()
    assert {r["chain"]: (r["max(depth)"], r["count(url)"]) for r in got} == {"P": (2998, 2999), "Q": (9, 10)}
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("x", "b")], "url string, next string")
    got = recurse.followed(spark.createDataFrame([("a", 1), ("x", 2)], "url string, chain int"), ring).collect()
    assert {(r["chain"], r["url"], r["depth"]) for r in got} == {(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "x", 0), (2, "a", 1), (2, "b", 1), (2, "c", 2)}
    deep = spark.range(45).selectExpr("concat('n', id) AS name", "CASE WHEN id > 0 THEN concat('n', id - 1) END AS parent")
    assert graph.hierarchy(deep).agg({"depth": "max"}).first()[0] == 44


def test_joins_and_positions(spark):
    shelf = spark.createDataFrame([("u1", "n", "a"), ("u2", "n", "a"), ("local-1", "n", "a")], "bookUrl string, name string, author string")
    gone = shelf.where("bookUrl = 'u1'")
    assert {r["bookUrl"] for r in joins.targets_of(shelf, gone, True).collect()} == {"u1", "u2"} and {r["bookUrl"] for r in joins.targets_of(shelf, gone, False).collect()} == {"local-1"}
    ch = spark.createDataFrame([(0, "第1章 甲"), (1, "第2章 乙")], "index int, title string")
    assert joins.best_title(ch, "第2章乙", 0).first()["index"] == 1 and joins.best_title(ch, "丙", 9).first()["index"] == 1
    lst = spark.createDataFrame([(k,) for k in range(5)], "pos int").withColumn("id", F.col("pos"))
    assert [r["id"] for r in windows.moved(lst, [], "pos", 3, 1).orderBy("pos").collect()] == [0, 3, 1, 2, 4]
    assert books.rewritten(spark.createDataFrame([("a.b",)], "text string"), [{"pattern": ".", "replacement": "-", "isRegex": False}]).first()["text"] == "a-b"


def test_rates():
    from collections import deque

    recent = deque()
    assert [ratelimit.window_start(t, recent, 2, 100) for t in (0, 10, 20, 30)] == [0, 10, 101, 111] and ratelimit.parsed("3/1000") == (3, 1000) and ratelimit.parsed("500") == (1, 500)


def test_streams(spark, tmp_path):
    schema = "source_index int, name string, author string, seq int"
    rows = spark.createDataFrame([(0, "A", "x", 0), (1, "a ", "X", 1), (1, "B", "y", 2)], schema)
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = incremental.arriving(spark, str(tmp_path / "in"), rows.schema)
    incremental.search(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 10, on_batch=lambda *x: seen.append(x)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and seen[-1][1] == 2
    calls = spark.createDataFrame([("u", 0), ("u", 50), ("u", 500)], "user string, s int").select("user", F.timestamp_seconds("s").alias("ts"))
    assert [(r["calls"]) for r in incremental.sessions(calls, "user", "ts", "100 seconds").orderBy("started").collect()] == [2, 1]
    calls.repartition(1).write.parquet(str(tmp_path / "calls"))
    live = incremental.expired(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls")), "user", "ts", 100_000)
    live.writeStream.format("memory").queryName("exp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [r["event"] for r in spark.sql("SELECT * FROM exp ORDER BY at_ms").collect()] == ["started", "renewed", "started"]
    limited = ratelimit.stream(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls")), "user", "ts", 1, 100_000)
    limited.writeStream.format("memory").queryName("lim").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    batch = ratelimit.admitted(calls, "user", "ts", 1, 100_000, "user")
    assert sorted(r["start_ms"] for r in spark.sql("SELECT start_ms FROM lim").collect()) == sorted(r["start_ms"] for r in batch.collect()) == [0, 100001, 500000]
    ch = spark.createDataFrame([("b", 0, "n", "s"), ("b", 1, "m", "t"), ("b", 1, "z", "t")], "bookUrl string, index int, name string, status string")
    ch.repartition(1).write.parquet(str(tmp_path / "ch"))
    mem = incremental.memories(spark.readStream.schema(ch.schema).parquet(str(tmp_path / "ch")))
    mem.writeStream.format("memory").queryName("mem").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("SELECT processed, names FROM mem").first()["processed"] == 1
    cache = spark.createDataFrame([("k", "v", "2024-01-01 00:00:00"), ("k", None, "2024-01-01 09:00:00")], "key string, value string, fetched string")
    assert incremental.cached_with_ttl(cache, "2024-01-01 05:00:00", 6 * 3600).first()["fresh"]
