"""What only larger tables hold, against the SQL."""

import duckdb
from pyspark.sql import functions as F

from folioq.operators import listing
from folioq.queries import ORACLE_SQL, QUERIES


def both(spark, folder, name, table, rows, schema):
    """A query's rows and its SQL's, of a table made here."""
    path = str(folder / f"{table}.parquet")
    spark.createDataFrame(rows, schema).repartition(7).write.mode("overwrite").parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, df.collect())), sorted(want)


def test_titles_with_references_cut_short(spark, tmp_path):
    titles = ["a &amp;&amp &amp;amp; b", "token = &quot;73ab", "cut &quo", "end &", "&amp;quot; &lt;b&gt; &#65; &nbsp;", " plain "]
    rows = [(k, f"https://h.test/{k}", f"<html><head><title>x</title></head><body><h1>{t}</h1><p>&amp;</p></body></html>") for k, t in enumerate(titles)]
    got, want = both(spark, tmp_path, "page_titles", "pages", rows, "page_id bigint, url string, html string")
    assert got == want and [r[1] for r in got[:2]] == ["a &&amp &amp; b", "token = &quot;73ab"]


def test_minutes_do_not_hang_on_the_order_of_rows(spark):
    lists = {"short": [59.99], "less": [-0.5], "none": [None], "huge": [1e300, 60.0], "odd": [60.0, 1 / 3], "nan": [60.0, float("nan")], "large": [9e11] * 3}
    for u in range(200):  # whole minutes in cents; added up as doubles, many come out a little below
        cents = [(7 * u + 13 * k) % 9973 for k in range(60)]
        lists[str(u)] = [c / 100 for c in [*cents, 6000 * 100 - sum(cents) % 6000]]
    rows = [(u, "b", 0, 90, v) for u, some in lists.items() for v in some]
    reads = spark.createDataFrame(rows, "user string, bookUrl string, index int, total int, seconds double")
    got = {r["user"]: r["minutes"] for r in listing.reading_stats(reads.repartition(5), ["user"]).where("user not in ('huge', 'nan')").collect()}
    assert got == {"short": 0, "less": -1, "none": None, "odd": 1, "large": 45_000_000_000} | {str(u): sum(round(100 * v) for v in lists[str(u)]) // 6000 for u in range(200)}
    plain = reads.where("user in ('huge', 'nan')").groupBy("user").agg(F.floor(F.sum("seconds") / 60).alias("minutes"))
    assert {tuple(r) for r in listing.reading_stats(reads, ["user"]).where("user in ('huge', 'nan')").select("user", "minutes").collect()} == {tuple(r) for r in plain.collect()}
