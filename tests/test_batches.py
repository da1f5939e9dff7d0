"""Python steps: rows dealt out over all tasks, small batches."""

import os

import pyarrow as pa
import pytest

from folioq.operators import batches
from folioq.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
given = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_slices_are_whole_and_small():
    batch = pa.RecordBatch.from_pydict({"k": list(range(2000)), "t": ["x" * 10] * 1999 + ["y" * (batches.BYTES + 1)]})
    some = list(batches.sliced(iter([batch, batch.slice(0, 0)])))
    assert [k for b in some for k in b.column(0).to_pylist()] == list(range(2000)) and max(b.num_rows for b in some) <= batches.ROWS


def test_one_row_group_is_dealt_out(spark, tmp_path):
    spark.range(0, 5000, 1, 1).write.parquet(str(tmp_path / "one"))
    sizes = batches.dealt(spark.read.parquet(str(tmp_path / "one"))).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 5000 and len(sizes) >= 24 and max(sizes) < 500


@given
def test_epub_books_unpack_once(spark):
    text = plan(QUERIES["epub_books"](spark, SF))
    assert "RoundRobinPartitioning" in text and "Join" not in text and text.count("MapInArrow") == 2


@given
@pytest.mark.parametrize("name", ["rule_scripts", "rule_list_fields", "rule_script_list", "rule_xpath_values", "login_check", "rule_content_next", "rule_toc_scripts", "rule_selectors", "rule_detail_fallback", "rule_splitting", "rule_xpath_list", "rule_explore_list", "event_json_path", "url_requests", "archive_paths", "next_page_guard"])
def test_rules_run_in_many_tasks(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert 0 < text.index("MapInArrow") < text.index("RoundRobinPartitioning")


def test_a_script_is_parsed_once(monkeypatch):
    from folioq.rules import script

    made, parser = [], script._Parser
    monkeypatch.setattr(script, "_Parser", lambda text: (made.append(text), parser(text))[1])
    script.program.cache_clear()
    assert [script.evaluated("var n = Number(result); n + 1", str(k)) for k in range(50)] == [str(k) for k in range(1, 51)] and len(made) == 1
    for _ in range(2):  # a script that can't be parsed fails each time, one that changes its own arrays starts anew each time
        with pytest.raises(script.ScriptError):
            script.evaluated("var = 1")
        assert script.evaluated("var a = [1, [2]]; a.push(3); a[1].push(4); a", "") == "[1,[2,4],3]"


@pytest.mark.parametrize("step", ["pages", "texts", "feeds"])
def test_python_steps_hold_little_at_once(spark, monkeypatch, step):
    """A batch of 10,000 rows is worked off in small ones; each row comes back once, in order."""
    from folioq.operators import rules
    from folioq.sources import charset, feed

    sent = []
    n = 3000
    rows = {"pages": [(k, "http://h.test/", f"<a href='/{k}'>{k}</a>") for k in range(n)], "texts": [(k, f"text {k}".encode()) for k in range(n)], "feeds": [(k, f"<r><item><title>{k}</title></item><item/></r>" if k % 3 else "no feed") for k in range(n)]}[step]
    schema = {"pages": "page_id int, url string, html string", "texts": "id int, body binary", "feeds": "origin int, body string"}[step]

    class Frame:
        """Stands for a table of one batch: keeps the function that a step gives to mapInArrow."""

        def __init__(self):
            df = spark.createDataFrame(rows[:1], schema)
            self.schema, self.columns = df.schema, df.columns

        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):
            names = [c for c in self.columns]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), {"pages": [pa.int32(), pa.string(), pa.string()], "texts": [pa.int32(), pa.binary()], "feeds": [pa.int32(), pa.string()]}[step])], names=names)
            sent.extend(f(iter([batch])))
            return self

    from pyspark.sql.types import StringType

    if step == "pages":
        rules.mapped(Frame(), "html", "url", "out", StringType(), lambda b, u: b)
        assert [v for b in sent for v in b.column(3).to_pylist()] == [r[2] for r in rows]
    elif step == "texts":
        charset.with_text(Frame(), "body", plain=True)
        assert [v for b in sent for v in b.column(2).to_pylist()] == [f"text {k}" for k in range(n)]
    else:
        feed.read(Frame(), now=7)
        got = [r for b in sent for r in zip(*(b.column(k).to_pylist() for k in (0, 1, 2)))]
        assert got == [r for k in range(n) if k % 3 for r in ((k, 0, str(k)), (k, 1, None))]
    assert 1 < len(sent) < n / 50 and max(b.num_rows for b in sent) <= 2 * batches.ROWS


@given
def test_text_books_are_read_once(spark):
    text = plan(QUERIES["text_books"](spark, SF))
    assert "Join" not in text and text.count("MapInArrow") == 2


@given
def test_feeds_are_read_in_many_tasks(spark):
    text = plan(QUERIES["feed_articles"](spark, SF))
    assert 0 < text.index("MapInArrow") < text.index("RoundRobinPartitioning")
