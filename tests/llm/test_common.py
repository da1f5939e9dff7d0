"""The shared folder."""

import os
from types import SimpleNamespace

import pytest

from folioq.llm import common


def test_written_tables_and_clearing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    df = common.written(spark.range(5).toDF("id"), "x")
    assert df.count() == 5 and os.listdir(tmp_path / "folioq")
    assert common.written(spark.range(0).toDF("id"), "y").collect() == []
    common.clear(spark)
    assert not (tmp_path / "folioq").exists()
    with common.small_batches(spark, 7):
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "7"
    assert common.without(spark.createDataFrame([(1, 2)], "a int, B int"), "b").columns == ["a"]


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, applicationId="a"))

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))
        assert common.shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_dir(session("local[4]")).endswith("folioq-a")


def test_tables_that_have_served_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    kept, gone = common.written(spark.range(5).toDF("id"), "kept"), common.written(spark.range(9).toDF("id"), "gone")
    common.dropped(gone)
    common.collected(spark)
    assert kept.count() == 5 and len(os.listdir(tmp_path / "folioq")) == 1
