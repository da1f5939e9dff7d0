"""Every query against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from folioq.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert rows
    if name in ORACLE_SQL:
        got = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in got.description]
        order = sorted(range(len(names)), key=lambda k: names[k])
        assert sorted(names) == sorted(df.columns)
        assert rows == sorted((tuple(plain(r[k]) for k in order) for r in got.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    from folioq.plans.base import table

    plan = table(spark, SF, "labels").where("quality = 0").select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,0)]" in plan and "ReadSchema: struct<doc_id:bigint,quality:" in plan


def test_import_needs_no_session():
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=here, check=True)
