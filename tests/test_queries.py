"""Every query with SQL against DuckDB on the smallest driver tables, and the entry."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexgrove.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, duck, name):
    frame = plans.QUERIES[name](spark, FOLDER)
    relation = duck.sql(plans.SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    place = [relation.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in place) for r in relation.fetchall()), key=str)
    assert ours == theirs


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pages_are_escaped_to_their_end(spark, tmp_path):
    html = "x" * 60 + "a & <b> \"c\" 'd' ``e``"
    spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r["page_id"]: r["xml"] for r in plans.QUERIES["scalar_escapes"](spark, str(tmp_path)).collect()}
    assert found == {1: "x" * 60 + "a &amp; &lt;b&gt; &apos;&apos;c&apos;&apos; &apos;d&apos; &quot;e&quot;", 2: None}
