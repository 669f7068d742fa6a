"""The driver's contract: queries run, and those with SQL give what the SQL gives, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


#: Queries that SQL can't say, with tests of their own.
NO_SQL = {"paragraphs", "node_merge", "markdown_plain", "contents_pages", "section_anchors", "repair_sections", "repair_audit", "report_metadata"}


def core():
    from foliomill.queries import QUERIES

    return sorted(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_llm_is_optional():
    assert set(core()) <= set(entry.queries())


@pytest.mark.parametrize("name", core())
def test_query_against_sql(spark, name):
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert name in NO_SQL
        return
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    assert sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in res.fetchall()) == got
