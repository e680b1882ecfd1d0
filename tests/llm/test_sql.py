"""The queries of this subpackage against their DuckDB equivalents, on a test table and on a hostile one."""

import os

import pytest

from corvane.llm import queries

from .data import texts

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def compared(spark, name, sf):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        if os.path.exists(f"{sf}/{table}.parquet"):
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet{'/*.parquet' if os.path.isdir(f'{sf}/{table}.parquet') else ''}')")
    want = db.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    got = got.select(*want.columns)
    return sorted(map(str, (tuple(r) for r in got.collect()))), sorted(map(str, want.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_on_the_test_tables(spark, name):
    got, want = compared(spark, name, SF)
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_on_hostile_tables(spark, name, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts(13, 25)) if t is None or "\x00" not in t]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(k, " ".join((t or "").split()[2:30])) for k, t in rows[:12]] + [(99, None), (None, rows[3][1]), (98, "one")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    urls = [None, "", "no host", "http://", "https://A.Example.ORG/es/x?y#z", "http://example.org/en/12", "x://com/fr/a", "http://b.com/de/", "http://org", "http://org/" + "p" * 30_000, "http://.org/", "http://example.org//es/", "a://b://c.com/fr/"]
    spark.createDataFrame([(k // 2, u) for k, u in enumerate(urls + urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got, want = compared(spark, name, str(tmp_path))
    assert got == want
