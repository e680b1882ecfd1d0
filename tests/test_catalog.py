"""Every query runs, and agrees with its SQL, on the smallest tables."""

import os

import pytest

from corvane import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df):
    names = sorted(df.columns)
    return sorted(map(repr, df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        assert rows(got) == rows(duck.execute(catalog.ORACLES[name]).df())


def test_golden_counts(spark):
    got = catalog.q_chunk_lines(spark, SF).toPandas()
    assert (len(got), got.start_line.sum(), got.end_line.sum()) == (342, 2441, 4593)


def test_plans_push_down(spark, capsys):
    catalog.q_vector_topk_filtered(spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan
