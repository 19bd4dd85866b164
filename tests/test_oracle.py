"""Every registered query against its DuckDB twin at the smallest scale."""

import pytest
from oracle_check import compare, connect

from quillspark.plans.catalog import all_queries

SF = "/root/testdata/sf0.001"
CATALOG = all_queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, duck, name):
    fn, sql = CATALOG[name]
    status, _ = compare(spark, duck, SF, fn, sql)
    assert status in ("ok", "rows-only"), status[:2000]


def test_entry(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "sent_idx", "dirty", "cleaned"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
