"""The driver contract."""

import __spark_entry__ as entry
from pagewatch.plans import registry


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert {r["outcome"] for r in rows} == {"changed", "unchanged", "unreadable"}


def test_names():
    assert registry.QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_package_is_shipped_once(spark):
    entry.ship(spark)
    entry.ship(spark)
    assert spark.sparkContext.applicationId in entry._shipped
