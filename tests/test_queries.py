"""Every registered query runs; those with SQL match it."""

import pytest
from helpers import oracle, rows

from wavewright.plans import registry, registry_io  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    found = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLE_SQL:
        expected = oracle(registry.ORACLE_SQL[name], sf)
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("n", [1, 7])
def test_partitions_do_not_matter(spark, sf, n):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found = [rows(registry.QUERIES[q](spark, sf).toPandas()) for q in ("os_nrmse_median3", "merged_tiles", "vus_pr")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert found == [rows(oracle(registry.ORACLE_SQL[q], sf)) for q in ("os_nrmse_median3", "merged_tiles", "vus_pr")]
