"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import DATA, compare, database

import __spark_entry__ as entry

SF = f"{DATA}/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    verdict = compare(spark, con, SF, entry.queries()[name], SQL[name])
    assert verdict in ("", "both empty")


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 1000
    assert "sensor_1_avg_std_24h" in df.columns
