"""Every query with an oracle SQL equals DuckDB on the smoke data (sf0.001)."""

import pytest

from lotwise import plans as E
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_matches_duckdb(spark, con, name):
    problems, _n, _ts, _td = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, SF)
    assert df.count() >= 0


@pytest.mark.parametrize("name", ["flight_logistics_view", "estimated_arrival", "lot_audit_es"])
def test_time_zone_free(spark, name):
    """Local timestamps never pass through the session zone (DST gap at sf0.01:
    a flight arriving 2000-04-02 02:06, a time that does not exist in New York)."""
    sf = "/root/testdata/sf0.01"
    con = duck(sf)
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        problems, *_ = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], sf)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert not problems, problems
