"""Checks and recommendations that read a table once; joins on stored buckets."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from lotwise import plans as E
from lotwise.operators import logistics as lg
from lotwise.operators import quality as dq
from lotwise.operators import recommend as rec
from lotwise.operators import consumption as cons
from lotwise.operators import inventory as inv
from lotwise.plans import q_logistics as Q
from lotwise.sources import schemas as S
from lotwise.sources.bucketed import bucketed
from fixtures import SEED_AS_OF, seed_tables

SF = "/root/testdata/sf0.001"


def _final(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]


def _scans(plan, column):
    return len([s for s in re.findall(r"FileScan parquet \[([^\]]*)\]", plan) if column in s])


def test_recommendations_scan_the_fact_once(spark):
    plan = _final(E.queries()["recommendations"](spark, SF))
    assert _scans(plan, "l_partkey") == 1


def test_recommend_equals_rules_on_separate_tables(spark):
    """The seed inventory, with a lot without lines, a product without lots, and a flight that is stored twice."""
    t = seed_tables(spark)
    lots = t["lots"].unionByName(spark.createDataFrame([(699, 501, "L-699", dt.date(2025, 10, 20), 5), (698, 512, "L-698", dt.date(2030, 1, 1), 7)], S.LOTS))
    stock = inv.lot_inventory(lots, t["products"], t["categories"], t["lot_services"], SEED_AS_OF)
    for as_of in (SEED_AS_OF, dt.date(2025, 10, 21)):
        stock = inv.lot_inventory(lots, t["products"], t["categories"], t["lot_services"], as_of)
        used = cons.product_consumption(t["lot_services"], t["flights"], lots, t["products"], as_of)
        want = rec.recommendations(stock, used)
        got = rec.recommend(lots, t["products"], t["categories"], t["lot_services"], t["flights"], as_of)
        twice = rec.recommend(lots, t["products"], t["categories"], t["lot_services"], t["flights"].unionByName(t["flights"]), as_of)
        rows = sorted(map(str, want.select(got.columns).collect()))
        assert sorted(map(str, got.collect())) == rows and rows
        assert sorted(map(str, twice.collect())) == rows
        assert [r.lot_id for r in rec.in_order(got).collect()] == [r.lot_id for r in want.collect()]


def _dq_tables(spark):
    t = seed_tables(spark)
    t["airports"] = spark.createDataFrame([(201, "AAA", "n", "l", None, None), (202, "BBB", "n", "l", None, None)], S.AIRPORTS)
    t["airlines"] = spark.createDataFrame([(301, "X", "XX", None)], S.AIRLINES)
    t["aircraft_types"] = spark.createDataFrame([(101, "M", 100)], S.AIRCRAFT_TYPES)
    return t


def test_orphans_on_planted_rows(spark):
    t = _dq_tables(spark)
    t["lot_services"] = t["lot_services"].unionByName(
        spark.createDataFrame([(900, 77, 601, 1, 1), (901, 77, 601, 1, 1), (902, 1, 5, 1, None)], S.LOT_SERVICES))
    t["lots"] = t["lots"].where("lot_id <> 602")
    got = {(r.child_table, r.fk_column, r.parent_table): r.orphan_rows for r in dq.orphans(t).collect()}
    assert got == {(r.child_table, r.fk_column, r.parent_table): r.orphan_rows for r in _anti(t)}
    assert got["lot_services", "flight_id", "flights"] == 2 and got["lot_services", "lot_id", "lots"] > 1
    nothing = {k: df.limit(0) for k, df in t.items()}
    assert [r.orphan_rows for r in dq.orphans(nothing).collect()] == [0] * len(dq.FOREIGN_KEYS)


def _anti(t):
    """The same counts by one anti join per constraint."""
    out = []
    for child, col, parent, pcol in dq.FOREIGN_KEYS:
        missing = t[child].join(t[parent].select(F.col(pcol).alias("_k")), F.col(col) == F.col("_k"), "left_anti").count()
        out.append(type("R", (), {"child_table": child, "fk_column": col, "parent_table": parent, "orphan_rows": missing}))
    return out


def test_orphans_scan_each_table_once(spark):
    plan = _final(E.queries()["dq_orphans"](spark, SF))
    assert _scans(plan, "l_orderkey") == 1 and _scans(plan, "o_orderkey") == 1


def test_duplicate_keys_of_planted_rows(spark):
    keys = {"t": [["a"], ["b"], ["a", "b"]], "u": [["a"]]}
    t = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (None, "x"), (None, None), (3, "z|"), (3, "z|")], "a long, b string")
    u = spark.createDataFrame([(1,), (2,), (None,), (None,)], "a long")
    got = sorted(tuple(r) for r in dq.duplicate_keys({"t": t, "u": u}, keys).collect())
    assert got == [("t", "a", "1", 2), ("t", "a", "3", 2), ("t", "a,b", "3|z|", 2), ("t", "b", "x", 3), ("t", "b", "z|", 2)]
    assert dq.repeated_hashes({"t": t.limit(0), "u": u.limit(0)}, keys).count() == 0


def test_unique_keys_are_not_shuffled_by_full_key(spark):
    """A table of unique wide keys: the second pass has no rows left to shuffle."""
    df = spark.range(5000).select(F.concat(F.lit("x" * 200), F.col("id").cast("string")).alias("k"))
    suspects = dq.repeated_hashes({"t": df}, {"t": [["k"]]})
    assert suspects.count() == 0 and dq.duplicate_keys({"t": df}, {"t": [["k"]]}).count() == 0


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_fact_meets_flights_without_exchange(spark, no_broadcast):
    t = Q._t(spark, SF)
    flights, services = Q._by_flight(spark, SF)
    joined = services.join(flights, "flight_id").select("flight_id", "lot_id", "loaded_qty", "dep_ts")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    plain = t.lot_services.join(t.flights, "flight_id").select("flight_id", "lot_id", "loaded_qty", "dep_ts")
    assert "hashpartitioning(flight_id" in plain._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect()))


def _by_flight_exchanges(view):
    plan = view._jdf.queryExecution().executedPlan().toString()
    return [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if "flight_id" in x]


def test_bucketed_view_does_not_exchange_the_fact_by_flight(spark, no_broadcast):
    """Without broadcasts the flights meet their dimensions first and are dealt again; the fact is not."""
    t = Q._t(spark, SF)
    flights, services = Q._by_flight(spark, SF)
    rest = (t.lots, t.products, t.categories)
    assert len(_by_flight_exchanges(lg.flight_logistics_view(t.flights, t.airlines, t.airports, t.lot_services, *rest))) == 2
    assert len(_by_flight_exchanges(lg.flight_logistics_view(flights, t.airlines, t.airports, services, *rest))) == 1


def test_bucketed_keeps_rows_and_replaces(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (1, "a"), (2, None)], "k long, v string")
    got = bucketed(df, "k", 3, "bucketed_rows")
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    again = bucketed(df.where("k = 2"), "k", 2, "bucketed_rows")
    assert again.count() == 1
