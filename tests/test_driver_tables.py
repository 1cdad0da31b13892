"""The derived tables hold every row of their source."""

from pyspark.sql import functions as F

from lotwise.operators import quality as dq
from lotwise.sources.driver_tables import derive_tables

SF = "/root/testdata/sf0.001"


def test_every_order_is_a_flight(spark, tmp_path):
    """Open, partly open and finished orders, and those of unknown status."""
    for name in ("part", "lineitem", "customer", "nation"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    status = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))
    orders.withColumn("o_orderstatus", status).write.parquet(f"{tmp_path}/orders.parquet")
    for sf in (SF, str(tmp_path)):
        t = derive_tables(spark, sf)
        assert {r.flight_id for r in t.flights.select("flight_id").collect()} == {r.o_orderkey for r in orders.collect()}
        loads = t.lot_services.join(t.flights, "flight_id").count()
        assert loads == t.lot_services.count() > 0


def test_orphans_finds_planted_lines(spark):
    t = derive_tables(spark, SF).as_dict()
    gone = [r.flight_id for r in t["flights"].orderBy("flight_id").limit(3).collect()]
    lines = t["lot_services"].where(F.col("flight_id").isin(gone)).count()
    t["flights"] = t["flights"].where(~F.col("flight_id").isin(gone))
    found = {(r.child_table, r.fk_column): r.orphan_rows for r in dq.orphans(t).collect()}
    assert found["lot_services", "flight_id"] == lines > 0
