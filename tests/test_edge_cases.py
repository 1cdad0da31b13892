"""Cases the seed rows miss (FIXTURES.md section 4)."""

import datetime as dt

from pyspark.sql import functions as F

from lotwise.operators import allocate as al
from lotwise.operators import consumption as cons
from lotwise.operators import inventory as inv
from lotwise.operators import quality as dq
from lotwise.operators import recommend as rec
from lotwise.sources import schemas as S

AS_OF = dt.date(2025, 10, 25)
D = dt.date.fromisoformat


def _tables(spark, lots, services, products=None):
    cats = spark.createDataFrame([(1, "Food")], S.CATEGORIES)
    prods = spark.createDataFrame(
        products or [(10, 1, "Soup", None), (20, 1, "Tea", None), (30, 1, "Soup", None), (40, 1, "Nolots", None)],
        S.PRODUCTS,
    )
    return (
        spark.createDataFrame(lots, S.LOTS),
        prods,
        cats,
        spark.createDataFrame(services, S.LOT_SERVICES),
    )


LOTS = [
    (1, 10, "A", D("2025-10-25"), 100),  # expires today: critical
    (2, 10, "B", D("2025-10-28"), 50),  # 3 days: warning
    (3, 10, "C", D("2025-11-01"), 60),  # 7 days: attention
    (4, 10, "D", D("2025-11-01"), 40),  # expiry tie with lot 3
    (5, 20, "E", D("2025-12-01"), 10),  # over-consumed -> negative stock
    (6, 20, "F", D("2025-12-02"), 30),  # never loaded
    (7, 30, "G", D("2025-12-01"), 25),  # same name as product 10
]
SERVICES = [
    (1, 100, 1, 30, None),  # NULL consumption counts 0 for stock
    (2, 100, 2, 30, 20),
    (3, 101, 5, 30, 25),
    (4, 102, 5, 30, 0),
]


def test_boundaries_and_stock(spark):
    l, p, c, s = _tables(spark, LOTS, SERVICES)
    rows = {r.lot_id: r for r in inv.lot_inventory(l, p, c, s, AS_OF).collect()}
    assert (rows[1].days_remaining, rows[1].status, rows[1].current_qty) == (0, "critical", 100)
    assert (rows[2].days_remaining, rows[2].status, rows[2].current_qty) == (3, "warning", 30)
    assert rows[3].status == "attention"
    assert rows[5].current_qty == -15  # negative stock shown in the audit
    assert rows[6].consumed_total == 0 and rows[6].current_qty == 30  # never loaded
    assert rows[7].product_name == rows[1].product_name  # names are not keys
    active = {r.lot_id for r in inv.active_inventory(inv.lot_inventory(l, p, c, s, AS_OF)).collect()}
    assert 5 not in active
    loadable = {r.lot_id for r in inv.loadable_inventory(inv.lot_inventory(l, p, c, s, AS_OF)).collect()}
    assert loadable == {2, 3, 4, 6, 7}


def test_fefo_split_ties_and_shortfall(spark):
    l, p, c, s = _tables(spark, LOTS, SERVICES)
    i = inv.lot_inventory(l, p, c, s, AS_OF)
    lines = spark.createDataFrame(
        [(10, 95), (20, 30), (30, 25), (40, 7)], "product_id long, final_qty long"
    )
    taken = {(r.product_id, r.lot_id): r.taken_qty for r in al.fefo_allocate(lines, i).collect()}
    # product 10: lot 1 is critical (never loaded); lot 2 (30) then tie 3/4 by lot id: 60, then 5 of 40
    assert taken == {(10, 2): 30, (10, 3): 60, (10, 4): 5, (20, 6): 30, (30, 7): 25}
    short = {r.product_id: r.shortfall_qty for r in al.shortfall(lines, i).collect()}
    assert short == {40: 7}  # product without lots misses all; 30 is exactly exhausted


def test_manifest_buffer(spark):
    d = spark.createDataFrame([(1, 0), (2, 1), (3, 20), (4, 21), (5, 100)], "product_id long, base_qty long")
    got = {r.product_id: (r.buffer_qty, r.final_qty) for r in al.manifest_lines(d).collect()}
    assert got == {1: (0, 0), 2: (1, 2), 3: (1, 21), 4: (2, 23), 5: (5, 105)}


def test_stockout_hit_and_exhausted_product(spark):
    lots = [(1, 10, "A", D("2026-01-01"), 10), (2, 20, "B", D("2026-01-01"), 5)]
    services = [(1, 1, 1, 10, 5), (2, 1, 2, 5, 5)]  # product 20 fully consumed
    l, p, c, s = _tables(spark, lots, services)
    flights = spark.createDataFrame(
        [(1, 1, 1, 1, 2, dt.datetime(2025, 10, 20, 8), dt.datetime(2025, 10, 20, 10), "Nacional", 100, 10,
          "Mañana", "Lunes", "Media", "Soleado")],
        S.FLIGHTS,
    )
    i = inv.lot_inventory(l, p, c, s, AS_OF)
    cn = cons.product_consumption(s, flights, l, p, AS_OF, window_days=1)
    # window of 1 day: the flight is 5 days back -> no consumption -> no stock-out
    assert rec.stockout_risk(i, cn).count() == 0
    cn = cons.product_consumption(s, flights, l, p, AS_OF, window_days=30)
    rows = rec.stockout_risk(i, cn).collect()
    # weekly = 5/30*7 = 1.17 -> stock 5 is not below 0.58; product 20 has no active lot
    assert rows == []
    cn = cons.product_consumption(s, flights, l, p, AS_OF, window_days=2)
    assert cn.count() == 0


def test_stockout_flagged(spark):
    lots = [(1, 10, "A", D("2026-01-01"), 100)]
    services = [(1, 1, 1, 100, 99)]
    l, p, c, s = _tables(spark, lots, services)
    flights = spark.createDataFrame(
        [(1, 1, 1, 1, 2, dt.datetime(2025, 10, 20, 8), dt.datetime(2025, 10, 20, 10), "Nacional", 100, 10,
          "Mañana", "Lunes", "Media", "Soleado")],
        S.FLIGHTS,
    )
    i = inv.lot_inventory(l, p, c, s, AS_OF)
    cn = cons.product_consumption(s, flights, l, p, AS_OF)
    rows = rec.stockout_risk(i, cn).collect()
    assert [(r.product_id, r.stock) for r in rows] == [(10, 1)]
    recs = rec.recommendations(i, cn).collect()
    assert [r.rule for r in recs] == ["stockout_risk"] and recs[0].priority == "medium"


def test_quality_planted_violations(spark):
    lots = [(1, 10, "A", D("2026-01-01"), 10), (1, 10, "A2", D("2026-01-01"), 10), (2, 99, "B", D("2026-01-01"), 5)]
    services = [(1, 1, 1, 10, 5), (1, 1, 1, 10, 5), (2, 7, 3, 5, None)]
    l, p, c, s = _tables(spark, lots, services)
    flights = spark.createDataFrame(
        [(1, 1, 1, 1, 2, dt.datetime(2025, 10, 20, 8), dt.datetime(2025, 10, 20, 10), "Regional", 1600, 10,
          "Tarde", "Lunes", "Media", "Soleado")],
        S.FLIGHTS,
    )
    t = {"lots": l, "products": p, "categories": c, "lot_services": s, "flights": flights,
         "airlines": spark.createDataFrame([(1, "X", "XX", None)], S.AIRLINES),
         "airports": spark.createDataFrame([(1, "AAA", "a", "a", None, None), (2, "BBB", "b", "b", None, None)], S.AIRPORTS),
         "aircraft_types": spark.createDataFrame([(1, "m", 100)], S.AIRCRAFT_TYPES)}
    dups = {(r.table_name, r.key_value) for r in dq.duplicate_keys(t).collect()}
    assert ("lots", "1") in dups and ("lot_services", "1") in dups
    assert dq.duplicate_flight_lot(s).count() == 1
    orph = {(r.child_table, r.fk_column): r.orphan_rows for r in dq.orphans(t).collect()}
    assert orph[("lots", "product_id")] == 1
    assert orph[("lot_services", "flight_id")] == 1
    assert orph[("lot_services", "lot_id")] == 1
    dom = {r.column_name: r.bad_rows for r in dq.domain_violations(flights).collect()}
    assert dom["route_type"] == 1 and dom["weather"] == 0
    mism = {(r.column_name, r.stored, r.derived) for r in dq.calendar_mismatch(flights).collect()}
    # 08:00 is morning (stored Tarde), 1600 km is Internacional (stored Regional), 2025-10-20 is Monday/Media
    assert mism == {("daypart", "Tarde", "Mañana"), ("route_type", "Regional", "Internacional")}
    nulls = {(r.table_name, r.column_name): r.null_rows for r in dq.null_and_length(t).collect()}
    assert nulls[("lot_services", "consumed_qty")] == 0  # nullable: not counted


def test_empty_inputs(spark):
    l, p, c, s = _tables(spark, [], [])
    i = inv.lot_inventory(l, p, c, s, AS_OF)
    assert i.count() == 0
    flights = spark.createDataFrame([], S.FLIGHTS)
    cn = cons.product_consumption(s, flights, l, p, AS_OF)
    assert rec.recommendations(i, cn).count() == 0
    lines = spark.createDataFrame([], "product_id long, final_qty long")
    assert al.fefo_allocate(lines, i).count() == 0
    assert al.shortfall(lines, i).count() == 0
    from lotwise.operators import regression as rg

    from lotwise.operators.logistics import CATEGORICAL_FEATURES, NUMERIC_FEATURES

    cols = [f"{c} int" for c in NUMERIC_FEATURES] + [f"{c} string" for c in CATEGORICAL_FEATURES]
    empty = spark.createDataFrame([], ", ".join(["product_id long", "service_id long", *cols, "consumed_qty double", "n_train long"]))
    assert rg.fit_models(empty, "n_train").count() == 0


def test_fefo_many_lots_same_day(spark):
    """A product whose lots all expire on one day: chunks split by lot-id block."""
    n = 3000
    rows = [(1, i, f"L{i}", D("2026-01-01"), "optimal", 1) for i in range(n)]
    i = spark.createDataFrame(
        rows, "product_id long, lot_id long, lot_number string, expiry_date date, status string, current_qty long"
    )
    lines = spark.createDataFrame([(1, 2500)], "product_id long, final_qty long")
    got = al.fefo_allocate(lines, i).agg(F.count("*").alias("n"), F.max("lot_id").alias("m")).first()
    assert (got.n, got.m) == (2500, 2499)


def test_fefo_chunks_follow_rows_on_scattered_ids(spark):
    """200,000 lots of one product with ids spread by 1,000: few chunk totals, exact result."""
    from lotwise.operators.windows import range_chunks

    lots = spark.range(200_000).select(
        F.lit(1).cast("long").alias("product_id"), (F.col("id") * 1000 + 7).alias("lot_id"),
        F.date_add(F.lit(D("2026-01-01")), (F.col("id") % 3).cast("int")).alias("expiry_date"), F.lit(1).cast("long").alias("current_qty"))
    chunks = range_chunks(lots, ["product_id"], "expiry_date", "lot_id").groupBy("product_id", "expiry_date", "_bucket").count()
    got = chunks.agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    assert got.n <= 200_000 / 512 + 3 and got.most < 1200


def test_scale_conf():
    from lotwise.session import scale_conf

    c = scale_conf(100 * (1 << 40), cores=8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409_600
    assert int(scale_conf(1 << 20, cores=8)["spark.sql.shuffle.partitions"]) == 16
