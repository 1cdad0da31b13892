"""Library surface without a registered query: IO, surrogate keys, labels, rules."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from lotwise.functions import labels as lb
from lotwise.operators import enrich as en
from lotwise.sources import schemas as S
from lotwise.sources.readers import append_with_ids, peek, read_table, write_table


def test_write_read_overwrite_and_append(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="lotwise-io-"), "lots")
    lots = spark.createDataFrame([(1, 10, "A", dt.date(2026, 1, 1), 5)], S.LOTS)
    write_table(lots, path)
    write_table(lots, path)  # overwrite (drop and recreate)
    assert read_table(spark, path, "lots").count() == 1
    write_table(lots, path, mode="append")
    back = read_table(spark, path, "lots")
    assert back.count() == 2
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in S.LOTS]
    assert len(peek(back, 1)) == 1


def test_partitioned_write(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="lotwise-io-"), "svc")
    svc = spark.createDataFrame([(1, 1, 1, 5, None), (2, 2, 1, 5, 3)], S.LOT_SERVICES)
    write_table(svc.withColumn("part", F.col("flight_id") % 2), path, partition_by=["part"])
    assert sorted(os.listdir(path))[:2] == ["_SUCCESS", "part=0"] or "part=0" in os.listdir(path)


def test_append_with_dense_ids(spark):
    existing = spark.createDataFrame([(5, 1, 1, 1, 1), (9, 1, 2, 1, 1)], S.LOT_SERVICES)
    new = spark.createDataFrame([(3, 7, 4, None), (1, 7, 4, 2)], "flight_id long, lot_id long, loaded_qty int, consumed_qty int")
    out = append_with_ids(existing, new, "service_id", ["flight_id", "lot_id"]).collect()
    assert [(r.service_id, r.flight_id) for r in out] == [(10, 1), (11, 3)]


def test_label_fallbacks(spark):
    df = spark.createDataFrame([("en", "prio_high"), ("fr", "prio_high"), ("en", "nope")], "lang string, key string")
    got = [r[0] for r in df.select(lb.label(F.col("lang"), F.col("key"))).collect()]
    assert got == ["High", "Alta", "[nope]"]
    c = spark.createDataFrame([("critical",), ("other",)], "s string").select(lb.status_color("s")).collect()
    assert [r[0] for r in c] == ["#d9534f", "#000000"]


def test_template_fill_and_days_parse(spark):
    df = spark.createDataFrame(
        [("{qty} items expired ({days} days ago).", "12", "10"), ("{qty} items vencen en {days} días.", "4", "2"),
         ("Stock Total: {stock:.0f} | Consumo Semanal: {consumo:.1f}", "", "")],
        "t string, q string, d string",
    )
    filled = df.select(
        lb.fill(F.col("t"), {"qty": F.col("q"), "days": F.col("d"), "stock": F.lit("43"), "consumo": F.lit("46.0")}).alias("m")
    )
    rows = [r.m for r in filled.collect()]
    assert rows == ["12 items expired (10 days ago).", "4 items vencen en 2 días.", "Stock Total: 43 | Consumo Semanal: 46.0"]
    days = [r[0] for r in filled.select(lb.days_from_text("m")).collect()]
    assert days == [-10, 2, 999]


def test_calendar_rules(spark):
    f = spark.createDataFrame(
        [(1, dt.datetime(2025, 12, 31, 10, 59), 1500), (2, dt.datetime(2025, 3, 2, 11, 0), 1501),
         (3, dt.datetime(2025, 5, 5, 18, 0), 800)],
        "flight_id long, dep_ts timestamp_ntz, distance_km int",
    )
    rows = {r.flight_id: r for r in en.flight_calendar(f).collect()}
    assert (rows[1].daypart_rule, rows[1].season_rule, rows[1].route_type_rule, rows[1].weekday_rule) == (
        "Mañana", "Alta", "Nacional", "Miércoles")
    assert (rows[2].daypart_rule, rows[2].season_rule, rows[2].route_type_rule, rows[2].weekday_rule) == (
        "Tarde", "Media", "Internacional", "Domingo")
    assert (rows[3].daypart_rule, rows[3].season_rule) == ("Noche", "Baja")
    # 1640 km: int(1640/800*60) = 122 in double arithmetic
    a = spark.createDataFrame([(1, dt.datetime(2025, 1, 1, 23, 30), dt.datetime(2025, 1, 2, 2, 2), 1640)],
                              "flight_id long, dep_ts timestamp_ntz, arr_ts timestamp_ntz, distance_km int")
    r = en.estimated_arrival(a).first()
    assert r.flight_minutes == 122 and r.est_arrival == "2025-01-02 02:02:00" and r.buffer_minutes == 30


def test_menu_and_rates(spark):
    f = spark.createDataFrame([(1, "Mañana"), (2, "Noche")], "flight_id long, daypart string")
    menu = en.menu_plan(f, {"drinks": ["D"], "breakfast": ["B"], "mains": ["M1", "M2"], "snacks": ["S"]})
    got = sorted((r.flight_id, r.menu_part, r.category) for r in menu.collect())
    assert got == [(1, "breakfast", "B"), (1, "drinks", "D"), (1, "snacks", "S"),
                   (2, "drinks", "D"), (2, "mains", "M1"), (2, "mains", "M2"), (2, "snacks", "S")]
    lines = spark.createDataFrame(
        [(1, 1, 1, 100, "D", 90, "Soleado"), (2, 1, 2, 100, "X", 90, "Nevado")],
        "service_id long, flight_id long, lot_id long, passengers int, category string, loaded_qty int, weather string",
    )
    planned = en.planned_load(lines, {"D": 1.2}, keep=("weather", "category"))
    assert [r.planned_qty for r in planned.orderBy("service_id").collect()] == [120, 105]
    e = en.expected_consumption(planned, 0.95, [(["Soleado"], ["D"], 0.08)]).orderBy("service_id").collect()
    assert [round(r.rate, 6) for r in e] == [0.98, 0.95]  # clamped at 0.98
    assert [r.expected_qty for r in e] == [117, 99]


def test_views_translations_nesting_and_ids(spark):
    from lotwise.operators import allocate as al
    from lotwise.operators.inventory import INVENTORY_COLUMNS
    from lotwise.operators.logistics import VIEW_COLUMNS
    from lotwise.sources.readers import drop_view, register_views, sparse_ids
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.001"
    assert E.queries()["flight_logistics_view"](spark, sf).columns == VIEW_COLUMNS
    assert E.queries()["lot_inventory"](spark, sf).columns == INVENTORY_COLUMNS
    tr = lb.translations_df(spark)
    assert tr.where("lang = 'es' AND key = 'prio_high'").first().template == "Alta"
    register_views({"tr_view": tr})
    assert spark.sql("SELECT COUNT(*) AS n FROM tr_view").first().n == tr.count()
    drop_view(spark, "tr_view")
    assert not spark.catalog.tableExists("tr_view")
    flat = spark.createDataFrame(
        [(1, 10, 5, dt.date(2026, 1, 2), "L5", "optimal", 3), (1, 10, 4, dt.date(2026, 1, 1), "L4", "warning", 2),
         (2, 7, None, None, None, None, None)],
        "product_id long, final_qty long, lot_id long, expiry_date date, lot_number string, status string, taken_qty long",
    )
    nested = {r.product_id: r.lots for r in al.nest_assignments(flat).collect()}
    assert [l.lot_id for l in nested[1]] == [4, 5] and nested[2] == []
    ids = sparse_ids(tr, "rid").select("rid").distinct().count()
    assert ids == tr.count()
