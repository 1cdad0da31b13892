"""Registered queries: sources, inventory, metrics, consumption, recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import consumption as cons
from lotwise.operators import inventory as inv
from lotwise.operators import metrics as met
from lotwise.operators import recommend as rec
from lotwise.plans.registry import query
from lotwise.sources.driver_tables import tables_for


def _inventory(spark, sf):
    t = tables_for(spark, sf)
    return inv.lot_inventory(t.lots, t.products, t.categories, t.lot_services, t.as_of)


def _consumption(spark, sf):
    t = tables_for(spark, sf)
    return cons.product_consumption(t.lot_services, t.flights, t.lots, t.products, t.as_of)


def _recommended(spark, sf):
    t = tables_for(spark, sf)
    return rec.recommend(t.lots, t.products, t.categories, t.lot_services, t.flights, t.as_of)


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


@query(
    "scan_lot_services",
    "SELECT service_id, flight_id, lot_id, loaded_qty, consumed_qty FROM lot_services",
    ids="S2 S3 S10",
)
def scan_lot_services(spark, sf):
    return tables_for(spark, sf).lot_services


@query(
    "lot_consumption",
    "SELECT lot_id, consumed_total FROM lot_consumption",
    ids="A1",
)
def lot_consumption(spark, sf):
    return inv.lot_consumption(tables_for(spark, sf).lot_services)


@query(
    "lot_inventory",
    """SELECT product_id, product_name, category, lot_id, lot_number, expiry_date, initial_qty,
              consumed_total, current_qty, days_remaining, status FROM inventory""",
    ids="J3 P3 F2 F3",
)
def lot_inventory(spark, sf):
    return _inventory(spark, sf)


@query(
    "active_inventory",
    "SELECT product_id, lot_id, current_qty, days_remaining, status FROM active",
    ids="P6",
)
def active_inventory(spark, sf):
    return inv.active_inventory(_inventory(spark, sf)).select(
        "product_id", "lot_id", "current_qty", "days_remaining", "status"
    )


@query(
    "loadable_inventory",
    "SELECT product_id, lot_id, current_qty, days_remaining, status FROM loadable",
    ids="P7",
)
def loadable_inventory(spark, sf):
    return inv.loadable_inventory(_inventory(spark, sf)).select(
        "product_id", "lot_id", "current_qty", "days_remaining", "status"
    )


@query(
    "fefo_inventory_table",
    """SELECT status, days_remaining, product_name, lot_number, current_qty, expiry_date, lot_id
       FROM active ORDER BY expiry_date, lot_id""",
    ids="O1 P12",
)
def fefo_inventory_table(spark, sf):
    return inv.fefo_inventory_table(_inventory(spark, sf))


@query(
    "lot_audit",
    """SELECT status, days_remaining, product_name, lot_number, current_qty, expiry_date, lot_id
       FROM inventory ORDER BY expiry_date, lot_id""",
    ids="P12",
)
def lot_audit(spark, sf):
    return inv.lot_audit(_inventory(spark, sf))


@query(
    "product_stock",
    "SELECT product_id, product_name, stock_total FROM product_stock",
    ids="A4",
)
def product_stock(spark, sf):
    return met.product_stock(_inventory(spark, sf))


@query(
    "status_distribution",
    "SELECT status, COUNT(*) AS lot_count FROM active GROUP BY status ORDER BY lot_count DESC, status",
    ids="A5",
)
def status_distribution(spark, sf):
    return met.status_distribution(_inventory(spark, sf))


@query(
    "stock_by_category",
    """SELECT category, CAST(SUM(current_qty) AS BIGINT) AS stock_total FROM active
       GROUP BY category ORDER BY stock_total DESC, category""",
    ids="A6 O5",
)
def stock_by_category(spark, sf):
    return met.stock_by_category(_inventory(spark, sf))


@query(
    "inventory_kpis",
    """SELECT CAST(COALESCE(SUM(current_qty), 0) AS BIGINT) AS total_items,
              COUNT(*) AS active_lots,
              COUNT(*) FILTER (WHERE status = 'optimal') AS optimal_lots,
              COUNT(*) FILTER (WHERE status IN ('critical', 'warning', 'attention')) AS at_risk_lots
       FROM active""",
    ids="A7 P8",
)
def inventory_kpis(spark, sf):
    return met.inventory_kpis(_inventory(spark, sf))


@query(
    "product_consumption_30d",
    """SELECT product_id, product_name, total_consumed, round(avg_daily, 6) AS avg_daily,
              round(avg_weekly, 6) AS avg_weekly FROM consumption""",
    ids="A2 A3 P5 J4",
)
def product_consumption_30d(spark, sf):
    c = _consumption(spark, sf)
    return c.select("product_id", "product_name", "total_consumed", _r6("avg_daily"), _r6("avg_weekly"))


@query(
    "stockout_risk",
    "SELECT product_id, product_name, stock, round(avg_weekly, 6) AS avg_weekly FROM stockout",
    ids="B3 J5 F10",
)
def stockout_risk(spark, sf):
    s = rec.stockout_risk(_inventory(spark, sf), _consumption(spark, sf))
    return s.select("product_id", "product_name", "stock", _r6("avg_weekly"))


@query(
    "rec_expired",
    "SELECT product_id, lot_id, qty, days_remaining FROM lot_rules WHERE rule = 'expired'",
    ids="B1",
)
def rec_expired(spark, sf):
    return rec.rec_expired(_inventory(spark, sf)).select("product_id", "lot_id", "qty", "days_remaining")


@query(
    "rec_waste_risk",
    "SELECT product_id, lot_id, qty, days_remaining FROM lot_rules WHERE rule = 'waste_risk'",
    ids="B2",
)
def rec_waste_risk(spark, sf):
    return rec.rec_waste_risk(_inventory(spark, sf)).select(
        "product_id", "lot_id", "qty", "days_remaining"
    )


_REC_SQL_COLS = """priority, priority_rank, rule, product_id, product_name, lot_id, lot_number, expiry_date,
                   qty, days_remaining, stock, round(avg_weekly, 6) AS avg_weekly, severity, icon"""


@query(
    "recommendations",
    f"""SELECT {_REC_SQL_COLS} FROM recs
        ORDER BY priority_rank, COALESCE(days_remaining, 999), expiry_date, lot_id, product_id""",
    ids="B4 U1 O4",
)
def recommendations(spark, sf):
    r = rec.in_order(_recommended(spark, sf))
    return r.select(*[c for c in rec.REC_COLUMNS if c != "avg_weekly"], _r6("avg_weekly"))


@query(
    "recommendations_high",
    f"SELECT {_REC_SQL_COLS} FROM recs WHERE priority = 'high'",
    ids="P10",
)
def recommendations_high(spark, sf):
    r = rec.high_priority(_recommended(spark, sf))
    return r.select(*[c for c in rec.REC_COLUMNS if c != "avg_weekly"], _r6("avg_weekly"))
