"""Prioritised recommendations: expired lots, waste risk, stock-out risk.

Rules (codes are stable keys; display text is joined from labels last):
* expired      : active lot, days <= 0          -> priority high   (rank 0)
* waste_risk   : active lot, 0 < days <= 3      -> priority high   (rank 0)
* stockout_risk: weekly consumption > 0 and active stock < 0.5 x weekly
                 (products with no active lot are never flagged) -> medium (rank 1)

Order: priority rank, then days remaining (no days -> 999), then expiry / ids.
``recommend`` reads the fact once for all of them. ``recommendations`` makes them from an inventory and a
consumption table that the caller has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.status import days_remaining
from lotwise.operators.consumption import DEFAULT_WINDOW_DAYS, lot_activity
from lotwise.operators.inventory import active_inventory, product_catalog
from lotwise.operators.metrics import product_stock

HIGH, MEDIUM = "high", "medium"
PRIORITY_RANK = {HIGH: 0, MEDIUM: 1}
EXPIRED, WASTE_RISK, STOCKOUT_RISK = "expired", "waste_risk", "stockout_risk"
STOCKOUT_FRACTION = 0.5
WASTE_DAYS = 3
# Severity and icon shown with each rule.
SEVERITY = {EXPIRED: "error", WASTE_RISK: "error", STOCKOUT_RISK: "warning"}
ICON = {EXPIRED: "🔴", WASTE_RISK: "🟠", STOCKOUT_RISK: "🟡"}
NO_DAYS = 999

REC_COLUMNS = [
    "priority",
    "priority_rank",
    "rule",
    "product_id",
    "product_name",
    "lot_id",
    "lot_number",
    "expiry_date",
    "qty",
    "days_remaining",
    "stock",
    "avg_weekly",
    "severity",
    "icon",
]


def lot_rules(inventory: DataFrame) -> DataFrame:
    """B1 + B2 as one pass."""
    d = F.col("days_remaining")
    rule = F.when(d <= 0, EXPIRED).when(d <= WASTE_DAYS, WASTE_RISK)
    return (
        active_inventory(inventory)
        .where(d <= WASTE_DAYS)
        .select(
            F.lit(HIGH).alias("priority"),
            F.lit(PRIORITY_RANK[HIGH]).alias("priority_rank"),
            rule.alias("rule"),
            "product_id",
            "product_name",
            "lot_id",
            "lot_number",
            "expiry_date",
            F.col("current_qty").alias("qty"),
            "days_remaining",
            F.lit(None).cast("long").alias("stock"),
            F.lit(None).cast("double").alias("avg_weekly"),
            F.lit(SEVERITY[EXPIRED]).alias("severity"),
            F.when(d <= 0, ICON[EXPIRED]).otherwise(F.lit(ICON[WASTE_RISK])).alias("icon"),
        )
    )


def rec_expired(inventory: DataFrame) -> DataFrame:
    return lot_rules(inventory).where(F.col("rule") == EXPIRED)


def rec_waste_risk(inventory: DataFrame) -> DataFrame:
    return lot_rules(inventory).where(F.col("rule") == WASTE_RISK)


def stockout_risk(inventory: DataFrame, consumption: DataFrame) -> DataFrame:
    """B3 (+ J5, F10): active stock per product LEFT JOIN weekly consumption."""
    wk = F.coalesce(F.col("avg_weekly"), F.lit(0.0))
    return (
        product_stock(inventory)
        .join(consumption.select("product_id", "avg_weekly"), "product_id", "left")
        .select("product_id", "product_name", F.col("stock_total").alias("stock"), wk.alias("avg_weekly"))
        .where((F.col("avg_weekly") > 0) & (F.col("stock") < F.col("avg_weekly") * STOCKOUT_FRACTION))
    )


def recommendations(inventory: DataFrame, consumption: DataFrame, ordered: bool = True) -> DataFrame:
    """U1 + O4: all recommendation rows in priority order."""
    so = stockout_risk(inventory, consumption).select(
        F.lit(MEDIUM).alias("priority"),
        F.lit(PRIORITY_RANK[MEDIUM]).alias("priority_rank"),
        F.lit(STOCKOUT_RISK).alias("rule"),
        "product_id",
        "product_name",
        F.lit(None).cast("long").alias("lot_id"),
        F.lit(None).cast("string").alias("lot_number"),
        F.lit(None).cast("date").alias("expiry_date"),
        F.lit(None).cast("long").alias("qty"),
        F.lit(None).cast("int").alias("days_remaining"),
        "stock",
        "avg_weekly",
        F.lit(SEVERITY[STOCKOUT_RISK]).alias("severity"),
        F.lit(ICON[STOCKOUT_RISK]).alias("icon"),
    )
    out = lot_rules(inventory).unionByName(so)
    return in_order(out) if ordered else out


def recommend(lots, products, categories, lot_services, flights, as_of, window_days: int = DEFAULT_WINDOW_DAYS) -> DataFrame:
    """U1 + A1 + A2: all recommendation rows, reading the fact once.

    The fact becomes one row per lot with its all-time and its recent consumption. A lot gives a row of its own, if
    a lot rule holds, and a share of its product's row; one aggregation by (product, lot or none) passes the first and
    adds up the second, so a product with very many lots is summed before the shuffle.
    """
    lot = lots.join(product_catalog(products, categories).select("product_id", "product_name"), "product_id").join(
        lot_activity(lot_services, flights, as_of, window_days), "lot_id", "left")
    qty = F.col("initial_qty").cast("long") - F.coalesce(F.col("consumed_total"), F.lit(0))
    lot = lot.select(
        "product_id", "product_name", "lot_id", "lot_number", "expiry_date", qty.alias("qty"),
        days_remaining("expiry_date", as_of).alias("days_remaining"), F.coalesce("recent", F.lit(0)).alias("recent"))
    active = F.col("qty") > 0
    zero, own = F.lit(0).cast("long"), ["lot_id", "lot_number", "expiry_date", "days_remaining"]
    mine = F.struct(*own, "qty", F.lit(True).alias("active"), zero.alias("recent"))
    share = F.struct(
        *[F.lit(None).cast(lot.schema[c].dataType).alias(c) for c in own],
        F.when(active, F.col("qty")).otherwise(zero).alias("qty"), active.alias("active"), "recent")
    rows = lot.select("product_id", "product_name", F.explode(
        F.when(active & (F.col("days_remaining") <= WASTE_DAYS), F.array(mine, share)).otherwise(F.array(share))).alias("r"))
    summed = rows.select("product_id", "product_name", "r.*").groupBy("product_id", "product_name", *own).agg(
        F.sum("qty").alias("qty"), F.max("active").alias("active"), F.sum("recent").alias("recent"))
    weekly = F.col("recent").cast("double") / F.lit(float(window_days)) * F.lit(7.0)
    of_lot = F.col("lot_id").isNotNull()
    late = F.col("days_remaining") <= 0
    short = F.col("active") & (weekly > 0) & (F.col("qty") < weekly * STOCKOUT_FRACTION)
    rule = F.when(of_lot & late, EXPIRED).when(of_lot, WASTE_RISK).otherwise(F.lit(STOCKOUT_RISK))

    def by_rule(values):
        return F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in values.items()])

    return summed.where(of_lot | short).withColumn("rule", rule).select(
        F.when(of_lot, HIGH).otherwise(F.lit(MEDIUM)).alias("priority"),
        F.when(of_lot, PRIORITY_RANK[HIGH]).otherwise(F.lit(PRIORITY_RANK[MEDIUM])).alias("priority_rank"),
        "rule", "product_id", "product_name", *own[:3],
        F.when(of_lot, F.col("qty")).alias("qty"),
        "days_remaining",
        F.when(~of_lot, F.col("qty")).alias("stock"),
        F.when(~of_lot, weekly).alias("avg_weekly"),
        by_rule(SEVERITY).alias("severity"),
        by_rule(ICON).alias("icon"),
    )


def in_order(recs: DataFrame) -> DataFrame:
    """By priority, days remaining (none: 999), expiry and ids."""
    return recs.orderBy(
        "priority_rank", F.coalesce(F.col("days_remaining"), F.lit(NO_DAYS)), "expiry_date", "lot_id", "product_id")


def high_priority(recs: DataFrame) -> DataFrame:
    """P10: the high-priority slice."""
    return recs.where(F.col("priority") == HIGH)
