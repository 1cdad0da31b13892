"""Inventory metrics over active lots: KPIs, status and category breakdowns.

All are single aggregations over the (lot-sized) inventory; partial aggregation
keeps the shuffle at one row per group per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.status import AT_RISK, OPTIMAL
from lotwise.operators.inventory import active_inventory


def product_stock(inventory: DataFrame) -> DataFrame:
    """A4: active stock per product. The name depends on the id, so it is a group key."""
    return (
        active_inventory(inventory)
        .groupBy("product_id", "product_name")
        .agg(F.sum("current_qty").cast("long").alias("stock_total"))
    )


def status_distribution(inventory: DataFrame) -> DataFrame:
    """A5: active lot count per status, largest first."""
    return (
        active_inventory(inventory)
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("lot_count"))
        .orderBy(F.desc("lot_count"), "status")
    )


def stock_by_category(inventory: DataFrame) -> DataFrame:
    """A6 + O5: active stock per category, largest first."""
    return (
        active_inventory(inventory)
        .groupBy("category")
        .agg(F.sum("current_qty").cast("long").alias("stock_total"))
        .orderBy(F.desc("stock_total"), "category")
    )


def inventory_kpis(inventory: DataFrame) -> DataFrame:
    """A7 + P8: one row: total items, active lots, optimal lots, at-risk lots."""
    act = active_inventory(inventory)
    return act.agg(
        F.coalesce(F.sum("current_qty"), F.lit(0)).cast("long").alias("total_items"),
        F.count(F.lit(1)).alias("active_lots"),
        F.count_if(F.col("status") == OPTIMAL).alias("optimal_lots"),
        F.count_if(F.col("status").isin(AT_RISK)).alias("at_risk_lots"),
    )


def inventory_kpis_text(inventory: DataFrame) -> DataFrame:
    """F16: KPI values with a thousands separator and no decimals."""
    k = inventory_kpis(inventory)
    return k.select(
        *[
            F.format_number(F.col(c).cast("double"), 0).alias(f"{c}_text")
            for c in ("total_items", "active_lots", "optimal_lots", "at_risk_lots")
        ]
    )
