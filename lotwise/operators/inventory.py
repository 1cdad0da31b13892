"""Lot inventory: consumption per lot, current stock, days to expiry, status.

Plan shape (one lazy plan, reused by metrics, recommendations and manifests):

    lots JOIN catalog  LEFT JOIN  (lot_services GROUP BY lot_id)   -- eager aggregation

The fact is aggregated to one row per lot *before* the join (partial aggregation
map-side, so a hot lot costs nothing extra), and the join is lot-keyed on both
sides, so it never fans out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.status import CRITICAL, days_remaining, expiry_status

INVENTORY_COLUMNS = [
    "product_id",
    "product_name",
    "category",
    "lot_id",
    "lot_number",
    "expiry_date",
    "initial_qty",
    "consumed_total",
    "current_qty",
    "days_remaining",
    "status",
]

AUDIT_COLUMNS = [
    "status",
    "days_remaining",
    "product_name",
    "lot_number",
    "current_qty",
    "expiry_date",
]


def product_catalog(products: DataFrame, categories: DataFrame) -> DataFrame:
    """products JOIN categories -> product_id, product_name, category_id, category, special_type."""
    return products.join(
        F.broadcast(categories.select("category_id", F.col("name").alias("category"))), "category_id", "inner"
    ).select(
        "product_id",
        F.col("name").alias("product_name"),
        "category_id",
        "category",
        "special_type",
    )


def lot_consumption(lot_services: DataFrame) -> DataFrame:
    """A1: total consumption per lot, NULL counted as 0."""
    return lot_services.groupBy("lot_id").agg(
        F.sum(F.coalesce(F.col("consumed_qty"), F.lit(0))).cast("long").alias("consumed_total")
    )


def lot_inventory(
    lots: DataFrame,
    products: DataFrame,
    categories: DataFrame,
    lot_services: DataFrame,
    as_of,
) -> DataFrame:
    """Every lot with its stock. Stock = initial - consumed (load does not reduce it)."""
    # merged, not broadcast by the size of its compressed files: products grow with the data
    catalog = product_catalog(products, categories).select(
        "product_id", "product_name", "category"
    ).hint("merge")
    cons = lot_consumption(lot_services)
    days = days_remaining("expiry_date", as_of)
    return (
        lots.join(catalog, "product_id", "inner")
        .join(cons, "lot_id", "left")
        .select(
            "product_id",
            "product_name",
            "category",
            "lot_id",
            "lot_number",
            "expiry_date",
            "initial_qty",
            F.coalesce(F.col("consumed_total"), F.lit(0).cast("long")).alias("consumed_total"),
            (
                F.col("initial_qty").cast("long")
                - F.coalesce(F.col("consumed_total"), F.lit(0).cast("long"))
            ).alias("current_qty"),
            days.alias("days_remaining"),
        )
        .withColumn("status", expiry_status("days_remaining"))
    )


def lot_stock(lots: DataFrame, lot_services: DataFrame, as_of) -> DataFrame:
    """Stock and status per lot without the catalog: what plans need that work on keys alone."""
    left = F.col("initial_qty").cast("long") - F.coalesce(F.col("consumed_total"), F.lit(0).cast("long"))
    return lots.join(lot_consumption(lot_services), "lot_id", "left").select(
        "product_id", "lot_id", "lot_number", "expiry_date", left.alias("current_qty"),
        expiry_status(days_remaining("expiry_date", as_of)).alias("status"))


def active_inventory(inventory: DataFrame) -> DataFrame:
    """Lots with stock left (expired lots included)."""
    return inventory.where(F.col("current_qty") > 0)


def loadable_inventory(inventory: DataFrame) -> DataFrame:
    """Lots that may go on a flight: stock left and not critical."""
    return inventory.where((F.col("current_qty") > 0) & (F.col("status") != CRITICAL))


def fefo_inventory_table(inventory: DataFrame) -> DataFrame:
    """O1 + P12: active lots, display columns, first-expired first (id tie-break)."""
    return (
        active_inventory(inventory)
        .select(*AUDIT_COLUMNS, "lot_id")
        .orderBy("expiry_date", "lot_id")
    )


def lot_audit(inventory: DataFrame) -> DataFrame:
    """Every lot (negative stock included), audit columns in fixed order."""
    return inventory.select(*AUDIT_COLUMNS, "lot_id").orderBy("expiry_date", "lot_id")
