"""Recent consumption per product (trailing window, no upper bound).

    lot_services JOIN flights(dep_date >= as_of - n) JOIN lots JOIN products
    WHERE consumed_qty IS NOT NULL  GROUP BY product

The window predicate is a bound on the stored column ``dep_date`` of ``flights`` (a date, or a time
stamp of that day), so it is pushed to the scan and prunes partitions of a table partitioned by it.
Without that column the date is taken from ``dep_ts``, row by row. The rates divide
by the window length (not by the number of days observed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.status import as_of_col

DEFAULT_WINDOW_DAYS = 30


def window_flights(flights: DataFrame, as_of, window_days: int = DEFAULT_WINDOW_DAYS) -> DataFrame:
    first = F.date_sub(as_of_col(as_of), window_days)
    if "dep_date" in flights.columns:
        return flights.where(F.col("dep_date") >= first.cast(flights.schema["dep_date"].dataType)).select("flight_id")
    return flights.where(F.to_date("dep_ts") >= first).select("flight_id")


def product_consumption(
    lot_services: DataFrame,
    flights: DataFrame,
    lots: DataFrame,
    products: DataFrame,
    as_of,
    window_days: int = DEFAULT_WINDOW_DAYS,
) -> DataFrame:
    """A2 + A3: total consumed per product over the window, daily and weekly means."""
    recent = (
        lot_services.where(F.col("consumed_qty").isNotNull())
        .select("flight_id", "lot_id", "consumed_qty")
        .join(window_flights(flights, as_of, window_days), "flight_id", "inner")
    )
    per_lot = recent.groupBy("lot_id").agg(F.sum("consumed_qty").alias("c"))
    total = (
        per_lot.join(lots.select("lot_id", "product_id"), "lot_id", "inner")
        .join(products.select("product_id", F.col("name").alias("product_name")), "product_id")
        .groupBy("product_id", "product_name")
        .agg(F.sum("c").cast("long").alias("total_consumed"))
    )
    daily = F.col("total_consumed").cast("double") / F.lit(float(window_days))
    return total.select(
        "product_id",
        "product_name",
        "total_consumed",
        daily.alias("avg_daily"),
        (daily * F.lit(7.0)).alias("avg_weekly"),
    )


def lot_activity(lot_services: DataFrame, flights: DataFrame, as_of, window_days: int = DEFAULT_WINDOW_DAYS) -> DataFrame:
    """A1 + A2 in one pass over the fact: per lot, all consumption (``consumed_total``) and that of the window (``recent``).

    A flight of the window is known once, so that repeated flights do not count lines twice.
    """
    within = window_flights(flights, as_of, window_days).distinct().withColumn("_in", F.lit(True))
    lines = lot_services.select("flight_id", "lot_id", F.coalesce("consumed_qty", F.lit(0)).alias("q")).join(within, "flight_id", "left")
    return lines.groupBy("lot_id").agg(
        F.sum("q").cast("long").alias("consumed_total"),
        F.sum(F.when(F.col("_in"), F.col("q")).otherwise(0)).cast("long").alias("recent"))
