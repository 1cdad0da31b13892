"""Manifests of many flights at once: each lot goes to flights in departure order.

Lines are (flight, product) with a need. Per product the usable lots stand in one queue by expiry
date, and lines take from its head by departure. Stock that expires before a line departs is lost to it
and to all later ones, so the queue position of line j is

    start(j) = D(j) + max(0, max over k <= j of (X(k) - D(k)))

with D(k) the need of all earlier lines and X(k) the stock that has expired by k's departure. A line takes
[start, start + need) as far as stock goes; a lot is [stock before it, stock with it). Overlaps of
the two give the assignments, the same as the sequential walk. For one flight this is
``allocate.fefo_allocate``.

All of it is one scan over the product's lots and lines in one order (``scan.max_plus_scan``): day by
day, the lots that expire on it, then its departures. A lot's place in the queue is the stock before it,
and a line's is the sum above. The overlaps of lots and lines are then read off by a second scan over the
points where either begins or ends (``scan.overlay``): no row is repeated per unit or cell, however large a
quantity. Chunks are lots of one expiry date by id and lines of a quarter of an hour, then quantiles of the queue
positions, so one product, or one product on one day, is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators.allocate import manifest_lines
from lotwise.operators.inventory import loadable_inventory
from lotwise.operators.scan import cut_of, max_plus_scan, overlay
from lotwise.operators.windows import range_chunks

_KEY = ["product_id"]


def open_lines(lot_services: DataFrame, lots: DataFrame, products: DataFrame, flights: DataFrame) -> DataFrame:
    """One manifest line per (flight, product) with unrecorded consumption: buffer per line."""
    open_ = lot_services.where(F.col("consumed_qty").isNull()).select("flight_id", "lot_id", "loaded_qty")
    demand = (
        open_.join(lots.select("lot_id", "product_id"), "lot_id")
        .groupBy("flight_id", "product_id").agg(F.sum("loaded_qty").cast("long").alias("base_qty"))
    )
    return departing_lines(demand, products, flights)


def departing_lines(demand: DataFrame, products: DataFrame, flights: DataFrame) -> DataFrame:
    """Manifest lines of a demand per (flight, product), with the flight's departure and the product's name."""
    named = demand.join(flights.select("flight_id", "dep_ts"), "flight_id").join(
        products.select("product_id", F.col("name").alias("product_name")), "product_id")
    return manifest_lines(named, ordered=False)


def _events(lines: DataFrame, inventory: DataFrame, need: str) -> DataFrame:
    """Lots (kind 0) and lines (kind 1) of each product in one table, with the chunk of the day they belong to."""
    lots = range_chunks(
        loadable_inventory(inventory).select("product_id", "lot_id", "lot_number", "expiry_date", "status", "current_qty"),
        _KEY, "expiry_date", "lot_id")
    zero, dep = F.lit(0).cast("long"), F.col("dep_ts").cast("timestamp_ntz")
    lots = lots.select(
        "product_id", F.col("expiry_date").alias("day"), F.lit(0).alias("kind"), F.col("_bucket").cast("long").alias("bucket"),
        F.lit(None).cast("timestamp_ntz").alias("at"), F.col("lot_id").cast("long").alias("id"),
        F.col("current_qty").cast("long").alias("stock"), zero.alias("need"),
        F.struct("lot_id", "lot_number", "expiry_date", "status").alias("lot"))
    lot_type = lots.schema["lot"].dataType
    return lots.unionByName(lines.select(
        "product_id", F.to_date("dep_ts").alias("day"), F.lit(1).alias("kind"),
        F.floor((F.hour(dep) * 60 + F.minute(dep)) / 15).cast("long").alias("bucket"), dep.alias("at"),
        F.col("flight_id").cast("long").alias("id"), zero.alias("stock"), F.col(need).cast("long").alias("need"),
        F.lit(None).cast(lot_type).alias("lot")))


def _scanned(lines: DataFrame, inventory: DataFrame, need: str) -> DataFrame:
    """Every lot and line with its interval [q0, q1) of the product's queue."""
    found = max_plus_scan(
        _events(lines, inventory, need), _KEY, ["day", "kind", "at", "id"], F.struct("day", "kind", "bucket"), "need", "stock", ("lot",))
    line = F.col("kind") == 1
    start = F.col("need_before") + F.greatest(F.lit(0), F.col("lead"))
    return found.select(
        "product_id", "kind", "id", "need", "lot", "bounds",
        F.when(line, F.least(start, F.col("stock_all"))).otherwise(F.col("stock_before")).alias("q0"),
        F.when(line, F.least(start + F.col("need"), F.col("stock_all"))).otherwise(F.col("stock_before") + F.col("stock")).alias("q1"))


def allocate_flights(lines: DataFrame, inventory: DataFrame, need: str = "final_qty") -> DataFrame:
    """B6 + W1: which lot goes on which flight, and how much of it."""
    rows = _scanned(lines, inventory, need).where("q1 > q0")
    flight = F.struct(F.col("id").alias("flight_id"))
    nobody = F.struct(F.lit(None).cast("long").alias("flight_id"))

    def point(pos, rank, line, lot=None):
        lot = F.lit(None).cast(rows.schema["lot"].dataType) if lot is None else lot
        return F.struct(F.col(pos).alias("pos"), F.lit(rank).alias("rank"), line.alias("line"), lot.alias("lot"))

    no_line = F.when(F.lit(False), flight)
    points = rows.select("product_id", "id", "bounds", F.explode(
        F.when(F.col("kind") == 0, F.array(point("q0", 2, no_line, F.col("lot"))))
        .otherwise(F.array(point("q0", 1, flight), point("q1", 0, nobody)))).alias("p"))
    points = points.select("product_id", "id", cut_of(F.col("p.pos"), F.col("bounds")).alias("cut"), "p.*")
    return overlay(points, _KEY, "line", "lot").select(
        "line.flight_id", "product_id", "lot.lot_id", "lot.lot_number", "lot.expiry_date", "lot.status",
        F.col("length").alias("taken_qty"))


def flight_shortfall(lines: DataFrame, inventory: DataFrame, need: str = "final_qty") -> DataFrame:
    """W2 per flight: what the queue could not give a line."""
    queue = _scanned(lines, inventory, need).where("kind = 1")
    taken = F.col("q1") - F.col("q0")
    return queue.select(
        F.col("id").alias("flight_id"), "product_id", F.col("need").alias("need_qty"), taken.cast("long").alias("taken_qty"),
        (F.col("need") - taken).cast("long").alias("shortfall_qty")).where("shortfall_qty > 0")


def nested_manifest(lines: DataFrame, assignments: DataFrame) -> DataFrame:
    """Every line with the array of its lots (bounded by the line's own quantity)."""
    lot = F.struct("expiry_date", "lot_id", "lot_number", "status", "taken_qty")
    per_line = assignments.groupBy("flight_id", "product_id").agg(F.array_sort(F.collect_list(lot)).alias("lots"))
    return lines.join(per_line, ["flight_id", "product_id"], "left")
