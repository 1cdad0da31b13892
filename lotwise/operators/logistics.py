"""Denormalised flight logistics view and the model training set (star joins).

Both start from the fact (lot_services). Dimensions are joined by key with no
hints in the view: Spark broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` (static estimate, then AQE's runtime
statistics), and shuffles otherwise. ``flights``, ``lots`` and ``products`` grow
with the data, so they must be free to take the sort-merge path; AQE's skew
join splits a hot flight or lot.

``service_features`` says which path it takes: the static estimate of a side is that of its compressed
files, so millions of lots or products can pass for a few megabytes and would go through the driver. Lots,
products and flights are merged; airlines, airports, aircraft types and categories are broadcast. Lines meet
their lot while they are narrow, then their flight's ids, and names come last: no row of features is dealt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions import calendar as cal
from lotwise.operators.inventory import product_catalog

VIEW_COLUMNS = [
    "flight_id",
    "airline",
    "passengers",
    "origin_iata",
    "origin_locality",
    "dest_iata",
    "dest_locality",
    "dep_date",
    "dep_time",
    "arr_date",
    "arr_time",
    "weekday",
    "season",
    "weather",
    "category_id",
    "category",
    "product_id",
    "product_name",
    "lot_id",
    "lot_number",
    "expiry_date",
    "lot_initial_qty",
    "loaded_qty",
    "leftover_qty",
]

NUMERIC_FEATURES = ["passengers", "distance_km", "max_capacity"]
CATEGORICAL_FEATURES = [
    "airline",
    "route_type",
    "daypart",
    "weekday",
    "season",
    "weather",
    "origin_locality",
    "dest_locality",
    "category",
    "special_type",
]


_FLIGHT_IDS = ["airline_id", "aircraft_type_id", "origin_airport_id", "dest_airport_id"]
_FLIGHT_FEATURES = ["passengers", "distance_km", "route_type", "daypart", "weekday", "season", "weather"]


def _airport_roles(airports: DataFrame):
    origin = airports.select(
        F.col("airport_id").alias("origin_airport_id"),
        F.col("iata_code").alias("origin_iata"),
        F.col("locality").alias("origin_locality"),
    )
    dest = airports.select(
        F.col("airport_id").alias("dest_airport_id"),
        F.col("iata_code").alias("dest_iata"),
        F.col("locality").alias("dest_locality"),
    )
    return origin, dest


def flight_dims(flights: DataFrame, airlines: DataFrame, airports: DataFrame, small=lambda dim: dim) -> DataFrame:
    """flights with airline name and both airports (role-playing joins); ``small`` marks the dimensions."""
    origin, dest = _airport_roles(airports)
    return (
        flights.join(small(airlines.select("airline_id", F.col("name").alias("airline"))), "airline_id")
        .join(small(origin), "origin_airport_id")
        .join(small(dest), "dest_airport_id")
    )


def leftover(loaded: str = "loaded_qty", consumed: str = "consumed_qty"):
    """Quantity brought back; unrecorded consumption counts as 0."""
    return F.col(loaded) - F.coalesce(F.col(consumed), F.lit(0))


def flight_logistics_view(
    flights, airlines, airports, lot_services, lots, products, categories
) -> DataFrame:
    """S5 + J2: one row per service line, 24 columns."""
    fd = flight_dims(flights, airlines, airports)
    # lots JOIN catalog first (dimension-sized), so the fact meets one lot-keyed
    # dimension: one fact shuffle by lot_id instead of one by lot and one by product.
    lot_dim = lots.join(product_catalog(products, categories), "product_id")
    return (
        lot_services.join(fd, "flight_id")
        .join(lot_dim, "lot_id")
        .select(
            "flight_id",
            "airline",
            "passengers",
            "origin_iata",
            "origin_locality",
            "dest_iata",
            "dest_locality",
            F.to_date("dep_ts").alias("dep_date"),
            cal.clock_text("dep_ts").alias("dep_time"),
            F.to_date("arr_ts").alias("arr_date"),
            cal.clock_text("arr_ts").alias("arr_time"),
            "weekday",
            "season",
            "weather",
            "category_id",
            "category",
            "product_id",
            "product_name",
            "lot_id",
            "lot_number",
            "expiry_date",
            F.col("initial_qty").alias("lot_initial_qty"),
            "loaded_qty",
            leftover().alias("leftover_qty"),
        )
    )


def service_features(
    flights, airlines, aircraft_types, airports, lot_services, lots, products, categories, condition,
    flights_first: bool = False,
) -> DataFrame:
    """Service lines matching ``condition`` with 3 numeric + 10 categorical features.

    ``flights_first`` is for lines and flights stored in buckets of the flight: they meet without an exchange.
    """
    flight = flights.select("flight_id", *_FLIGHT_IDS, *_FLIGHT_FEATURES).hint("merge")
    catalog = product_catalog(products, categories)
    lot_dim = lots.select("lot_id", "product_id").join(catalog.hint("merge"), "product_id").drop("category_id").hint("merge")
    fact = lot_services.where(condition).select("service_id", "flight_id", "lot_id", "consumed_qty")
    if flights_first:
        lines = fact.join(flight, "flight_id").join(lot_dim, "lot_id")
    else:
        lines = fact.join(lot_dim, "lot_id").join(flight, "flight_id")
    return (
        flight_dims(lines, airlines, airports, small=F.broadcast)
        .join(F.broadcast(aircraft_types.select("aircraft_type_id", "max_capacity")), "aircraft_type_id")
        .select(
            "service_id",
            "flight_id",
            "product_id",
            "product_name",
            *NUMERIC_FEATURES,
            *CATEGORICAL_FEATURES,
            "consumed_qty",
        )
    )


def training_set(
    flights, airlines, aircraft_types, airports, lot_services, lots, products, categories, flights_first: bool = False
) -> DataFrame:
    """J1 + P1 + P4: features and target of lines with recorded, positive consumption.

    The filter is on the fact and runs before any join.
    """
    return service_features(
        flights, airlines, aircraft_types, airports, lot_services, lots, products, categories,
        F.col("consumed_qty") > 0, flights_first,
    ).drop("flight_id")


def open_requests(
    flights, airlines, aircraft_types, airports, lot_services, lots, products, categories
) -> DataFrame:
    """Forecast requests: planned lines whose consumption is not recorded yet."""
    return service_features(
        flights, airlines, aircraft_types, airports, lot_services, lots, products, categories,
        F.col("consumed_qty").isNull(),
    ).drop("consumed_qty")
