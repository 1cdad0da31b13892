"""Canonical catering tables derived from the driver's TPC-H-like parquet files.

Every derivation is a plain column expression that DuckDB can state the same way
(see ``lotwise.plans.oracle``), so each query has an independent SQL oracle.

    products      <- part          (id = p_partkey, category = p_type, VIP if p_size <= 10)
    lots          <- part x {0,1,2} (lot_id = p_partkey*3 + k, expiry around as_of)
    lot_services  <- lineitem      (flight = l_orderkey, lot = l_partkey*3 + l_suppkey % 3)
    flights       <- orders JOIN customer
    airports      <- nation, airlines <- distinct c_mktsegment, categories <- distinct p_type

Vocabulary ids (categories, airlines) are the first 32 bits of the name's md5,
so products and flights carry them without a join or a global ranking.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import calendar as cal
from lotwise.sources.literals import literal_table

AS_OF = _dt.date(2001, 8, 1)
LOTS_PER_PART = 3
WEATHER_OF = {"1-URGENT": "Tormenta", "2-HIGH": "Nevado", "3-MEDIUM": "Lluvioso", "5-LOW": "Soleado"}
NO_WEATHER = "Sin datos"
# Aircraft types (id, model, capacity); flights use type 1 + o_orderkey % 3.
AIRCRAFT = [(1, "Generic-500", 500), (2, "Generic-400", 400), (3, "Generic-300", 300)]


@dataclass
class Tables:
    airports: DataFrame
    aircraft_types: DataFrame
    airlines: DataFrame
    flights: DataFrame
    categories: DataFrame
    products: DataFrame
    lots: DataFrame
    lot_services: DataFrame
    as_of: _dt.date = AS_OF

    def as_dict(self) -> dict[str, DataFrame]:
        return {
            k: getattr(self, k)
            for k in (
                "airports",
                "aircraft_types",
                "airlines",
                "flights",
                "categories",
                "products",
                "lots",
                "lot_services",
            )
        }


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def name_id(col: str):
    """Stable id of a vocabulary string: first 32 bits of its md5 (no window, no join)."""
    return F.conv(F.substring(F.md5(F.col(col)), 1, 8), 16, 10).cast("long")


def _vocabulary(values: DataFrame, col: str, id_col: str) -> DataFrame:
    d = values.select(F.col(col).alias("name")).where(F.col("name").isNotNull()).distinct()
    return d.withColumn(id_col, name_id("name"))


def derive_tables(spark: SparkSession, sf_dir: str, as_of: _dt.date = AS_OF) -> Tables:
    part = _read(spark, sf_dir, "part")
    lineitem = _read(spark, sf_dir, "lineitem")
    orders = _read(spark, sf_dir, "orders")
    customer = _read(spark, sf_dir, "customer")
    nation = _read(spark, sf_dir, "nation")

    categories = _vocabulary(part, "p_type", "category_id").select("category_id", "name")
    airlines = _vocabulary(customer, "c_mktsegment", "airline_id").select(
        "airline_id",
        "name",
        F.substring("name", 1, 3).alias("iata_code"),  # longer than the column allows: a finding for Q5
        F.lit(None).cast("string").alias("association_note"),
    )

    products = part.select(
        F.col("p_partkey").alias("product_id"),
        name_id("p_type").alias("category_id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") <= 10, F.lit("VIP")).alias("special_type"),
    )

    k = F.explode(F.sequence(F.lit(0), F.lit(LOTS_PER_PART - 1))).alias("k")
    lot_id = F.col("p_partkey") * LOTS_PER_PART + F.col("k")
    lots = (
        part.select("p_partkey", "p_size", k)
        .withColumn("lot_id", lot_id)
        .select(
            "lot_id",
            F.col("p_partkey").alias("product_id"),
            F.concat(F.lit("LOT-"), F.col("lot_id").cast("string")).alias("lot_number"),
            F.date_add(F.lit(as_of), ((F.col("lot_id") * 7) % 45 - 10).cast("int")).alias(
                "expiry_date"
            ),
            (F.col("p_size") * 5).cast("int").alias("initial_qty"),
        )
    )

    lot_services = lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("service_id"),
        F.col("l_orderkey").alias("flight_id"),
        (F.col("l_partkey") * LOTS_PER_PART + F.col("l_suppkey") % LOTS_PER_PART).alias(
            "lot_id"
        ),
        F.col("l_quantity").cast("int").alias("loaded_qty"),
        F.when(F.col("l_linestatus") == "O", F.lit(None).cast("int"))
        .when(F.col("l_returnflag") == "R", F.lit(0))
        .otherwise(F.floor(F.col("l_quantity") * (F.lit(1.0) - F.col("l_discount"))).cast("int"))
        .alias("consumed_qty"),
    )

    ok = F.col("o_orderkey")
    dep_ts = cal.at_minute(F.to_date("o_orderdate"), (ok % 24) * 60 + (ok % 4) * 15)
    # the stored weather follows the order's priority; "not specified" is no known weather (Q4, M6)
    weather = F.coalesce(*[F.when(F.col("o_orderpriority") == p, F.lit(w)) for p, w in WEATHER_OF.items()], F.lit(NO_WEATHER))
    distance = (F.lit(500) + (ok * 37) % 14501).cast("int")
    flights = (
        orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
        .select(
            ok.alias("flight_id"),
            name_id("c_mktsegment").alias("airline_id"),
            (F.lit(1) + ok % 3).cast("long").alias("aircraft_type_id"),
            F.col("c_nationkey").cast("long").alias("origin_airport_id"),
            ((F.col("c_nationkey") * 7 + ok) % 25).cast("long").alias("dest_airport_id"),
            F.col("o_orderdate").alias("dep_date"),  # as stored, so that bounds on it reach the scan
            dep_ts.alias("dep_ts"),
            distance.alias("distance_km"),
            (F.lit(1) + F.floor(F.col("o_totalprice") / 1000)).cast("int").alias("passengers"),
            weather.alias("weather"),
            (F.lit(30) + ok % 61).cast("int").alias("buffer_min"),
        )
        .withColumn("arr_ts", cal.arrival_ts("dep_ts", "distance_km", "buffer_min"))
        .select(
            "flight_id",
            "airline_id",
            "aircraft_type_id",
            "origin_airport_id",
            "dest_airport_id",
            "dep_date",
            "dep_ts",
            "arr_ts",
            cal.route_type("distance_km").alias("route_type"),
            "distance_km",
            "passengers",
            cal.daypart("dep_ts").alias("daypart"),
            cal.weekday_name(F.to_date("arr_ts")).alias("weekday"),
            cal.season(F.to_date("dep_ts")).alias("season"),
            "weather",
        )
    )

    airports = nation.select(
        F.col("n_nationkey").cast("long").alias("airport_id"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias(
            "iata_code"
        ),
        F.concat(F.col("n_name"), F.lit(" Airport")).alias("name"),
        F.col("n_name").alias("locality"),
        F.lit(None).cast("decimal(10,6)").alias("latitude"),
        F.lit(None).cast("decimal(10,6)").alias("longitude"),
    )
    aircraft_types = literal_table(spark, AIRCRAFT, "aircraft_type_id long, model string, max_capacity int")

    return Tables(
        airports=airports,
        aircraft_types=aircraft_types,
        airlines=airlines,
        flights=flights,
        categories=categories,
        products=products,
        lots=lots,
        lot_services=lot_services,
        as_of=as_of,
    )


_CACHE: dict[tuple, Tables] = {}


def tables_for(spark: SparkSession, sf_dir: str, as_of: _dt.date = AS_OF) -> Tables:
    """Memoised per session and directory (plans are lazy; this only saves analysis)."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, as_of)
    if key not in _CACHE:
        _CACHE[key] = derive_tables(spark, sf_dir, as_of)
    return _CACHE[key]
