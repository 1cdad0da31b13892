"""Flight enrichment rules: calendar columns, arrival, occupancy, load and consumption.

These are the deterministic rules of the source data generator, expressed as
column expressions over whole tables. Random draws are replaced by caller
parameters (base consumption rate) and rule tables (load factors, weather
uplift, menu parts); each rule table is a literal expression (CASE / array),
so no join is needed and nothing grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions import calendar as cal

# Fixed values from the source rules.
DEFAULT_LOAD_FACTOR = 1.05
RATE_MIN, RATE_MAX = 0.5, 0.98


def flight_calendar(flights: DataFrame) -> DataFrame:
    """Calendar and route columns derived from departure time and distance."""
    d = F.to_date("dep_ts")
    return flights.select(
        "flight_id",
        d.alias("dep_date"),
        F.hour("dep_ts").alias("dep_hour"),
        cal.daypart("dep_ts").alias("daypart_rule"),
        cal.weekday_name(d).alias("weekday_rule"),
        cal.season(d).alias("season_rule"),
        cal.route_type("distance_km").alias("route_type_rule"),
    )


def estimated_arrival(flights: DataFrame, buffer_minutes: int = 30) -> DataFrame:
    """departure + int(km / 800 * 60) + buffer minutes (crosses midnight)."""
    est = cal.arrival_ts("dep_ts", "distance_km", F.lit(buffer_minutes))
    return flights.select(
        "flight_id",
        cal.flight_minutes("distance_km").alias("flight_minutes"),
        cal.ts_text(est).alias("est_arrival"),
        (cal.minutes_between("dep_ts", "arr_ts") - cal.flight_minutes("distance_km")).alias("buffer_minutes"),
    )


def occupancy_out_of_range(flights: DataFrame, aircraft_types: DataFrame) -> DataFrame:
    """Flights whose passengers / capacity is outside the season's range."""
    lo, hi = cal.occupancy_bounds("season")
    occ = F.try_divide(F.col("passengers").cast("double"), F.col("max_capacity").cast("double"))
    return (
        flights.join(aircraft_types.select("aircraft_type_id", "max_capacity"), "aircraft_type_id")
        .select("flight_id", "season", "passengers", "max_capacity", occ.alias("occupancy"), lo.alias("lo"), hi.alias("hi"))
        .where(F.col("occupancy").isNull() | (F.col("occupancy") < F.col("lo")) | (F.col("occupancy") > F.col("hi")))
    )


def _factor_expr(category_col: str, factors: dict[str, float], default: float):
    e = None
    for cat_name, f in factors.items():
        e = F.when(F.col(category_col) == cat_name, F.lit(float(f))) if e is None else e.when(
            F.col(category_col) == cat_name, F.lit(float(f))
        )
    return F.lit(float(default)) if e is None else e.otherwise(F.lit(float(default)))


def planned_load(
    service_lines: DataFrame,
    factors: dict[str, float] | None = None,
    default: float = DEFAULT_LOAD_FACTOR,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Planned quantity = int(passengers x factor); factor by category rule table.

    ``service_lines`` needs service_id, flight_id, lot_id, passengers, category, loaded_qty;
    ``keep`` passes further columns through.
    """
    factor = _factor_expr("category", factors or {}, default)
    return service_lines.select(
        "service_id",
        "flight_id",
        "lot_id",
        "passengers",
        factor.alias("factor"),
        (F.col("passengers").cast("double") * factor).cast("int").alias("planned_qty"),
        "loaded_qty",
        *keep,
    )


def expected_consumption(
    planned: DataFrame,
    base_rate: float,
    uplifts: list[tuple[list[str], list[str], float]],
) -> DataFrame:
    """B9 + F13: rate = base + first matching (weathers, categories, uplift), clamped
    to [0.5, 0.98]; expected = int(planned x rate).

    ``planned`` needs service_id, flight_id, lot_id, weather, category, planned_qty.
    """
    up = None
    for weathers, cats, u in uplifts:
        cond = F.col("weather").isin(weathers) & F.col("category").isin(cats)
        up = F.when(cond, F.lit(float(u))) if up is None else up.when(cond, F.lit(float(u)))
    up = F.lit(0.0) if up is None else up.otherwise(F.lit(0.0))
    rate = F.least(F.greatest(F.lit(float(base_rate)) + up, F.lit(RATE_MIN)), F.lit(RATE_MAX))
    return planned.select(
        "service_id",
        "flight_id",
        "lot_id",
        "planned_qty",
        rate.alias("rate"),
        (F.col("planned_qty").cast("double") * rate).cast("int").alias("expected_qty"),
    )


def menu_plan(flights: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
    """B10 + U2: eligible menu parts (and their categories) per flight.

    ``parts`` maps 'drinks', 'breakfast', 'mains', 'snacks' to category names.
    Drinks always; breakfast in the morning, mains otherwise; one snack part.
    The parts are concatenated arrays exploded per flight: rows = flights x parts.
    """

    def arr(part):
        return F.array(*[F.struct(F.lit(part).alias("menu_part"), F.lit(c).alias("category")) for c in parts.get(part, [])])

    main = F.when(F.col("daypart") == "Mañana", arr("breakfast")).otherwise(arr("mains"))
    items = F.concat(arr("drinks"), main, arr("snacks"))
    return flights.select("flight_id", "daypart", F.explode(items).alias("m")).select(
        "flight_id", "daypart", "m.menu_part", "m.category"
    )


def flight_products(service_lines: DataFrame, menu: DataFrame, parts: int | None = None) -> DataFrame:
    """A10 + B11: products loaded per flight (de-duplicated), with their lots and
    whether the product's category is on the flight's menu."""
    if parts:  # lines are dealt once, by flight, and all counts are taken in place
        service_lines = service_lines.repartition(parts, "flight_id")
    per = service_lines.groupBy("flight_id", "product_id", "category").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("lot_id").alias("lots")
    )
    on_menu = menu.select("flight_id", "category", "menu_part").dropDuplicates(["flight_id", "category"])
    return per.join(on_menu, ["flight_id", "category"], "left").select(
        "flight_id", "product_id", "category", "lines", "lots", F.col("menu_part").isNotNull().alias("on_menu")
    )


def service_lines(lot_services: DataFrame, flights: DataFrame, lots: DataFrame, catalog: DataFrame) -> DataFrame:
    """Service lines with the flight and product attributes the rules need."""
    lot_dim = lots.select("lot_id", "product_id").join(catalog.select("product_id", "category"), "product_id")
    return lot_services.join(flights.select("flight_id", "passengers", "weather", "daypart"), "flight_id").join(
        lot_dim, "lot_id"
    )
