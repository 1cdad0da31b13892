"""Canonical table schemas (English names, explicit Spark types).

Keys are LongType so the same schemas hold at cluster scale; quantities stay
IntegerType as in the source model, and sums of them are BIGINT.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DateType()
_TS = T.TimestampNTZType()
_DEC = T.DecimalType(10, 6)


def _f(name, typ, nullable=False):
    return T.StructField(name, typ, nullable)


AIRPORTS = T.StructType(
    [
        _f("airport_id", _L),
        _f("iata_code", _S),
        _f("name", _S),
        _f("locality", _S),
        _f("latitude", _DEC, True),
        _f("longitude", _DEC, True),
    ]
)

AIRCRAFT_TYPES = T.StructType(
    [_f("aircraft_type_id", _L), _f("model", _S), _f("max_capacity", _I)]
)

AIRLINES = T.StructType(
    [
        _f("airline_id", _L),
        _f("name", _S),
        _f("iata_code", _S),
        _f("association_note", _S, True),
    ]
)

FLIGHTS = T.StructType(
    [
        _f("flight_id", _L),
        _f("airline_id", _L),
        _f("aircraft_type_id", _L),
        _f("origin_airport_id", _L),
        _f("dest_airport_id", _L),
        _f("dep_ts", _TS),
        _f("arr_ts", _TS),
        _f("route_type", _S),
        _f("distance_km", _I),
        _f("passengers", _I),
        _f("daypart", _S),
        _f("weekday", _S),
        _f("season", _S),
        _f("weather", _S),
    ]
)

CATEGORIES = T.StructType([_f("category_id", _L), _f("name", _S)])

PRODUCTS = T.StructType(
    [
        _f("product_id", _L),
        _f("category_id", _L),
        _f("name", _S),
        _f("special_type", _S, True),
    ]
)

LOTS = T.StructType(
    [
        _f("lot_id", _L),
        _f("product_id", _L),
        _f("lot_number", _S),
        _f("expiry_date", _D),
        _f("initial_qty", _I),
    ]
)

LOT_SERVICES = T.StructType(
    [
        _f("service_id", _L),
        _f("flight_id", _L),
        _f("lot_id", _L),
        _f("loaded_qty", _I),
        _f("consumed_qty", _I, True),
    ]
)

TRANSLATIONS = T.StructType([_f("lang", _S), _f("key", _S), _f("template", _S)])

CATALOG = {
    "airports": AIRPORTS,
    "aircraft_types": AIRCRAFT_TYPES,
    "airlines": AIRLINES,
    "flights": FLIGHTS,
    "categories": CATEGORIES,
    "products": PRODUCTS,
    "lots": LOTS,
    "lot_services": LOT_SERVICES,
}

# The closed domains of the flight columns (Spanish codes as stored).
ROUTE_TYPES = ["Nacional", "Internacional"]
DAYPARTS = ["Mañana", "Tarde", "Noche"]
WEEKDAYS = ["Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo"]
SEASONS = ["Baja", "Media", "Alta"]
WEATHERS = ["Soleado", "Lluvioso", "Nevado", "Nublado", "Tormenta"]

DOMAINS = {
    "route_type": ROUTE_TYPES,
    "daypart": DAYPARTS,
    "weekday": WEEKDAYS,
    "season": SEASONS,
    "weather": WEATHERS,
}

# Declared string length limits (CHAR/VARCHAR) per table.column.
MAX_LENGTHS = {
    ("airports", "iata_code"): 3,
    ("airports", "name"): 100,
    ("airports", "locality"): 100,
    ("aircraft_types", "model"): 50,
    ("airlines", "name"): 100,
    ("airlines", "iata_code"): 2,
    ("airlines", "association_note"): 255,
    ("categories", "name"): 50,
    ("products", "name"): 100,
    ("products", "special_type"): 100,
    ("lots", "lot_number"): 50,
}
