"""Registered queries: logistics view, training set, manifests and FEFO allocation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lotwise.operators import allocate as al
from lotwise.operators import inventory as inv
from lotwise.operators import logistics as lg
from lotwise.operators import schedule as sc
from lotwise.plans.oracle import EXTRA
from lotwise.plans.q_inventory import _inventory
from lotwise.plans.registry import query
from lotwise.sources.bucketed import bucketed
from lotwise.sources.driver_tables import tables_for

EXTRA.extend(
    [
        (
            "flight_dims",
            """SELECT f.*, al.name AS airline, o.iata_code AS origin_iata, o.locality AS origin_locality,
                      d.iata_code AS dest_iata, d.locality AS dest_locality
               FROM flights f JOIN airlines al ON f.airline_id = al.airline_id
                              JOIN airports o ON f.origin_airport_id = o.airport_id
                              JOIN airports d ON f.dest_airport_id = d.airport_id""",
        ),
        (
            "training",
            """SELECT s.service_id, l.product_id, k.product_name, f.passengers, f.distance_km, a.max_capacity,
                      f.airline, f.route_type, f.daypart, f.weekday, f.season, f.weather,
                      f.origin_locality, f.dest_locality, k.category, k.special_type, s.consumed_qty
               FROM lot_services s JOIN flight_dims f ON s.flight_id = f.flight_id
                                   JOIN aircraft_types a ON f.aircraft_type_id = a.aircraft_type_id
                                   JOIN lots l ON s.lot_id = l.lot_id
                                   JOIN catalog k ON l.product_id = k.product_id
               WHERE s.consumed_qty > 0""",
        ),
        (
            "open_demand",
            """SELECT p.product_id, p.name AS product_name, CAST(SUM(s.loaded_qty) AS BIGINT) AS base_qty
               FROM lot_services s JOIN lots l ON s.lot_id = l.lot_id
                                   JOIN products p ON l.product_id = p.product_id
               WHERE s.consumed_qty IS NULL GROUP BY p.product_id, p.name""",
        ),
        (
            "manifest",
            """SELECT product_id, product_name, base_qty,
                      CAST(ceil(CAST(base_qty AS DOUBLE) * CAST(0.05 AS DOUBLE)) AS BIGINT) AS buffer_qty,
                      base_qty + CAST(ceil(CAST(base_qty AS DOUBLE) * CAST(0.05 AS DOUBLE)) AS BIGINT) AS final_qty
               FROM open_demand""",
        ),
        (
            "relevant",
            "SELECT * FROM loadable WHERE product_id IN (SELECT product_id FROM manifest)",
        ),
        (
            "fefo",
            """SELECT product_id, lot_id, lot_number, expiry_date, status, taken_qty FROM (
                 SELECT r.product_id, r.lot_id, r.lot_number, r.expiry_date, r.status,
                        CAST(GREATEST(0, LEAST(r.current_qty, m.final_qty - COALESCE(SUM(r.current_qty) OVER (
                            PARTITION BY r.product_id ORDER BY r.expiry_date, r.lot_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken_qty
                 FROM relevant r JOIN manifest m ON r.product_id = m.product_id)
               WHERE taken_qty > 0""",
        ),
    ]
)


def flight_ctes(prefix: str, demand: str) -> list[tuple[str, str]]:
    """Lines, queues and takes of the flights whose ``demand`` is (flight_id, product_id, base_qty)."""
    p = prefix
    return [
        (
            f"{p}flight_lines",
            f"""SELECT d.flight_id, d.product_id, p.name AS product_name, f.dep_ts, d.base_qty,
                      CAST(ceil(CAST(d.base_qty AS DOUBLE) * CAST(0.05 AS DOUBLE)) AS BIGINT) AS buffer_qty,
                      d.base_qty + CAST(ceil(CAST(d.base_qty AS DOUBLE) * CAST(0.05 AS DOUBLE)) AS BIGINT) AS final_qty
               FROM ({demand}) d JOIN products p ON d.product_id = p.product_id JOIN flights f ON d.flight_id = f.flight_id""",
        ),
        (
            f"{p}lot_queue",
            f"""SELECT *, s1 - current_qty AS s0 FROM (
                 SELECT product_id, lot_id, lot_number, expiry_date, status, current_qty,
                        SUM(current_qty) OVER (PARTITION BY product_id ORDER BY expiry_date, lot_id) AS s1
                 FROM loadable WHERE product_id IN (SELECT product_id FROM {p}flight_lines))""",
        ),
        (
            f"{p}line_lead",
            f"""SELECT fl.*, COALESCE(SUM(final_qty) OVER (PARTITION BY product_id ORDER BY dep_ts, flight_id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d,
                      COALESCE((SELECT SUM(current_qty) FROM {p}lot_queue q WHERE q.product_id = fl.product_id
                                AND q.expiry_date <= CAST(fl.dep_ts AS DATE)), 0) AS x,
                      COALESCE((SELECT SUM(current_qty) FROM {p}lot_queue q WHERE q.product_id = fl.product_id), 0) AS stock_all
               FROM {p}flight_lines fl""",
        ),
        (
            f"{p}line_queue",
            f"""SELECT *, LEAST(st, stock_all) AS d0, LEAST(st + final_qty, stock_all) AS d1 FROM (
                 SELECT *, d + GREATEST(0, MAX(x - d) OVER (PARTITION BY product_id ORDER BY dep_ts, flight_id)) AS st
                 FROM {p}line_lead)""",
        ),
        (
            f"{p}flight_takes",
            f"""SELECT l.flight_id, l.product_id, q.lot_id, q.lot_number, q.expiry_date, q.status,
                      CAST(LEAST(q.s1, l.d1) - GREATEST(q.s0, l.d0) AS BIGINT) AS taken_qty
               FROM {p}line_queue l JOIN {p}lot_queue q ON l.product_id = q.product_id AND q.s0 < l.d1 AND l.d0 < q.s1""",
        ),
    ]


def shortfall_sql(prefix: str) -> str:
    return f"""SELECT flight_id, product_id, final_qty AS need_qty, CAST(d1 - d0 AS BIGINT) AS taken_qty,
              CAST(final_qty - (d1 - d0) AS BIGINT) AS shortfall_qty
       FROM {prefix}line_queue WHERE final_qty > d1 - d0"""


EXTRA.extend(flight_ctes("", """SELECT s.flight_id, l.product_id, CAST(SUM(s.loaded_qty) AS BIGINT) AS base_qty
               FROM lot_services s JOIN lots l ON s.lot_id = l.lot_id WHERE s.consumed_qty IS NULL GROUP BY ALL"""))


def _t(spark, sf):
    return tables_for(spark, sf)


def _lines(spark, sf, ordered=False):
    t = _t(spark, sf)
    return al.manifest_lines(al.open_demand(t.lot_services, t.lots, t.products), ordered=ordered)


VIEW_SQL = """SELECT f.flight_id, f.airline, f.passengers, f.origin_iata, f.origin_locality, f.dest_iata,
              f.dest_locality, CAST(f.dep_ts AS DATE) AS dep_date, strftime(f.dep_ts, '%H:%M:%S') AS dep_time,
              CAST(f.arr_ts AS DATE) AS arr_date, strftime(f.arr_ts, '%H:%M:%S') AS arr_time,
              f.weekday, f.season, f.weather, k.category_id, k.category, l.product_id, k.product_name,
              l.lot_id, l.lot_number, l.expiry_date, l.initial_qty AS lot_initial_qty, s.loaded_qty,
              s.loaded_qty - COALESCE(s.consumed_qty, 0) AS leftover_qty
       FROM lot_services s JOIN flight_dims f ON s.flight_id = f.flight_id
                           JOIN lots l ON s.lot_id = l.lot_id
                           JOIN catalog k ON l.product_id = k.product_id"""


@query("flight_logistics_view", VIEW_SQL, ids="S5 J2 P2")
def flight_logistics_view(spark, sf):
    t = _t(spark, sf)
    return lg.flight_logistics_view(
        t.flights, t.airlines, t.airports, t.lot_services, t.lots, t.products, t.categories
    )


_BUCKETED: dict[tuple[str, str], tuple] = {}


def _by_flight(spark, sf):
    """Flights and service lines stored in buckets of the flight (written once a session and directory)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUCKETED:
        t, n = _t(spark, sf), int(spark.conf.get("spark.sql.shuffle.partitions"))
        stored = uuid.uuid4().hex
        _BUCKETED[key] = tuple(
            bucketed(df, "flight_id", n, f"{name}_{stored}") for name, df in (("flights", t.flights), ("lot_services", t.lot_services)))
    return _BUCKETED[key]


@query("flight_logistics_bucketed", VIEW_SQL, ids="S5 J1 J2")
def flight_logistics_bucketed(spark, sf):
    """The same view over stored tables: the fact meets its flights without an exchange."""
    t = _t(spark, sf)
    flights, services = _by_flight(spark, sf)
    return lg.flight_logistics_view(flights, t.airlines, t.airports, services, t.lots, t.products, t.categories)


@query("training_set_bucketed", "SELECT * FROM training", ids="J1 S5")
def training_set_bucketed(spark, sf):
    t = _t(spark, sf)
    flights, services = _by_flight(spark, sf)
    return lg.training_set(
        flights, t.airlines, t.aircraft_types, t.airports, services, t.lots, t.products, t.categories, flights_first=True)


@query("training_set", "SELECT * FROM training", ids="J1 P1 P4")
def training_set(spark, sf):
    t = _t(spark, sf)
    return lg.training_set(
        t.flights, t.airlines, t.aircraft_types, t.airports, t.lot_services, t.lots, t.products, t.categories
    )


@query(
    "manifest_lines",
    "SELECT * FROM manifest ORDER BY final_qty DESC, product_id",
    ids="B5 F11 O2",
)
def manifest_lines(spark, sf):
    return _lines(spark, sf, ordered=True)


@query(
    "manifest_relevant_inventory",
    "SELECT product_id, product_name, lot_id, lot_number, current_qty, expiry_date, status FROM relevant",
    ids="J6",
)
def manifest_relevant_inventory(spark, sf):
    return al.relevant_inventory(_inventory(spark, sf), _lines(spark, sf)).select(
        "product_id", "product_name", "lot_id", "lot_number", "current_qty", "expiry_date", "status"
    )


@query("manifest_fefo_allocation", "SELECT * FROM fefo", ids="W1 O3 B6")
def manifest_fefo_allocation(spark, sf):
    return al.fefo_allocate(_lines(spark, sf), _inventory(spark, sf))


@query(
    "manifest_shortfall",
    """SELECT m.product_id, m.final_qty AS need_qty, CAST(COALESCE(a.available_qty, 0) AS BIGINT) AS available_qty,
              CAST(GREATEST(0, m.final_qty - COALESCE(a.available_qty, 0)) AS BIGINT) AS shortfall_qty
       FROM manifest m LEFT JOIN (SELECT product_id, CAST(SUM(current_qty) AS BIGINT) AS available_qty
                                  FROM relevant GROUP BY product_id) a ON m.product_id = a.product_id
       WHERE m.final_qty - COALESCE(a.available_qty, 0) > 0""",
    ids="W2",
)
def manifest_shortfall(spark, sf):
    return al.shortfall(_lines(spark, sf), _inventory(spark, sf))


def _flight_lines(spark, sf):
    t = _t(spark, sf)
    return sc.open_lines(t.lot_services, t.lots, t.products, t.flights)


def _stock(spark, sf):
    t = _t(spark, sf)
    return inv.lot_stock(t.lots, t.lot_services, t.as_of)


@query("flight_manifest_allocation", "SELECT * FROM flight_takes", ids="B6 W1")
def flight_manifest_allocation(spark, sf):
    return sc.allocate_flights(_flight_lines(spark, sf), _stock(spark, sf))


@query("flight_manifest_shortfall", shortfall_sql(""), ids="B6 W2")
def flight_manifest_shortfall(spark, sf):
    return sc.flight_shortfall(_flight_lines(spark, sf), _stock(spark, sf))


@query(
    "manifest_nested",
    """SELECT m.flight_id, m.product_id, m.product_name, m.base_qty, m.buffer_qty, m.final_qty,
              to_json(COALESCE(t.lots, [])) AS lots
       FROM flight_lines m LEFT JOIN (
         SELECT flight_id, product_id,
                list({'lot_id': lot_id, 'lot_number': lot_number, 'taken_qty': taken_qty}
                     ORDER BY expiry_date, lot_id) AS lots
         FROM flight_takes GROUP BY flight_id, product_id) t
       ON m.flight_id = t.flight_id AND m.product_id = t.product_id""",
    ids="J9",
)
def manifest_nested(spark, sf):
    """Each flight line with the array of its lots, shown as JSON so that engines compare alike."""
    lines = _flight_lines(spark, sf)
    nested = sc.nested_manifest(lines, sc.allocate_flights(lines, _stock(spark, sf)))
    lots = F.transform("lots", lambda x: F.struct(x["lot_id"].alias("lot_id"), x["lot_number"].alias("lot_number"), x["taken_qty"].alias("taken_qty")))
    return nested.select(
        "flight_id", "product_id", "product_name", "base_qty", "buffer_qty", "final_qty",
        F.coalesce(F.to_json(lots), F.lit("[]")).alias("lots"))
