"""Registered queries: calendar and load rules, data quality, labels and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import labels as lb
from lotwise.operators import enrich as en
from lotwise.operators import inventory as inv
from lotwise.operators import metrics as met
from lotwise.operators import quality as dq
from lotwise.plans.oracle import EXTRA
from lotwise.plans.q_inventory import _inventory, _recommended
from lotwise.plans.registry import query
from lotwise.sources.driver_tables import tables_for
from lotwise.sources.schemas import CATALOG, DOMAINS, MAX_LENGTHS

# Caller-supplied rule tables for the driver's part types (p_type) standing in for
# the catering menu roles: PROMO = drinks, SMALL = breakfast, LARGE/MEDIUM/STANDARD
# = main dishes, ECONOMY = snacks.
DRIVER_LOAD_FACTORS = {"PROMO": 1.2}
DRIVER_BASE_RATE = 0.80
DRIVER_UPLIFTS = [(["Soleado", "Tormenta"], ["PROMO"], 0.08), (["Nevado"], ["SMALL", "LARGE"], 0.05)]
DRIVER_MENU = {
    "drinks": ["PROMO"],
    "breakfast": ["SMALL"],
    "mains": ["LARGE", "MEDIUM", "STANDARD"],
    "snacks": ["ECONOMY"],
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(xs) -> str:
    return ", ".join(_q(x) for x in xs)


_FACTOR_SQL = "CASE " + " ".join(
    f"WHEN category = {_q(k)} THEN CAST({v} AS DOUBLE)" for k, v in DRIVER_LOAD_FACTORS.items()
) + " ELSE CAST(1.05 AS DOUBLE) END"
_UPLIFT_SQL = "CASE " + " ".join(
    f"WHEN weather IN ({_in(w)}) AND category IN ({_in(c)}) THEN CAST({u} AS DOUBLE)" for w, c, u in DRIVER_UPLIFTS
) + " ELSE CAST(0.0 AS DOUBLE) END"
_MENU_VALUES = ", ".join(
    f"({_q(part)}, {_q(cat)}, {i})" for i, (part, cats) in enumerate(DRIVER_MENU.items()) for cat in cats
)


def _es(key: str) -> str:
    return _q(lb.TRANSLATIONS["es"][key])


EXTRA.extend(
    [
        (
            "service_lines",
            """SELECT s.*, f.passengers, f.weather, f.daypart, l.product_id, k.category
               FROM lot_services s JOIN flights f ON s.flight_id = f.flight_id
                                   JOIN lots l ON s.lot_id = l.lot_id
                                   JOIN catalog k ON l.product_id = k.product_id""",
        ),
        (
            "planned",
            f"""SELECT service_id, flight_id, lot_id, passengers, weather, category, loaded_qty,
                       {_FACTOR_SQL} AS factor,
                       CAST(trunc(CAST(passengers AS DOUBLE) * {_FACTOR_SQL}) AS INTEGER) AS planned_qty
                FROM service_lines""",
        ),
        (
            "menu",
            f"""SELECT f.flight_id, f.daypart, m.menu_part, m.category
                FROM flights f JOIN (VALUES {_MENU_VALUES}) m(menu_part, category, ord)
                  ON m.menu_part IN ('drinks', 'snacks')
                  OR (m.menu_part = 'breakfast' AND f.daypart = 'Mañana')
                  OR (m.menu_part = 'mains' AND f.daypart <> 'Mañana')""",
        ),
        (
            "recs_text",
            f"""SELECT rule, product_id, lot_id,
                       CASE priority WHEN 'high' THEN {_es('prio_high')} WHEN 'medium' THEN {_es('prio_medium')}
                                     ELSE {_es('prio_low')} END AS priority_text,
                       CASE rule WHEN 'expired' THEN {_es('rec_type_expired')}
                                 WHEN 'waste_risk' THEN {_es('rec_type_waste_risk')}
                                 ELSE {_es('rec_type_stockout_risk')} END AS type_text,
                       product_name,
                       COALESCE(lot_number, {_es('rec_lote_all')}) AS lot_text,
                       CASE rule
                         WHEN 'expired' THEN replace(replace({_es('rec_metric_expired')}, '{{qty}}', CAST(qty AS VARCHAR)),
                                                     '{{days}}', CAST(abs(days_remaining) AS VARCHAR))
                         WHEN 'waste_risk' THEN replace(replace({_es('rec_metric_expiring')}, '{{qty}}', CAST(qty AS VARCHAR)),
                                                        '{{days}}', CAST(abs(days_remaining) AS VARCHAR))
                         ELSE replace(replace({_es('rec_metric_stockout')}, '{{stock:.0f}}', CAST(stock AS VARCHAR)),
                                      '{{consumo:.1f}}', printf('%.1f', avg_weekly)) END AS metric_text,
                       CASE rule WHEN 'expired' THEN {_es('rec_action_expired')}
                                 WHEN 'waste_risk' THEN {_es('rec_action_expiring')}
                                 ELSE {_es('rec_action_stockout')} END AS action_text
                FROM recs""",
        ),
    ]
)


def _t(spark, sf):
    return tables_for(spark, sf)


def _lines(spark, sf):
    t = _t(spark, sf)
    return en.service_lines(t.lot_services, t.flights, t.lots, inv.product_catalog(t.products, t.categories))


# ---------------------------------------------------------------- calendar and load rules


@query(
    "flight_calendar",
    """SELECT flight_id, CAST(dep_ts AS DATE) AS dep_date, CAST(hour(dep_ts) AS INTEGER) AS dep_hour,
              CASE WHEN hour(dep_ts) < 11 THEN 'Mañana' WHEN hour(dep_ts) < 18 THEN 'Tarde' ELSE 'Noche' END AS daypart_rule,
              (['Lunes', 'Martes', 'Miércoles', 'Jueves', 'Viernes', 'Sábado', 'Domingo'])[isodow(dep_ts)] AS weekday_rule,
              CASE WHEN month(dep_ts) IN (12, 1, 6, 7, 8) THEN 'Alta' WHEN month(dep_ts) IN (2, 3, 10, 11) THEN 'Media'
                   ELSE 'Baja' END AS season_rule,
              CASE WHEN distance_km > 1500 THEN 'Internacional' ELSE 'Nacional' END AS route_type_rule
       FROM flights""",
    ids="F5 F6 F7 F8",
)
def flight_calendar(spark, sf):
    return en.flight_calendar(_t(spark, sf).flights)


@query(
    "estimated_arrival",
    """SELECT flight_id, m AS flight_minutes,
              strftime(dep_ts + to_minutes(m + 30), '%Y-%m-%d %H:%M:%S') AS est_arrival,
              CAST(date_diff('minute', dep_ts, arr_ts) - m AS BIGINT) AS buffer_minutes
       FROM (SELECT *, CAST(floor(CAST(distance_km AS DOUBLE) / 800.0 * 60.0) AS INTEGER) AS m FROM flights)""",
    ids="F9",
)
def estimated_arrival(spark, sf):
    return en.estimated_arrival(_t(spark, sf).flights)


@query(
    "occupancy_out_of_range",
    """SELECT flight_id, season, passengers, max_capacity, round(occupancy, 6) AS occupancy, lo, hi FROM (
         SELECT f.flight_id, f.season, f.passengers, a.max_capacity,
                CAST(f.passengers AS DOUBLE) / CAST(a.max_capacity AS DOUBLE) AS occupancy,
                CASE f.season WHEN 'Alta' THEN CAST(0.80 AS DOUBLE) WHEN 'Media' THEN CAST(0.70 AS DOUBLE)
                              ELSE CAST(0.55 AS DOUBLE) END AS lo,
                CASE f.season WHEN 'Alta' THEN CAST(0.98 AS DOUBLE) WHEN 'Media' THEN CAST(0.90 AS DOUBLE)
                              ELSE CAST(0.80 AS DOUBLE) END AS hi
         FROM flights f JOIN aircraft_types a ON f.aircraft_type_id = a.aircraft_type_id)
       WHERE occupancy < lo OR occupancy > hi""",
    ids="B7",
)
def occupancy_out_of_range(spark, sf):
    t = _t(spark, sf)
    o = en.occupancy_out_of_range(t.flights, t.aircraft_types)
    return o.withColumn("occupancy", F.round("occupancy", 6))


@query(
    "planned_load",
    "SELECT service_id, flight_id, lot_id, passengers, factor, planned_qty, loaded_qty FROM planned",
    ids="B8",
)
def planned_load(spark, sf):
    return en.planned_load(_lines(spark, sf), DRIVER_LOAD_FACTORS)


@query(
    "expected_consumption",
    f"""SELECT service_id, flight_id, lot_id, planned_qty, round(rate, 6) AS rate,
               CAST(trunc(CAST(planned_qty AS DOUBLE) * rate) AS INTEGER) AS expected_qty
        FROM (SELECT *, least(greatest(CAST({DRIVER_BASE_RATE} AS DOUBLE) + {_UPLIFT_SQL}, CAST(0.5 AS DOUBLE)),
                              CAST(0.98 AS DOUBLE)) AS rate FROM planned)""",
    ids="B9 F13",
)
def expected_consumption(spark, sf):
    planned = en.planned_load(_lines(spark, sf), DRIVER_LOAD_FACTORS, keep=("weather", "category"))
    e = en.expected_consumption(planned, DRIVER_BASE_RATE, DRIVER_UPLIFTS)
    return e.withColumn("rate", F.round("rate", 6))


@query("menu_plan", "SELECT flight_id, daypart, menu_part, category FROM menu", ids="B10 U2")
def menu_plan(spark, sf):
    return en.menu_plan(_t(spark, sf).flights, DRIVER_MENU)


FLIGHT_LINES = 200_000  # service lines of a task


@query(
    "flight_products",
    """SELECT p.flight_id, p.product_id, p.category, p.lines, p.lots, m.menu_part IS NOT NULL AS on_menu
       FROM (SELECT flight_id, product_id, category, COUNT(*) AS lines, COUNT(DISTINCT lot_id) AS lots
             FROM service_lines GROUP BY flight_id, product_id, category) p
       LEFT JOIN (SELECT DISTINCT flight_id, category, 'x' AS menu_part FROM menu) m
         ON p.flight_id = m.flight_id AND p.category = m.category""",
    ids="A10 B11",
)
def flight_products(spark, sf):
    t = _t(spark, sf)
    # the parts follow the rows (read from the files' footers), so a task's lines stay as many on larger tables
    parts = max(spark.sparkContext.defaultParallelism, -(-t.lot_services.count() // FLIGHT_LINES))
    return en.flight_products(_lines(spark, sf), en.menu_plan(t.flights, DRIVER_MENU), parts)


# ---------------------------------------------------------------- data quality

_PK_SQL = "\nUNION ALL ".join(
    f"""SELECT {_q(t)} AS table_name, {_q(','.join(cols))} AS key_columns, key_value, n FROM (
          SELECT concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}) AS key_value, COUNT(*) AS n
          FROM {t} GROUP BY 1 HAVING COUNT(*) > 1)"""
    for t, keys in dq.PRIMARY_KEYS.items()
    for cols in keys
)


@query("dq_duplicate_keys", _PK_SQL, ids="Q1")
def dq_duplicate_keys(spark, sf):
    return dq.duplicate_keys(_t(spark, sf).as_dict())


@query(
    "dq_duplicate_flight_lot",
    "SELECT flight_id, lot_id, COUNT(*) AS n FROM lot_services GROUP BY flight_id, lot_id HAVING COUNT(*) > 1",
    ids="Q2",
)
def dq_duplicate_flight_lot(spark, sf):
    return dq.duplicate_flight_lot(_t(spark, sf).lot_services)


_FK_SQL = "\nUNION ALL ".join(
    f"""SELECT {_q(child)} AS child_table, {_q(col)} AS fk_column, {_q(parent)} AS parent_table,
               COUNT(*) AS orphan_rows
        FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pcol} = c.{col})"""
    for child, col, parent, pcol in dq.FOREIGN_KEYS
)


@query("dq_orphans", _FK_SQL, ids="Q3")
def dq_orphans(spark, sf):
    return dq.orphans(_t(spark, sf).as_dict())


@query(
    "dq_flights_without_services",
    "SELECT flight_id FROM flights f WHERE NOT EXISTS (SELECT 1 FROM lot_services s WHERE s.flight_id = f.flight_id)",
    ids="Q3",
)
def dq_flights_without_services(spark, sf):
    t = _t(spark, sf)
    return dq.flights_without_services(t.flights, t.lot_services)


_DOMAIN_SQL = "\nUNION ALL ".join(
    f"SELECT {_q(c)} AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL OR {c} NOT IN ({_in(v)})) AS bad_rows FROM flights"
    for c, v in DOMAINS.items()
)


@query("dq_domain", _DOMAIN_SQL, ids="Q4")
def dq_domain(spark, sf):
    return dq.domain_violations(_t(spark, sf).flights)


def _null_sql():
    parts = []
    for t, schema in CATALOG.items():
        for f in schema.fields:
            n_null = f"COUNT(*) FILTER (WHERE {f.name} IS NULL)" if not f.nullable else "COUNT(*) FILTER (WHERE FALSE)"
            lim = MAX_LENGTHS.get((t, f.name))
            n_long = f"COUNT(*) FILTER (WHERE length({f.name}) > {lim})" if lim else "COUNT(*) FILTER (WHERE FALSE)"
            parts.append(
                f"SELECT {_q(t)} AS table_name, {_q(f.name)} AS column_name, {n_null} AS null_rows, "
                f"{n_long} AS too_long_rows FROM {t}"
            )
    return "\nUNION ALL ".join(parts)


@query("dq_null_counts", _null_sql(), ids="Q5")
def dq_null_counts(spark, sf):
    return dq.null_and_length(_t(spark, sf).as_dict())


@query(
    "dq_calendar_mismatch",
    """SELECT flight_id, column_name, stored, derived FROM (
         SELECT flight_id, 'daypart' AS column_name, daypart AS stored,
                CASE WHEN hour(dep_ts) < 11 THEN 'Mañana' WHEN hour(dep_ts) < 18 THEN 'Tarde' ELSE 'Noche' END AS derived
         FROM flights
         UNION ALL
         SELECT flight_id, 'weekday', weekday,
                (['Lunes', 'Martes', 'Miércoles', 'Jueves', 'Viernes', 'Sábado', 'Domingo'])[isodow(dep_ts)] FROM flights
         UNION ALL
         SELECT flight_id, 'season', season,
                CASE WHEN month(dep_ts) IN (12, 1, 6, 7, 8) THEN 'Alta' WHEN month(dep_ts) IN (2, 3, 10, 11) THEN 'Media'
                     ELSE 'Baja' END FROM flights
         UNION ALL
         SELECT flight_id, 'route_type', route_type,
                CASE WHEN distance_km > 1500 THEN 'Internacional' ELSE 'Nacional' END FROM flights)
       WHERE stored IS DISTINCT FROM derived""",
    ids="Q6",
)
def dq_calendar_mismatch(spark, sf):
    return dq.calendar_mismatch(_t(spark, sf).flights)


# ---------------------------------------------------------------- labels and text


@query("recommendations_text", "SELECT * FROM recs_text", ids="F15 B4 F14")
def recommendations_text(spark, sf):
    return lb.recommendations_text(_recommended(spark, sf), "es")


@query(
    "recommendation_days_from_text",
    """SELECT rule, product_id, lot_id,
              CASE WHEN regexp_extract(metric_text, '(\\d+)\\s+(days|días)', 1) = '' THEN 999
                   WHEN metric_text LIKE '%expired%' OR metric_text LIKE '%caducados%'
                     THEN -CAST(regexp_extract(metric_text, '(\\d+)\\s+(days|días)', 1) AS INTEGER)
                   ELSE CAST(regexp_extract(metric_text, '(\\d+)\\s+(days|días)', 1) AS INTEGER) END AS days_parsed
       FROM recs_text""",
    ids="F17",
)
def recommendation_days_from_text(spark, sf):
    t = lb.recommendations_text(_recommended(spark, sf), "es")
    return t.select("rule", "product_id", "lot_id", lb.days_from_text("metric_text").alias("days_parsed"))


@query(
    "inventory_kpis_text",
    """SELECT format('{:,}', CAST(COALESCE(SUM(current_qty), 0) AS BIGINT)) AS total_items_text,
              format('{:,}', COUNT(*)) AS active_lots_text,
              format('{:,}', COUNT(*) FILTER (WHERE status = 'optimal')) AS optimal_lots_text,
              format('{:,}', COUNT(*) FILTER (WHERE status IN ('critical', 'warning', 'attention'))) AS at_risk_lots_text
       FROM active""",
    ids="F16",
)
def inventory_kpis_text(spark, sf):
    return met.inventory_kpis_text(_inventory(spark, sf))


_LABEL_VALUES = ", ".join(
    f"({_q(lang)}, {_q(k)}, {_q(v)})" for lang, d in lb.TRANSLATIONS.items() for k, v in d.items()
)
_LANGS = ["es", "en", "fr"]


@query(
    "label_lookup",
    f"""SELECT r.lang, r.key, COALESCE(a.template, b.template, '[' || r.key || ']') AS template
        FROM (SELECT l.lang, k.key FROM (SELECT unnest([{_in(_LANGS)}]) AS lang) l,
                (SELECT DISTINCT 'status_' || status AS key FROM active
                 UNION ALL SELECT DISTINCT 'color_' || status FROM active) k) r
        LEFT JOIN (VALUES {_LABEL_VALUES}) a(lang, key, template) ON a.lang = r.lang AND a.key = r.key
        LEFT JOIN (VALUES {_LABEL_VALUES}) b(lang, key, template) ON b.lang = 'es' AND b.key = r.key""",
    ids="F18 F19",
)
def label_lookup(spark, sf):
    st = inv.active_inventory(_inventory(spark, sf)).select("status").distinct()
    keys = st.select(
        F.explode(F.array(F.concat(F.lit("status_"), "status"), F.concat(F.lit("color_"), "status"))).alias("key")
    )
    req = keys.select(F.explode(F.array(*[F.lit(x) for x in _LANGS])).alias("lang"), "key")
    return req.select("lang", "key", lb.label(F.col("lang"), F.col("key")).alias("template"))


_COLOR_CASE = "CASE status " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in lb.STATUS_COLORS.items()) + f" ELSE {_q(lb.DEFAULT_COLOR)} END"
_STATUS_ES = "CASE status " + " ".join(
    f"WHEN {_q(s)} THEN {_es('status_' + s)}" for s in ("critical", "warning", "attention", "optimal")
) + " ELSE '[status_' || status || ']' END"


@query(
    "status_distribution_display",
    f"""SELECT status, COUNT(*) AS lot_count, {_STATUS_ES} AS label, {_COLOR_CASE} AS color
        FROM active GROUP BY status""",
    ids="F20 A5",
)
def status_distribution_display(spark, sf):
    d = met.status_distribution(_inventory(spark, sf))
    return d.select("status", "lot_count", lb.status_label("status", "es").alias("label"), lb.status_color("status").alias("color"))


_AUDIT_H = {k: lb.header("es", v) for k, v in lb.AUDIT_HEADERS.items()}


@query(
    "lot_audit_es",
    f"""SELECT {_STATUS_ES} AS "{_AUDIT_H['status']}", days_remaining AS "{_AUDIT_H['days_remaining']}",
               product_name AS "{_AUDIT_H['product_name']}", lot_number AS "{_AUDIT_H['lot_number']}",
               current_qty AS "{_AUDIT_H['current_qty']}", strftime(expiry_date, '%Y-%m-%d') AS "{_AUDIT_H['expiry_date']}"
        FROM inventory""",
    ids="P13 F4 F19",
)
def lot_audit_es(spark, sf):
    return lb.lot_audit_display(_inventory(spark, sf), "es")
