"""DuckDB oracle SQL for the registered queries.

The driver registers its parquet files as views (part, lineitem, orders, ...).
``BASE`` restates the canonical-table derivation of
``lotwise.sources.driver_tables`` in plain SQL; ``DERIVED`` restates the shared
inventory / consumption building blocks. Each oracle query is
``WITH <BASE, DERIVED> <body>``; DuckDB drops the CTEs a body does not use.

Oracle hygiene: sums are cast to BIGINT, doubles rounded to 6 places on both
sides, ``trunc`` where Spark's cast truncates, weekday via ``isodow``.
"""

from __future__ import annotations

AS_OF = "DATE '2001-08-01'"

WEEKDAY_LIST = "['Lunes', 'Martes', 'Miércoles', 'Jueves', 'Viernes', 'Sábado', 'Domingo']"

BASE: list[tuple[str, str]] = [
    (
        "categories",
        """SELECT ('0x' || substr(md5(p_type), 1, 8))::BIGINT AS category_id, p_type AS name
           FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL)""",
    ),
    (
        "airlines",
        """SELECT ('0x' || substr(md5(c_mktsegment), 1, 8))::BIGINT AS airline_id,
                  c_mktsegment AS name, substr(c_mktsegment, 1, 3) AS iata_code,
                  CAST(NULL AS VARCHAR) AS association_note
           FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)""",
    ),
    (
        "airports",
        """SELECT CAST(n_nationkey AS BIGINT) AS airport_id,
                  'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iata_code,
                  n_name || ' Airport' AS name, n_name AS locality,
                  CAST(NULL AS DECIMAL(10,6)) AS latitude, CAST(NULL AS DECIMAL(10,6)) AS longitude
           FROM nation""",
    ),
    (
        "aircraft_types",
        "SELECT CAST(id AS BIGINT) AS aircraft_type_id, model, max_capacity FROM (VALUES (1, 'Generic-500', 500), (2, 'Generic-400', 400), (3, 'Generic-300', 300)) t(id, model, max_capacity)",
    ),
    (
        "products",
        """SELECT p_partkey AS product_id, ('0x' || substr(md5(p_type), 1, 8))::BIGINT AS category_id,
                  p_name AS name, CASE WHEN p_size <= 10 THEN 'VIP' END AS special_type
           FROM part""",
    ),
    (
        "lots",
        f"""SELECT p_partkey * 3 + k AS lot_id, p_partkey AS product_id,
                   'LOT-' || CAST(p_partkey * 3 + k AS VARCHAR) AS lot_number,
                   CAST({AS_OF} + CAST(((p_partkey * 3 + k) * 7) % 45 - 10 AS INTEGER) AS DATE) AS expiry_date,
                   CAST(p_size * 5 AS INTEGER) AS initial_qty
            FROM part, (VALUES (0), (1), (2)) t(k)""",
    ),
    (
        "lot_services",
        """SELECT l_orderkey * 8 + l_linenumber AS service_id, l_orderkey AS flight_id,
                  l_partkey * 3 + l_suppkey % 3 AS lot_id,
                  CAST(trunc(l_quantity) AS INTEGER) AS loaded_qty,
                  CASE WHEN l_linestatus = 'O' THEN NULL
                       WHEN l_returnflag = 'R' THEN 0
                       ELSE CAST(floor(l_quantity * (1.0 - l_discount)) AS INTEGER) END AS consumed_qty
           FROM lineitem""",
    ),
    (
        "flights0",
        f"""SELECT o.o_orderkey AS flight_id, ('0x' || substr(md5(c.c_mktsegment), 1, 8))::BIGINT AS airline_id, CAST(1 + o.o_orderkey % 3 AS BIGINT) AS aircraft_type_id,
                   CAST(c.c_nationkey AS BIGINT) AS origin_airport_id,
                   CAST((c.c_nationkey * 7 + o.o_orderkey) % 25 AS BIGINT) AS dest_airport_id,
                   o.o_orderdate + to_hours(CAST(o.o_orderkey % 24 AS INTEGER))
                                 + to_minutes(CAST((o.o_orderkey % 4) * 15 AS INTEGER)) AS dep_ts,
                   CAST(500 + (o.o_orderkey * 37) % 14501 AS INTEGER) AS distance_km,
                   CAST(1 + floor(o.o_totalprice / 1000) AS INTEGER) AS passengers,
                   CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Tormenta' WHEN '2-HIGH' THEN 'Nevado'
                        WHEN '3-MEDIUM' THEN 'Lluvioso' WHEN '5-LOW' THEN 'Soleado' ELSE 'Sin datos' END AS weather,
                   CAST(30 + o.o_orderkey % 61 AS INTEGER) AS buffer_min
            FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    ),
    (
        "flights",
        f"""SELECT flight_id, airline_id, aircraft_type_id, origin_airport_id, dest_airport_id, dep_ts,
                   dep_ts + to_minutes(CAST(floor(CAST(distance_km AS DOUBLE) / 800.0 * 60.0) AS INTEGER) + buffer_min) AS arr_ts,
                   CASE WHEN distance_km > 1500 THEN 'Internacional' ELSE 'Nacional' END AS route_type,
                   distance_km, passengers,
                   CASE WHEN hour(dep_ts) < 11 THEN 'Mañana' WHEN hour(dep_ts) < 18 THEN 'Tarde' ELSE 'Noche' END AS daypart,
                   ({WEEKDAY_LIST})[isodow(dep_ts + to_minutes(CAST(floor(CAST(distance_km AS DOUBLE) / 800.0 * 60.0) AS INTEGER) + buffer_min))] AS weekday,
                   CASE WHEN month(dep_ts) IN (12, 1, 6, 7, 8) THEN 'Alta'
                        WHEN month(dep_ts) IN (2, 3, 10, 11) THEN 'Media' ELSE 'Baja' END AS season,
                   weather
            FROM flights0""",
    ),
]

DERIVED: list[tuple[str, str]] = [
    (
        "catalog",
        """SELECT p.product_id, p.name AS product_name, p.category_id, c.name AS category, p.special_type
           FROM products p JOIN categories c ON p.category_id = c.category_id""",
    ),
    (
        "lot_consumption",
        """SELECT lot_id, CAST(SUM(COALESCE(consumed_qty, 0)) AS BIGINT) AS consumed_total
           FROM lot_services GROUP BY lot_id""",
    ),
    (
        "inventory0",
        f"""SELECT l.product_id, k.product_name, k.category, l.lot_id, l.lot_number, l.expiry_date,
                   l.initial_qty, CAST(COALESCE(a.consumed_total, 0) AS BIGINT) AS consumed_total,
                   CAST(l.initial_qty AS BIGINT) - COALESCE(a.consumed_total, 0) AS current_qty,
                   CAST(datediff('day', {AS_OF}, l.expiry_date) AS INTEGER) AS days_remaining
            FROM lots l JOIN catalog k ON l.product_id = k.product_id
                        LEFT JOIN lot_consumption a ON l.lot_id = a.lot_id""",
    ),
    (
        "inventory",
        """SELECT *, CASE WHEN days_remaining <= 0 THEN 'critical' WHEN days_remaining <= 3 THEN 'warning'
                          WHEN days_remaining <= 7 THEN 'attention' ELSE 'optimal' END AS status
           FROM inventory0""",
    ),
    ("active", "SELECT * FROM inventory WHERE current_qty > 0"),
    ("loadable", "SELECT * FROM inventory WHERE current_qty > 0 AND status <> 'critical'"),
    (
        "consumption",
        f"""SELECT p.product_id, p.name AS product_name, CAST(SUM(s.consumed_qty) AS BIGINT) AS total_consumed,
                   CAST(SUM(s.consumed_qty) AS DOUBLE) / 30.0 AS avg_daily,
                   CAST(SUM(s.consumed_qty) AS DOUBLE) / 30.0 * 7.0 AS avg_weekly
            FROM lot_services s JOIN flights f ON s.flight_id = f.flight_id
                                JOIN lots l ON s.lot_id = l.lot_id
                                JOIN products p ON l.product_id = p.product_id
            WHERE CAST(f.dep_ts AS DATE) >= {AS_OF} - 30 AND s.consumed_qty IS NOT NULL
            GROUP BY p.product_id, p.name""",
    ),
    (
        "product_stock",
        """SELECT product_id, product_name, CAST(SUM(current_qty) AS BIGINT) AS stock_total
           FROM active GROUP BY product_id, product_name""",
    ),
    (
        "stockout",
        """SELECT s.product_id, s.product_name, s.stock_total AS stock, COALESCE(c.avg_weekly, 0.0) AS avg_weekly
           FROM product_stock s LEFT JOIN consumption c ON s.product_id = c.product_id
           WHERE COALESCE(c.avg_weekly, 0.0) > 0 AND s.stock_total < COALESCE(c.avg_weekly, 0.0) * 0.5""",
    ),
    (
        "lot_rules",
        """SELECT 'high' AS priority, 0 AS priority_rank,
                  CASE WHEN days_remaining <= 0 THEN 'expired' ELSE 'waste_risk' END AS rule,
                  product_id, product_name, lot_id, lot_number, expiry_date, current_qty AS qty,
                  days_remaining, CAST(NULL AS BIGINT) AS stock, CAST(NULL AS DOUBLE) AS avg_weekly,
                  'error' AS severity, CASE WHEN days_remaining <= 0 THEN '🔴' ELSE '🟠' END AS icon
           FROM active WHERE days_remaining <= 3""",
    ),
    (
        "recs",
        """SELECT * FROM lot_rules
           UNION ALL
           SELECT 'medium', 1, 'stockout_risk', product_id, product_name, CAST(NULL AS BIGINT),
                  CAST(NULL AS VARCHAR), CAST(NULL AS DATE), CAST(NULL AS BIGINT), CAST(NULL AS INTEGER),
                  stock, avg_weekly, 'warning', '🟡'
           FROM stockout""",
    ),
]

# Extra CTEs registered by later modules (features, allocation, ...).
EXTRA: list[tuple[str, str]] = []


def with_ctes(body: str) -> str:
    ctes = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in BASE + DERIVED + EXTRA)
    return f"WITH {ctes}\n{body}"
