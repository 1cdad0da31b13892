"""Hand-built inputs for unit tests.

``seed_tables`` reproduces the seed inventory: 12 products in 6 categories, one lot
each, with the per-lot consumption totals and the consumption inside the 30-day
window before ``SEED_AS_OF`` (2025-10-25). The expected values are listed in
FIXTURES.md section 3.
"""

from __future__ import annotations

import datetime as dt

from lotwise.sources import schemas as S

SEED_AS_OF = dt.date(2025, 10, 25)

CATEGORIES = [
    (401, "Desayuno Caliente"),
    (402, "Almuerzo Frío"),
    (403, "Platos Calientes (Rotativo)"),
    (404, "Selecciones de Quesos"),
    (405, "Bebidas (No Alcohólicas)"),
    (406, "Snacks y Panadería"),
]
PRODUCTS = [
    (501, 401, "Salchicha de Pavo", None),
    (502, 401, "Ratatouille", "Vegetariano"),
    (503, 402, "Pollo con Ensalada", None),
    (504, 402, "Sándwich de pavo", None),
    (505, 403, "Ragú de Ternera", None),
    (506, 403, "Lomo de Salmón", "VIP"),
    (507, 404, "Camembert", None),
    (508, 404, "Blue Castello", None),
    (509, 405, "Agua Mineral", None),
    (510, 405, "Refresco Cola", None),
    (511, 406, "Pan dulce", None),
    (512, 406, "Papitas", None),
]
# lot_id, product_id, expiry, initial, consumed in total, consumed in the 30-day window
LOTS = [
    (608, 502, "2025-10-15", 4000, 3079, 199),
    (612, 511, "2025-10-26", 8000, 3104, 185),
    (605, 506, "2025-10-27", 2000, 885, 0),
    (610, 507, "2025-10-27", 3000, 1039, 184),
    (611, 508, "2025-10-28", 7000, 877, 0),
    (609, 504, "2025-11-01", 10000, 579, 0),
    (604, 503, "2025-11-05", 7800, 1192, 0),
    (603, 501, "2025-11-13", 6000, 2388, 214),
    (607, 505, "2026-01-28", 1000, 957, 197),
    (601, 509, "2026-02-28", 50000, 11745, 582),
    (606, 512, "2026-03-16", 10000, 2969, 197),
    (602, 510, "2026-06-01", 30000, 10640, 598),
]


def _flight(fid, ts):
    return (fid, 301, 101, 201, 202, ts, ts + dt.timedelta(hours=2), "Nacional", 900, 150,
            "Tarde", "Lunes", "Media", "Soleado")


def seed_tables(spark):
    d = dt.date.fromisoformat
    flights = spark.createDataFrame(
        [
            _flight(1, dt.datetime(2025, 10, 20, 12, 0)),  # inside the window
            _flight(2, dt.datetime(2024, 1, 10, 12, 0)),  # outside
            _flight(3, dt.datetime(2025, 10, 24, 9, 0)),  # inside, consumption not recorded
        ],
        S.FLIGHTS,
    )
    services, sid = [], 1
    for lot, _p, _e, _i, total, window in LOTS:
        if window:
            services.append((sid, 1, lot, window + 10, window)); sid += 1
        if total - window:
            services.append((sid, 2, lot, total - window + 5, total - window)); sid += 1
        services.append((sid, 3, lot, 50, None)); sid += 1
    return {
        "categories": spark.createDataFrame(CATEGORIES, S.CATEGORIES),
        "products": spark.createDataFrame(PRODUCTS, S.PRODUCTS),
        "lots": spark.createDataFrame(
            [(l, p, f"L-{l}", d(e), i) for l, p, e, i, _t, _w in LOTS], S.LOTS
        ),
        "flights": flights,
        "lot_services": spark.createDataFrame(services, S.LOT_SERVICES),
    }
