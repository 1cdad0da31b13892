"""Flight calendar rules as column expressions (JVM-side, codegen friendly).

Fixed values (must equal the source rules):
* daypart: departure hour < 11 -> 'Mañana', < 18 -> 'Tarde', otherwise 'Noche'
* season by month: 12, 1, 6, 7, 8 -> 'Alta'; 2, 3, 10, 11 -> 'Media'; otherwise 'Baja'
* route type: distance_km > 1500 -> 'Internacional', otherwise 'Nacional'
* weekday names Monday..Sunday: Lunes, Martes, Miércoles, Jueves, Viernes, Sábado, Domingo
* flight minutes = int(distance_km / 800 * 60), evaluated in double precision
* occupancy range by season: Alta 0.80-0.98, Media 0.70-0.90, Baja 0.55-0.80
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.sources.schemas import WEEKDAYS

HIGH_MONTHS = [12, 1, 6, 7, 8]
MID_MONTHS = [2, 3, 10, 11]
INTERNATIONAL_KM = 1500
OCCUPANCY = {"Alta": (0.80, 0.98), "Media": (0.70, 0.90), "Baja": (0.55, 0.80)}


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def daypart(ts) -> Column:
    h = F.hour(_c(ts))
    return F.when(h < 11, "Mañana").when(h < 18, "Tarde").otherwise("Noche")


def weekday_name(d) -> Column:
    # weekday(): 0 = Monday; element_at is 1-based. Locale independent.
    names = F.array(*[F.lit(n) for n in WEEKDAYS])
    return F.element_at(names, F.weekday(_c(d)) + 1)


def season(d) -> Column:
    m = F.month(_c(d))
    return (
        F.when(m.isin(HIGH_MONTHS), "Alta")
        .when(m.isin(MID_MONTHS), "Media")
        .otherwise("Baja")
    )


def route_type(distance_km) -> Column:
    return F.when(_c(distance_km) > INTERNATIONAL_KM, "Internacional").otherwise(
        "Nacional"
    )


def flight_minutes(distance_km) -> Column:
    # Same operation order as the source rule: (km / 800) * 60, then truncate.
    return F.floor(_c(distance_km).cast("double") / F.lit(800.0) * F.lit(60.0)).cast("int")


def at_minute(date_col, minute_col) -> Column:
    """Local timestamp ``minute_col`` minutes after midnight of ``date_col``.

    Built from date + clock fields (date_add, make_timestamp_ntz), so the result
    never depends on the session time zone: adding an interval to a timestamp
    would skip or repeat wall-clock hours across daylight-saving changes.
    """
    m = _c(minute_col).cast("long")
    days = F.floor(m / F.lit(1440))
    rem = m - days * F.lit(1440)
    d = F.date_add(_c(date_col), days.cast("int"))
    return F.make_timestamp_ntz(
        F.year(d), F.month(d), F.dayofmonth(d), F.floor(rem / F.lit(60)).cast("int"), (rem % 60).cast("int"), F.lit(0)
    )


def minute_of_day(ts) -> Column:
    return F.hour(_c(ts)) * 60 + F.minute(_c(ts))


def minutes_between(start, end) -> Column:
    """Wall-clock minutes from ``start`` to ``end`` (local timestamps)."""
    s, e = _c(start), _c(end)
    return (F.datediff(F.to_date(e), F.to_date(s)) * 1440 + minute_of_day(e) - minute_of_day(s)).cast("long")


def ts_text(ts) -> Column:
    """'yyyy-MM-dd HH:mm:ss' of a local timestamp, without any time-zone step
    (``date_format`` would pass through the session zone)."""
    return F.substring(_c(ts).cast("timestamp_ntz").cast("string"), 1, 19)


def clock_text(ts) -> Column:
    """'HH:mm:ss' of a local timestamp, time-zone free."""
    return F.substring(ts_text(ts), 12, 8)


def arrival_ts(dep_ts, distance_km, buffer_minutes) -> Column:
    minutes = minute_of_day(dep_ts) + flight_minutes(distance_km) + _c(buffer_minutes)
    return at_minute(F.to_date(_c(dep_ts)), minutes)


def occupancy_bounds(season_col) -> tuple[Column, Column]:
    s = _c(season_col)
    lo = F.when(s == "Alta", OCCUPANCY["Alta"][0]).when(s == "Media", OCCUPANCY["Media"][0])
    hi = F.when(s == "Alta", OCCUPANCY["Alta"][1]).when(s == "Media", OCCUPANCY["Media"][1])
    return lo.otherwise(OCCUPANCY["Baja"][0]), hi.otherwise(OCCUPANCY["Baja"][1])
