"""Expiry status of a lot.

Fixed values: days <= 0 -> 'critical', <= 3 -> 'warning', <= 7 -> 'attention',
otherwise 'optimal'. Day 0 (expiring today) is already critical.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

CRITICAL, WARNING, ATTENTION, OPTIMAL = "critical", "warning", "attention", "optimal"
AT_RISK = [CRITICAL, WARNING, ATTENTION]


def as_of_col(as_of) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def days_remaining(expiry_col: str | Column, as_of) -> Column:
    e = F.col(expiry_col) if isinstance(expiry_col, str) else expiry_col
    return F.datediff(e, as_of_col(as_of))


def expiry_status(days: str | Column) -> Column:
    d = F.col(days) if isinstance(days, str) else days
    return (
        F.when(d <= 0, CRITICAL)
        .when(d <= 3, WARNING)
        .when(d <= 7, ATTENTION)
        .otherwise(OPTIMAL)
    )
