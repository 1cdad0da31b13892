"""Query registry: name -> (Spark builder, optional DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lotwise.plans.oracle import with_ctes


@dataclass
class Registered:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str


REGISTRY: dict[str, Registered] = {}


def query(name: str, sql: str | None = None, ids: str = ""):
    """Register ``fn(spark, sf_dir) -> DataFrame``; ``sql`` is the oracle body (or None)."""

    def deco(fn):
        REGISTRY[name] = Registered(name, fn, with_ctes(sql) if sql else None, ids)
        return fn

    return deco
