"""Data-quality checks for the constraints the source database declares.

Spark does not enforce keys, so each declared constraint becomes a batch check:

* Q1 primary / unique keys   -> counts of key hashes, then only rows whose hash repeats by their full keys
* Q2 composite unique key    -> GROUP BY (flight_id, lot_id) HAVING count > 1
* Q3 foreign keys            -> one aggregation over the keys that children use and parents have
* Q4 closed domains (ENUM)   -> NOT isin(...)
* Q5 not-null and max length -> count_if in one aggregate per table
* Q6 rule conformance        -> stored calendar columns versus the rules

All checks are aggregations: Q1 reads a table twice, the others once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions import calendar as cal
from lotwise.sources.literals import literal_table
from lotwise.sources.schemas import CATALOG, DOMAINS, MAX_LENGTHS

PRIMARY_KEYS = {
    "airports": [["airport_id"], ["iata_code"]],
    "aircraft_types": [["aircraft_type_id"], ["model"]],
    "airlines": [["airline_id"], ["name"], ["iata_code"]],
    "flights": [["flight_id"]],
    "categories": [["category_id"], ["name"]],
    "products": [["product_id"]],
    "lots": [["lot_id"], ["lot_number"]],
    "lot_services": [["service_id"]],
}

FOREIGN_KEYS = [
    ("flights", "airline_id", "airlines", "airline_id"),
    ("flights", "aircraft_type_id", "aircraft_types", "aircraft_type_id"),
    ("flights", "origin_airport_id", "airports", "airport_id"),
    ("flights", "dest_airport_id", "airports", "airport_id"),
    ("products", "category_id", "categories", "category_id"),
    ("lots", "product_id", "products", "product_id"),
    ("lot_services", "flight_id", "flights", "flight_id"),
    ("lot_services", "lot_id", "lots", "lot_id"),
]


def _union(dfs):
    return reduce(lambda a, b: a.unionByName(b), dfs)


def _present(cols: list[str]):
    """A key with a null is no key value."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def _key_rows(tables: dict[str, DataFrame], keys, shown: bool) -> DataFrame:
    """(check, h) of every key value of every table, in one scan a table; ``shown`` adds the value as text."""
    parts, check = [], 0
    for t, of_table in keys.items():
        values = []
        for cols in of_table:
            text = [F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("key_value")] if shown else []
            values.append(F.when(_present(cols), F.struct(F.lit(check).alias("check"), F.xxhash64(*cols).alias("h"), *text)))
            check += 1
        parts.append(tables[t].select(F.explode(F.array_compact(F.array(*values))).alias("k")).select("k.*"))
    return _union(parts)


def repeated_hashes(tables: dict[str, DataFrame], keys=None) -> DataFrame:
    """(check, h): 64-bit hashes that occur more than once among the values of a key.

    All keys of all tables in one aggregation over a number and a hash; a key column itself, whatever its
    width, is not shuffled.
    """
    rows = _key_rows(tables, PRIMARY_KEYS if keys is None else keys, shown=False)
    return rows.groupBy("check", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("check", "h")


def duplicate_keys(tables: dict[str, DataFrame], keys=None) -> DataFrame:
    """Q1: key values that occur more than once, per (table, key).

    Only rows whose hash repeats are grouped by hash and value, so unique keys are not shuffled again; two
    different values of one hash are told apart there, and so are different columns that read the same.
    """
    keys = PRIMARY_KEYS if keys is None else keys
    names = [(t, ",".join(cols)) for t, of_table in keys.items() for cols in of_table]
    spark = next(iter(tables.values())).sparkSession
    checks = literal_table(spark, [(i, *n) for i, n in enumerate(names)], "check int, table_name string, key_columns string")
    found = (
        _key_rows(tables, keys, shown=True).join(repeated_hashes(tables, keys), ["check", "h"], "left_semi")
        .groupBy("check", "h", "key_value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    return found.join(checks, "check").select("table_name", "key_columns", "key_value", "n")


def duplicate_flight_lot(lot_services: DataFrame) -> DataFrame:
    """Q2: (flight_id, lot_id) pairs loaded more than once."""
    return (
        lot_services.groupBy("flight_id", "lot_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Q3: rows whose foreign key has no parent, counted per constraint (zeros kept).

    Every table is read once: a row gives the keys it uses as a child and the keys it has as a parent, each
    with the number of its constraint. Summed per (constraint, key), a key that is used and that no parent has is an
    orphan; rows of a hot key are summed before the shuffle. A null reference has no parent.
    """
    names = dict.fromkeys(x for child, _, parent, _ in FOREIGN_KEYS for x in (child, parent))
    parts = []
    for t in names:
        entries = []
        for check, (child, col, parent, pcol) in enumerate(FOREIGN_KEYS):
            for used, table, c in ((1, child, col), (0, parent, pcol)):
                if table == t:
                    entries.append(F.struct(
                        F.lit(check).alias("check"), F.col(c).cast("long").alias("k"), F.lit(used).alias("used")))
        parts.append(tables[t].select(F.explode(F.array(*entries)).alias("e")).select("e.*"))
    keys = _union(parts).groupBy("check", "k").agg(
        F.sum("used").alias("rows"), F.max((F.col("used") == 0) & F.col("k").isNotNull()).alias("known"))
    counts = keys.groupBy("check").agg(F.sum(F.when(~F.col("known"), F.col("rows")).otherwise(0)).alias("n"))
    spark = next(iter(tables.values())).sparkSession
    checks = literal_table(
        spark, [(i, c, f, p) for i, (c, f, p, _) in enumerate(FOREIGN_KEYS)],
        "check int, child_table string, fk_column string, parent_table string")
    return checks.join(counts, "check", "left").select(
        "child_table", "fk_column", "parent_table", F.coalesce("n", F.lit(0)).cast("long").alias("orphan_rows"))


def flights_without_services(flights: DataFrame, lot_services: DataFrame) -> DataFrame:
    """Flights that carry no service line (left anti join)."""
    return flights.select("flight_id").join(lot_services.select("flight_id"), "flight_id", "left_anti")


def domain_violations(flights: DataFrame) -> DataFrame:
    """Q4: rows outside each closed domain, one row per column (zeros kept)."""
    aggs = [
        F.count_if(F.col(c).isNull() | ~F.col(c).isin(vals)).alias(c) for c, vals in DOMAINS.items()
    ]
    wide = flights.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in DOMAINS)
    return wide.selectExpr(f"stack({len(DOMAINS)}, {stack}) as (column_name, bad_rows)")


def null_and_length(tables: dict[str, DataFrame]) -> DataFrame:
    """Q5: per column, NULLs in NOT NULL columns and values over the declared length."""
    out = []
    for t, schema in CATALOG.items():
        df = tables[t]
        aggs, names = [], []
        for f in schema.fields:
            n_null = F.count_if(F.col(f.name).isNull()) if not f.nullable else F.lit(0).cast("long")
            lim = MAX_LENGTHS.get((t, f.name))
            n_long = (
                F.count_if(F.char_length(F.col(f.name)) > lim) if lim else F.lit(0).cast("long")
            )
            aggs += [n_null.alias(f"{f.name}__null"), n_long.alias(f"{f.name}__long")]
            names.append(f.name)
        wide = df.agg(*aggs)
        stack = ", ".join(f"'{n}', `{n}__null`, `{n}__long`" for n in names)
        out.append(
            wide.selectExpr(f"stack({len(names)}, {stack}) as (column_name, null_rows, too_long_rows)").select(
                F.lit(t).alias("table_name"), "column_name", "null_rows", "too_long_rows"
            )
        )
    return _union(out)


def calendar_mismatch(flights: DataFrame) -> DataFrame:
    """Q6: stored daypart / weekday / season / route type that break the rules."""
    d = F.to_date("dep_ts")
    rules = {
        "daypart": cal.daypart("dep_ts"),
        "weekday": cal.weekday_name(d),
        "season": cal.season(d),
        "route_type": cal.route_type("distance_km"),
    }
    checks = F.array(
        *[
            F.when(~F.col(c).eqNullSafe(r), F.struct(F.lit(c).alias("column_name"), F.col(c).alias("stored"), r.alias("derived")))
            for c, r in rules.items()
        ]
    )
    return flights.select("flight_id", F.explode(F.array_compact(checks)).alias("m")).select(
        "flight_id", "m.column_name", "m.stored", "m.derived"
    )
