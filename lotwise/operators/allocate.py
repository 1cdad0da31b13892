"""Load manifests: demand -> 5 % buffer -> loadable lots -> FEFO -> shortfall.

FEFO (first-expired-first-out) is a running sum, not a loop: for each product
walk its loadable lots by (expiry_date, lot_id); the stock before a lot is the
running sum of earlier lots, and

    taken = greatest(0, least(current_qty, need - stock_before))

which equals the greedy take-until-covered walk. The running sum is the
two-level chunked form of ``lotwise.operators.windows`` (chunk = expiry date and
position among the date's lot ids),
so a product with a very large number of lots is still spread over tasks.
Only lots of products that are on the manifest enter the window (semi join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators.inventory import loadable_inventory
from lotwise.operators.windows import range_chunks, running_sum

BUFFER_FRACTION = 0.05


def open_demand(lot_services: DataFrame, lots: DataFrame, products: DataFrame) -> DataFrame:
    """Planned loads whose consumption is not recorded yet, per product.

    This is the demand side used by the registered manifest queries: the quantity
    the open flights are planned to carry, summed per product.
    """
    per_lot = (
        lot_services.where(F.col("consumed_qty").isNull())
        .groupBy("lot_id")
        .agg(F.sum("loaded_qty").alias("q"))
    )
    return (
        per_lot.join(lots.select("lot_id", "product_id"), "lot_id")
        .join(products.select("product_id", F.col("name").alias("product_name")), "product_id")
        .groupBy("product_id", "product_name")
        .agg(F.sum("q").cast("long").alias("base_qty"))
    )


def manifest_lines(demand: DataFrame, base: str = "base_qty", ordered: bool = True) -> DataFrame:
    """B5 + F11 + O2: buffer = ceil(5 % of base), final = base + buffer."""
    buf = F.ceil(F.col(base).cast("double") * F.lit(BUFFER_FRACTION)).cast("long")
    out = demand.withColumn("buffer_qty", buf).withColumn(
        "final_qty", F.col(base).cast("long") + F.col("buffer_qty")
    )
    if ordered:
        out = out.orderBy(F.desc("final_qty"), "product_id")
    return out


def relevant_inventory(inventory: DataFrame, lines: DataFrame, key: str = "product_id") -> DataFrame:
    """Loadable lots of products that are on the manifest (left semi join)."""
    return loadable_inventory(inventory).join(lines.select(key).hint("merge"), key, "left_semi")


def fefo_allocate(
    lines: DataFrame, inventory: DataFrame, need: str = "final_qty", key: str = "product_id"
) -> DataFrame:
    """Lots taken per product line, first expired first (ties by lot id)."""
    lots = relevant_inventory(inventory, lines, key).select(
        key, "lot_id", "lot_number", "expiry_date", "status", "current_qty"
    )
    walked = running_sum(
        range_chunks(lots, [key], "expiry_date", "lot_id"),
        by=[key],
        order=["expiry_date", "lot_id"],
        value="current_qty",
        out="stock_before",
        # monotone in (expiry_date, lot_id); splits a day with very many lots too
        chunk=F.struct("expiry_date", "_bucket"),
        inclusive=False,
    )
    taken = F.greatest(
        F.lit(0).cast("long"),
        F.least(F.col("current_qty"), F.col(need) - F.col("stock_before")),
    )
    return (
        walked.join(lines.select(key, need).hint("merge"), key, "inner")
        .withColumn("taken_qty", taken)
        .where(F.col("taken_qty") > 0)
        .select(key, "lot_id", "lot_number", "expiry_date", "status", "taken_qty")
    )


def shortfall(
    lines: DataFrame, inventory: DataFrame, need: str = "final_qty", key: str = "product_id"
) -> DataFrame:
    """Need that loadable stock cannot cover; products without lots miss all of it."""
    avail = (
        relevant_inventory(inventory, lines, key)
        .groupBy(key)
        .agg(F.sum("current_qty").cast("long").alias("available_qty"))
    )
    short = F.greatest(
        F.lit(0).cast("long"), F.col(need) - F.coalesce(F.col("available_qty"), F.lit(0).cast("long"))
    )
    return (
        lines.select(key, need)
        .join(avail, key, "left")
        .select(
            key,
            F.col(need).alias("need_qty"),
            F.coalesce(F.col("available_qty"), F.lit(0).cast("long")).alias("available_qty"),
            short.alias("shortfall_qty"),
        )
        .where(F.col("shortfall_qty") > 0)
    )


def lines_with_assignments(lines: DataFrame, assignments: DataFrame, key: str = "product_id") -> DataFrame:
    """J9 (flat): every manifest line with its lots; a line without lots keeps one
    row with NULL lot columns."""
    return lines.join(assignments.hint("merge"), key, "left")


def nest_assignments(flat: DataFrame, key: str = "product_id") -> DataFrame:
    """J9 (nested, display form): one row per line with an array of its lots.

    The array holds the lots one line takes, so its size is bounded by the
    line's quantity over the smallest lot; use the flat form for bulk output.
    """
    cols = [c for c in flat.columns if c not in ("lot_id", "lot_number", "expiry_date", "status", "taken_qty")]
    lot = F.struct("expiry_date", "lot_id", "lot_number", "status", "taken_qty")
    return flat.groupBy(*cols).agg(
        F.array_sort(F.filter(F.collect_list(lot), lambda s: s["lot_id"].isNotNull())).alias("lots")
    )
