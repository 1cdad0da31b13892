"""Two scans over the queues of many keys, each associative and in two levels.

``max_plus_scan`` walks supply and demand in one order and keeps three numbers: the need so far, the stock
so far and the largest lead of stock over need. Two stretches merge as

    (n, x, m) + (n', x', m') = (n + n', x + x', max(m, x - n + m'))

so a key can be cut into chunks: a window inside each (key, chunk), the merged states of the chunks before
it by a window over one row per chunk, and a join that brings the two together. The rows are shuffled once, by
(key, chunk); a hot key is as many tasks as it has chunks.

``overlay`` lays two kinds of adjoining intervals on each other. Both are cut only where one of either kind
begins or ends, so the work follows the number of intervals, not their lengths: between two points
next to each other one interval of each kind is current, the last that began. "The last of each kind" is
associative too and is carried from chunk to chunk in the same way. Chunks are cut at quantiles of the positions
(``bounds`` of the first scan, taken from the chunk states), so they hold about the same number of
points whatever the lengths are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key for one more cut of its positions, and most cuts of a key.
CUT_ROWS = 4096
MOST_CUTS = 128


def _ahead(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))


def max_plus_scan(
    df: DataFrame, by: list[str], order: list[str], chunk: Column, need: str, stock: str, carried: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``need_before``, ``stock_before``, ``lead`` (largest stock - need up to this row), ``stock_all``, ``bounds``.

    ``chunk`` must not decrease along ``order``. ``bounds`` are ascending positions that cut the key's queue
    into parts of about ``CUT_ROWS`` rows (NULL for a small key). Name columns that are only passed on in
    ``carried``: the states then read the same columns as the rows do, and both share one exchange.
    """
    local = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        df.withColumn("_chunk", chunk)
        .withColumn("_n", F.sum(need).over(local) - F.col(need))
        .withColumn("_x", F.sum(stock).over(local) - F.col(stock))
    )
    rows = rows.withColumn("_m", F.max(F.col("_x") - F.col("_n")).over(local))
    states = rows.groupBy(*by, "_chunk").agg(
        F.sum(need).alias("n"), F.sum(stock).alias("x"), F.max(F.col("_x") - F.col("_n")).alias("m"),
        F.greatest(F.count(F.lit(1)), *[F.count(c) for c in carried]).alias("c") if carried else F.count(F.lit(1)).alias("c"))
    ahead = _ahead(by, "_chunk")
    merged = states.select(
        *by, "_chunk", "m", _zero(F.sum("n").over(ahead)).alias("_n0"), _zero(F.sum("x").over(ahead)).alias("_x0"),
        F.sum("x").over(Window.partitionBy(*by)).alias("stock_all"), F.sum("c").over(Window.partitionBy(*by)).alias("c"))
    merged = merged.withColumn("_m0", F.max(F.col("_x0") - F.col("_n0") + F.col("m")).over(ahead))
    # where a chunk begins in the queue: behind all stock before it (lots) or all need before it (lines)
    begin = F.greatest(F.col("_x0"), F.least(F.col("_n0") + F.greatest(F.lit(0), F.coalesce("_m0", F.lit(0))), F.col("stock_all")))
    shares = [i / MOST_CUTS for i in range(1, MOST_CUTS)]
    cuts = merged.groupBy(*by).agg(F.percentile_approx(F.when(F.col("c") > CUT_ROWS, begin), shares, 10 * MOST_CUTS).alias("p"))
    every = F.ceil(F.lit(MOST_CUTS * CUT_ROWS) / F.col("c"))
    bounds = F.array_distinct(F.filter("p", lambda _, i: (i + 1) % every == 0))
    offsets = merged.join(cuts, by).withColumn("bounds", bounds)
    joined = rows.join(offsets.select(*by, "_chunk", "_n0", "_x0", "_m0", "stock_all", "bounds"), [*by, "_chunk"])
    return (
        joined.withColumn("need_before", F.col("_n0") + F.col("_n"))
        .withColumn("stock_before", F.col("_x0") + F.col("_x"))
        .withColumn("lead", F.greatest(F.col("_m0"), F.col("_x0") - F.col("_n0") + F.col("_m")))
        .drop("_chunk", "_n", "_x", "_m", "_n0", "_x0", "_m0")
    )


def cut_of(position: Column, bounds: Column) -> Column:
    """Which part of the queue a position lies in."""
    return F.coalesce(F.size(F.filter(bounds, lambda b: b <= position)), F.lit(0))


def overlay(points: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """Stretches of each key covered by an interval of both kinds: ``by``, ``left``, ``right``, ``length``.

    A point has ``pos``, ``rank`` and ``id`` (its order), ``cut`` (its part, not decreasing along the order) and a
    ``left`` or a ``right`` struct, the other one NULL. A struct whose first field is NULL ends its kind's interval.
    """
    order = ["pos", "rank", "id"]
    local = Window.partitionBy(*by, "cut").orderBy(*order)
    so_far = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = points.select(
        *by, "cut", *order, F.lead("pos").over(local).alias("_next"),
        F.last(left, ignorenulls=True).over(so_far).alias("_l"), F.last(right, ignorenulls=True).over(so_far).alias("_r"))
    # the last row of a part knows its last intervals; reading ``_next`` too keeps one exchange for both uses
    states = rows.groupBy(*by, "cut").agg(
        F.min("pos").alias("first"), F.max(F.struct(*order, "_l", "_r", "_next")).alias("end"))
    ahead = _ahead(by, "cut")
    carried = states.select(
        *by, "cut", F.lead("first").over(Window.partitionBy(*by).orderBy("cut")).alias("_then"),
        F.last("end._l", ignorenulls=True).over(ahead).alias("_l0"), F.last("end._r", ignorenulls=True).over(ahead).alias("_r0"))
    whole = rows.join(carried, [*by, "cut"]).select(
        *by, F.coalesce("_l", "_l0").alias(left), F.coalesce("_r", "_r0").alias(right),
        (F.coalesce("_next", "_then") - F.col("pos")).cast("long").alias("length"))
    first = [points.schema[c].dataType.names[0] for c in (left, right)]
    return whole.where((F.col("length") > 0) & F.col(left)[first[0]].isNotNull() & F.col(right)[first[1]].isNotNull())
