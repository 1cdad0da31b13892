"""Running sums and ranks per key that stay parallel when one key is hot.

A plain ``sum(x) OVER (PARTITION BY key ORDER BY o)`` sorts each key inside a
single task; if one key holds a third of all rows, that task holds a third of
the data. Here every key is cut into *chunks* by a column that is monotone in
the order (for example the expiry date, or a hash prefix), and the sum is done
in two levels:

1. ``GROUP BY key, chunk`` totals (partial aggregation, tiny output);
2. a window over the chunk totals of each key gives each chunk's offset;
3. a window over ``(key, chunk)`` gives the running sum inside the chunk.

Result = offset + local running sum. Both windows are partitioned by
``(key, chunk)`` or run over chunk totals, so no task sees a whole hot key.
The order must be total (add an id tie-breaker) for a deterministic result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def running_sum(
    df: DataFrame,
    by: list[str],
    order: list,
    value: str | Column,
    out: str,
    chunk: Column,
    inclusive: bool = True,
    total: str | None = None,
) -> DataFrame:
    """Add ``out`` = sum of ``value`` over rows of the same ``by`` key that come
    before (``inclusive=False``) or up to and including this row in ``order``.

    ``chunk`` must be non-decreasing along ``order`` within a key. With
    ``total``, the key's grand total is added too; it is computed on the chunk
    totals and arrives with the offsets, so no extra join on the (possibly
    hot) key is needed.
    """
    v = F.col(value) if isinstance(value, str) else value
    d = df.withColumn("_chunk", chunk).withColumn("_v", v)
    totals = d.groupBy(*by, "_chunk").agg(F.sum("_v").alias("_ct"))
    w_chunks = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    extra = []
    if total:
        extra.append(F.sum("_ct").over(Window.partitionBy(*by)).alias(total))
    offsets = totals.select(
        *by, "_chunk", F.coalesce(F.sum("_ct").over(w_chunks), F.lit(0)).alias("_off"), *extra
    )
    end = Window.currentRow if inclusive else -1
    w_local = Window.partitionBy(*by, "_chunk").orderBy(*_cols(order)).rowsBetween(
        Window.unboundedPreceding, end
    )
    local = F.coalesce(F.sum("_v").over(w_local), F.lit(0))
    return (
        d.join(offsets, [*by, "_chunk"], "inner")
        .withColumn(out, F.col("_off") + local)
        .drop("_chunk", "_v", "_off")
    )


CHUNK_ROWS = 512


def range_chunks(df: DataFrame, by: list[str], lead: str, id_col: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``_bucket``: with (``lead``, ``_bucket``) as chunk, a key has about n / ``rows`` chunks.

    Rows of one (key, lead) are cut by position between their smallest and largest id, so the
    number of chunks follows the number of rows however the ids are spread.
    """
    group = [*by, lead]
    spans = df.groupBy(*group).agg(F.min(id_col).alias("_lo"), F.max(id_col).alias("_hi"), F.count(F.lit(1)).alias("_rows"))
    spans = spans.select(*group, "_lo", (F.col("_hi") - F.col("_lo") + 1).cast("double").alias("_span"), F.ceil(F.col("_rows") / rows).alias("_buckets"))
    bucket = F.floor((F.col(id_col) - F.col("_lo")) / F.col("_span") * F.col("_buckets"))
    return df.join(spans, group).withColumn("_bucket", bucket).drop("_lo", "_span", "_buckets")
