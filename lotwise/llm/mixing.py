"""Operator 7: mix sources to target weights by systematic sampling (native DataFrame code).

Every document has an expected number of copies, its source's target over its source's size. In a
fixed order within the source (size class, then a digest of the whole row) the expected copies are prefix
summed, one offset per source is added, and a document is emitted once per integer boundary that its
interval crosses. Ordering by size class spreads the draws over short and long documents alike, so
the words taken come near the target.

The prefix sum has two levels: totals per (source, chunk), a window over the chunk totals, and a
window inside each chunk. A chunk is a power-of-two size class and the first hex digits of the
digest, as many as the number of rows asks for, so a source that holds a third of all rows is spread over
many tasks. Sums are exact integers (10^-9 copies) and rows that differ in any column have an order of their
own, so reruns and retries agree, also on rows without id; rows equal in every column are interchangeable.
Words are counted in one pass over narrow rows, which are written once (and once more for the
rows themselves when they are mixed).

Null texts and texts without words have size 0; a null source is a source of its own, the last one.
Repeated rows are drawn separately. A source without words has target 0 and is not emitted. An
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import WORD, staged

#: Source weights by code-point rank, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix per 100 words of the input, and most copies of a source.
SHARE_PERCENT = 150
MAX_COPIES = 2
UNIT = 1_000_000_000
SEED = "mix"
#: Rows of a chunk, about.
CHUNK_ROWS = 100_000


def source_targets(sized: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT) -> DataFrame:
    """One row per source: its size and target in words.

    Water filling in closed form: in the order of size over weight the capped sources come first,
    and the level of the others is what is left over their weights. ``sized`` has source and size.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("w", w.cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * (share_percent / 100.0))
        .withColumn("cap", (F.col("source_size") * MAX_COPIES).cast("double"))
        .withColumn("left_", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(onward))
        .withColumn("level", F.when(F.col("cap") * F.col("w_left") > F.col("w") * F.col("left_"), F.col("left_") / F.col("w_left")))
    )
    level = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.withColumn("lv", level).select(
        "source",
        "source_size",
        F.when(F.col("lv").isNull() | (F.col("cap") <= F.col("lv") * F.col("w")), F.col("cap"))
        .otherwise(F.col("lv") * F.col("w"))
        .alias("target"),
    )


def row_digest(docs: DataFrame):
    """md5 of all columns in the table's order, nulls apart from empty text."""
    return F.md5(F.encode(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in docs.columns]), "UTF-8"))


def chunk_digits(rows: int) -> int:
    """Hex digits of a chunk: about ``CHUNK_ROWS`` rows of a size class of one source that has them all."""
    return max(2, math.ceil(math.log(max(rows, 1) / CHUNK_ROWS, 16)))


def draw(
    docs: DataFrame, columns: list[str] | None = None, seed: str = SEED, weights=WEIGHTS, share_percent: int = SHARE_PERCENT
) -> DataFrame:
    """Every document with its draw: ``row`` (its ``columns``), size, source_size, target, copies."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row"),
        F.col("source").alias("source"),
        size.alias("size"),
        row_digest(docs).alias("h"),
    )
    if columns:
        base = sized = staged(base, "mix_rows")
    else:
        sized = staged(base.select("source", "size", "h"), "mix_sizes")
    digits = chunk_digits(sized.count())
    targets = source_targets(sized, weights, share_percent)
    # one row per source, a fixed small table for the join below
    rate = targets.select(
        F.col("source").alias("t_source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT))
        .otherwise(F.lit(0)).cast("decimal(20,0)").alias("e"),
        (F.conv(F.substring(F.md5(F.encode(F.concat(F.lit(seed + "|"), F.coalesce(F.col("source"), F.lit(""))), "UTF-8")), 1, 8), 16, 10).cast("long") % UNIT)
        .cast("decimal(20,0)").alias("u"),
    )
    chunk = F.concat(F.lpad(F.length(F.bin("size")).cast("string"), 2, "0"), F.substring("h", 1, digits))
    base = base.withColumn("chunk", chunk)
    counts = sized.withColumn("chunk", chunk).groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("source").alias("c_source"),
        F.col("chunk").alias("c_chunk"),
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"),
    )
    starts = starts.join(rate, F.col("c_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    inside = Window.partitionBy("source", "chunk").orderBy("h", "size")
    k = (F.col("start") + F.row_number().over(inside)).cast("decimal(20,0)")
    joined = base.join(starts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("chunk") == F.col("c_chunk")))
    return joined.withColumn("k", k).select(
        "row", "size", "source_size", "target",
        F.expr(f"((k * e + u) div {UNIT}) - (((k - 1) * e + u) div {UNIT})").alias("copies"),
    )


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mixed corpus: the documents' own columns, each row as often as it was drawn."""
    d = draw(docs, **kw).where("copies > 0")
    return d.select("row", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).select("row.*")


def report(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document."""
    d = draw(docs, columns=["doc_id"], **kw)
    return d.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
    )


def _sql(docs: str) -> str:
    return f"""
mix_base AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), '\\N'), coalesce(text, '\\N'), coalesce(lang, '\\N'),
             coalesce(source, '\\N'), coalesce(CAST(n_chars AS VARCHAR), '\\N'))) AS h, lang, n_chars
  FROM {docs}),
mix_totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM mix_base GROUP BY source),
mix_ranked AS (
  SELECT *, CAST([3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS w FROM mix_totals),
mix_filled AS (
  SELECT *, CAST(source_size * 2 AS DOUBLE) AS cap,
    CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
      - coalesce(sum(CAST(source_size * 2 AS DOUBLE)) OVER (ORDER BY source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS left_,
    sum(w) OVER (ORDER BY source_size / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM mix_ranked),
mix_level AS (
  SELECT max(CASE WHEN cap * w_left > w * left_ THEN left_ / w_left END) AS lv FROM mix_filled),
mix_targets AS (
  SELECT source, source_size, CASE WHEN lv IS NULL OR cap <= lv * w THEN cap ELSE lv * w END AS target
  FROM mix_filled, mix_level),
mix_rate AS (
  SELECT source, source_size, target,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 1000000000) AS HUGEINT) ELSE 0::HUGEINT END AS e,
    CAST(('0x' || substr(md5('mix|' || coalesce(source, '')), 1, 8))::BIGINT % 1000000000 AS HUGEINT) AS u
  FROM mix_targets),
mix_drawn AS (
  SELECT b.*, r.source_size, r.target, r.e, r.u,
    CAST(row_number() OVER (PARTITION BY b.source ORDER BY length(bin(b.size)), b.h, b.size) AS HUGEINT) AS k
  FROM mix_base b JOIN mix_rate r ON b.source IS NOT DISTINCT FROM r.source),
mix_out AS (
  SELECT *, CAST(((k * e + u) // 1000000000) - (((k - 1) * e + u) // 1000000000) AS BIGINT) AS copies FROM mix_drawn)"""


SQL = f"""WITH {_sql('documents')}
SELECT doc_id, size, source_size, target, size * copies AS taken FROM mix_out"""
