"""Sources and sinks for the canonical tables.

* ``read_table``   - Parquet/CSV with an explicit schema (no inference)
* ``read_jdbc``    - relational source with a partitioned range read
* ``write_table``  - overwrite/append sink, optionally partitioned
* ``append_with_ids`` - surrogate keys on append (max(id) offset + dense index)
* ``register_views`` - temp views for SQL users
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.session import cut_lineage
from lotwise.sources.schemas import CATALOG


def read_table(
    spark: SparkSession, path: str, table: str, fmt: str = "parquet", **options
) -> DataFrame:
    schema = CATALOG[table]
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.options(**options).load(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    dbtable: str,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int | None = None,
    **options,
) -> DataFrame:
    """Relational source. Connection details come from the caller only.

    With a numeric ``partition_column`` the read is split into ``num_partitions``
    range queries so that executors read in parallel.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", dbtable)
    if partition_column is not None:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(lower_bound))
            .option("upperBound", str(upper_bound))
            .option("numPartitions", str(num_partitions or 8))
        )
    return reader.options(**options).load()


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: list[str] | None = None,
    fmt: str = "parquet",
) -> None:
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def append_with_ids(
    existing: DataFrame, new_rows: DataFrame, id_col: str, order_cols: list[str]
) -> DataFrame:
    """Assign dense surrogate keys to ``new_rows`` after ``max(existing.id)``.

    Rows are range-partitioned by ``order_cols`` and written to a checkpoint, so that their
    partitions are fixed; a window over the partition sizes (one row each) gives the offsets, and a
    window inside each partition the numbers.
    """
    base = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long").alias("_base"))
    ranged = cut_lineage(new_rows.repartitionByRange(*order_cols).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    starts = starts.withColumn("_one", F.lit(1)).join(base.withColumn("_one", F.lit(1)), "_one").drop("_one")
    inside = Window.partitionBy("_part").orderBy(*order_cols)
    number = (F.col("_base") + F.col("_start") + F.row_number().over(inside)).cast("long")
    return ranged.join(starts, "_part").select(number.alias(id_col), *new_rows.columns)


def sparse_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Unique, non-dense ids without any shuffle."""
    return df.withColumn(id_col, F.monotonically_increasing_id())


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def drop_view(spark: SparkSession, name: str) -> None:
    spark.catalog.dropTempView(name)


def peek(df: DataFrame, n: int = 5) -> list:
    """First rows for inspection (bounded)."""
    return df.limit(n).collect()
