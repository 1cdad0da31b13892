"""Tables stored in buckets of a key, sorted by it: joins on the key need no exchange.

The fact and its flights are written once in the same number of buckets of ``flight_id``. A join on it then reads
bucket by bucket on both sides, and further joins shuffle the narrow result only. The files lie in the
shared checkpoint folder (or a folder the caller names), the table's entry in the session's catalog.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from lotwise.session import checkpoint_dir


def bucketed(df: DataFrame, key: str, buckets: int, name: str, path: str | None = None) -> DataFrame:
    """``df`` written in ``buckets`` buckets of ``key``, one sorted file each, and read back.

    A table of the same name is replaced. Rows with a null key share a bucket. Reading gives the same rows.
    """
    spark = df.sparkSession
    folder = path or f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")  # the entry only: the files of a table with a path stay
    (
        df.repartition(buckets, key)
        .write.bucketBy(buckets, key).sortBy(key).option("path", folder).format("parquet").saveAsTable(name)
    )
    return spark.table(name)
