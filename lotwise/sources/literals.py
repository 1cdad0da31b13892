"""Small literal tables (rule tables, code lists) as plans with known size.

``createDataFrame`` over a Python list becomes an RDD scan of unknown size, so
the optimizer would shuffle the other side of a join to meet it. Built as
``inline(array(struct(...)))`` over a one-row range, a literal table is a tiny
local plan whose size the optimizer sees, and it is broadcast when joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, st.fields)]) for row in rows
    ]
    if not structs:
        return spark.createDataFrame([], st)
    return spark.range(1).select(F.inline(F.array(*structs))).select(
        *[F.col(f.name).cast(f.dataType) for f in st.fields]
    )
