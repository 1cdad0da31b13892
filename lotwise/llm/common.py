"""Helpers shared by the operators: staged tables, table reads, word pattern."""

from __future__ import annotations

import sys
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lotwise.session import checkpoint_dir, cut_lineage

# Functions that run in Python workers are pickled by value, so workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["WORD", "table", "staged", "cut_lineage", "shuffle_partitions", "crc_mod", "map_text"]

#: A word: a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` does, but columnar and compressed; every attempt has
    a folder of its own, so a repeated driver run never reads another run's files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id, n: int):
    """crc32 of the id's decimal text, modulo ``n`` (the split rule of labelled rows)."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % n


def map_text(df: DataFrame, text: str, made: str, worker) -> DataFrame:
    """``df`` with its ``text`` column replaced by the columns ``made`` (a DDL string).

    ``worker()`` is called once per task and returns a function from a list of texts (None for null)
    to one sequence per made column. The other columns pass through as Arrow arrays, nulls and all.
    """
    kept = [c for c in df.columns if c != text]
    fields = T.StructType([df.schema[c] for c in kept] + T.StructType.fromDDL(made).fields)
    arrow = to_arrow_schema(fields)

    def run(batches):
        work = worker()
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = work(batch.column(text).to_pylist())
            new = [pa.array(c, type=f.type) for c, f in zip(columns, list(arrow)[len(kept):])]
            old = [batch.column(c).cast(f.type) for c, f in zip(kept, arrow)]
            yield pa.RecordBatch.from_arrays(old + new, schema=arrow)

    return df.select(*kept, text).mapInArrow(run, fields)
