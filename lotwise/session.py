"""SparkSession construction and cluster-safe lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "lotwise",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session tuned for the operators in this package.

    On a cluster, pass ``master=None`` and let spark-submit decide; the settings
    below only fill in what the deployment did not set.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # one BLAS thread per Python worker: the workers already fill the cores
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
        "spark.executorEnv.MKL_NUM_THREADS": "1",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def scale_conf(input_bytes: int, cores: int) -> dict[str, str]:
    """Shuffle and split sizes for a given input volume and cluster size.

    Initial shuffle partitions aim at ~256 MB of input per partition (at least
    2 x cores), AQE then coalesces small ones to 128 MB and splits skewed ones
    (> 5 x median and > 512 MB). File splits are 256 MB. Pass the result as
    ``extra`` to ``get_session`` (or to spark-submit --conf).
    """
    parts = max(2 * cores, input_bytes // (256 << 20))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, taken from the session.

    ``spark.checkpoint.dir`` names the shared folder on a cluster. Only a local
    master (tests) may fall back to a private scratch folder; on a cluster an
    unset folder is an error, because a machine-local folder would not survive
    the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: name a shared folder (HDFS/S3/...) for checkpoints"
            )
        configured = tempfile.mkdtemp(prefix="lotwise-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never ``localCheckpoint``): survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back by schema.

    Cuts the lineage like ``cut_lineage``, but columnar: later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
