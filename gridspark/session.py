"""Session settings the operators rely on."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join on pixels is split for a hot pixel even where the aggregate above it would like to keep the layout.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A sample is some 50 kB, so batches of the default 10,000 rows would take half a gigabyte.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}

#: What a task reads of an exchange at most, where there are partitions enough: some 16 MB become 300 MB in each sort of pixel rows.
TASK_MB = 16
#: Partitions an exchange begins with at least; adaptive execution puts small ones together. Up to 200 need no sort to be written.
LEAST_PARTITIONS = 200
#: Files that make up to 16 MB of an exchange: its rows are numbered and carry features, some four times the line items' files.
INPUT_MB = 4
#: What a task reads of files at most.
SPLIT_MB = 16
_ADVISORY, _INITIAL = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_SPLIT = "spark.sql.files.maxPartitionBytes"
_BOUNDS = (_ADVISORY, _INITIAL, _SPLIT)


def get_spark(app: str = "gridspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> None:
    """Apply the settings to a session made elsewhere; all of them can be changed at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def bound_tasks(spark: SparkSession, input_bytes: int = 0) -> None:
    """Keep tasks on pixel rows small however large the tables are; `free_tasks` takes it back.

    A sort, a window or an aggregate holds what its task reads, so a fixed number of partitions would let them grow with the input:
    there are as many as the bytes of the tables' files ask for.
    """
    free_tasks(spark)
    found = {key: spark.conf.get(key, None) for key in _BOUNDS}
    for key, value in found.items():
        spark.conf.set(f"gridspark.found.{key}", value or "")
    spark.conf.set(_ADVISORY, min(_bytes(spark, found[_ADVISORY] or "64m"), TASK_MB << 20))
    spark.conf.set(_SPLIT, min(_bytes(spark, found[_SPLIT] or "128m"), SPLIT_MB << 20))
    partitions = int(found[_INITIAL] or spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(_INITIAL, max(partitions, LEAST_PARTITIONS, -(-input_bytes // (INPUT_MB << 20))))


def free_tasks(spark: SparkSession) -> None:
    """Give back the settings that `bound_tasks` found."""
    for key in _BOUNDS:
        found = spark.conf.get(f"gridspark.found.{key}", None)
        if found is None:
            continue
        spark.conf.unset(f"gridspark.found.{key}")
        if found:
            spark.conf.set(key, found)
        else:
            spark.conf.unset(key)


def _bytes(spark: SparkSession, size: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(size))


def cut_lineage(df: DataFrame, fallback_dir: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write `df` as a Parquet table to the shared folder, so that lost executors do not recompute it.

    Columnar, so each reader takes the columns it needs. The folder the cluster names in `spark.checkpoint.dir` is used;
    `fallback_dir` only counts where that is unset and no folder has been set on the context.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or fallback_dir
    if folder is None:
        raise ValueError("set spark.checkpoint.dir or pass fallback_dir")
    path = f"{folder.rstrip('/')}/gridspark/cut-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
