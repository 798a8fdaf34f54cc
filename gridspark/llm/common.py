"""What several text operators share: tables in the cluster's shared folder and row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting by which an execution's shuffle files go at its end.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, else the one set on the context.

    Only where neither is set, as in tests on one machine, is a temporary folder made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        named = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, columnar, safe from lost executors.

    The shuffle files of the write go as soon as the table is there. Otherwise they stay until the driver happens to collect garbage,
    so that steps written one after the other may hold all their shuffles at once.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    found = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if found is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, found)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. Pure ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, also where `use` reads it for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def held_out(modulus: int, remainder: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the given remainder. A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows and bytes: texts are long, so the default of 10,000 rows could take gigabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
