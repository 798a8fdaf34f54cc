"""Tables that appear one version at a time, data and parameters together.

Both are written to a folder of their own, and only then one small file, written whole or not at all, says that this version
counts. A reader takes the newest version that counts and never sees a half-written one. A version that was not published does
no harm; a later write has another folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NotPublished(FileNotFoundError):
    """There is no published version."""


def folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Published versions, oldest first, as numbers and folder names."""
    place, fs = folder(spark, f"{path}/published")
    if not fs.exists(place):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names if n.split("-", 1)[0].isdigit())


def stage(df: DataFrame, path: str, params: Mapping | None = None, partition_by: Sequence[str] = ()) -> str:
    """Write data and parameters to a folder that no reader looks at yet, and return its name."""
    version = uuid.uuid4().hex
    df.write.partitionBy(*partition_by).parquet(f"{path}/versions/{version}/data")
    row = json.dumps(params or {}, sort_keys=True)
    df.sparkSession.range(1).select(F.lit(row).alias("params")).write.json(f"{path}/versions/{version}/params")
    return version


def publish(spark: SparkSession, path: str, version: str) -> int:
    """Make a staged version the one that readers take. Two writers at once get different numbers or one of them an error."""
    number = max((n for n, _ in versions(spark, path)), default=0) + 1
    place, fs = folder(spark, f"{path}/published/{number:012d}-{version}")
    fs.create(place, False).close()
    return number


def write_published(df: DataFrame, path: str, params: Mapping | None = None, partition_by: Sequence[str] = (), keep: int = 2) -> int:
    """Stage and publish; of older versions the newest `keep - 1` stay, for readers at work on them."""
    spark = df.sparkSession
    number = publish(spark, path, stage(df, path, params, partition_by))
    for _, old in versions(spark, path)[:-keep]:
        for name in (f"{path}/published/{_:012d}-{old}", f"{path}/versions/{old}"):
            place, fs = folder(spark, name)
            fs.delete(place, True)
    return number


def _newest(spark: SparkSession, path: str) -> str:
    found = versions(spark, path)
    if not found:
        raise NotPublished(path)
    return f"{path}/versions/{found[-1][1]}"


def read_published(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The newest published version: its data and the parameters that made it."""
    place = _newest(spark, path)
    return spark.read.parquet(f"{place}/data"), json.loads(spark.read.json(f"{place}/params").first()["params"])
