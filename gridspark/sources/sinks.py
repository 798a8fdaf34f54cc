"""Partitioned tables for samples, predictions, statistics and errors, each with its generating parameters."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder the cluster names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        raise ValueError("spark.checkpoint.dir is not set")
    return f"{base.rstrip('/')}/gridspark/{name}-{uuid.uuid4().hex}"


def _to_float(df: DataFrame) -> DataFrame:
    """Doubles are stored as floats."""
    return df.select(*[
        F.col(f.name).cast("float").alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
        for f in df.schema])


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), params: Mapping | None = None,
                sort_by: Sequence[str] = (), mode: str = "errorifexists", floats: bool = False) -> None:
    """Write a partitioned Parquet table and, next to it, one row with the parameters that made it.

    Sorted tables are dealt by ranges of the partition and sort columns, so a large partition is written by many tasks, each
    with a range of its own; others are brought together by partition value and split where a partition is large.
    """
    out = _to_float(df) if floats else df
    if sort_by:
        order = [*partition_by, *sort_by]
        out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    elif partition_by:
        out = out.hint("rebalance", *partition_by)
    out.write.mode(mode).partitionBy(*partition_by).parquet(f"{path}/data")
    row = json.dumps(params or {}, sort_keys=True)
    df.sparkSession.range(1).select(F.lit(row).alias("params")).write.mode(mode).json(f"{path}/params")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def read_params(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.json(f"{path}/params").head()["params"])


def write_dynamic(df: DataFrame, path: str, params: Mapping | None = None, **kw) -> None:
    """Pixel-hour table by tile, year and quarter, sorted so that row groups can be skipped by place and time."""
    write_table(df, path, ("tile", "year", "quarter"), params, ("y", "x", "t"), **kw)


def write_samples(df: DataFrame, path: str, params: Mapping | None = None, partition_by: Sequence[str] = (), **kw
                  ) -> None:
    write_table(df, path, partition_by, params, **kw)


def write_predictions(df: DataFrame, path: str, params: Mapping | None = None, partition_by: Sequence[str] = (),
                      **kw) -> None:
    write_table(df, path, partition_by, params, **kw)


def write_gridstats(df: DataFrame, path: str, params: Mapping | None = None, **kw) -> None:
    write_table(df, path, ("feat", "month"), params, ("y", "x"), **kw)


def write_grid_errors(df: DataFrame, path: str, params: Mapping | None = None, **kw) -> None:
    write_table(df, path, ("feat",), params, ("init", "y", "x"), **kw)


def write_results(df: DataFrame, path: str, params: Mapping | None = None, **kw) -> None:
    """Evaluator results by source, model, feature, evaluation and error type."""
    write_table(df, path, ("source", "model", "feat", "eval_type", "err_type"), params, **kw)
