"""Exports of period frames and reading of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import PIXEL
from ..functions.expressions import minmax_scale
from ..session import cut_lineage


def period_table(frames: DataFrame, pairs: Sequence[tuple[str, str]], pixels: DataFrame | None = None,
                 time_reduce: str = "mean", fmt: str = "yyyyMMdd-HH", keys: Sequence[str] = PIXEL) -> DataFrame:
    """Wide table of period values: the mean over the chosen pixels of each (feature, metric) pair.

    The time label is the middle, first or last step of the period.
    """
    rows = frames if pixels is None else frames.join(pixels.select(*keys), list(keys), "left_semi")
    feats = sorted({f for f, _ in pairs})
    picks = [F.avg(F.when(F.col("feat") == f, F.col(m))).alias(f"{f}_{m}") for f, m in pairs]
    seconds = {
        "mean": (F.unix_timestamp(F.min("t_start")) + F.unix_timestamp(F.max("t_end"))) / 2,
        "start": F.unix_timestamp(F.min("t_start")).cast("double"),
        "end": F.unix_timestamp(F.max("t_end")).cast("double"),
    }[time_reduce]
    label = F.date_format(F.timestamp_seconds(seconds), fmt).alias(f"time_{time_reduce}")
    return rows.where(F.col("feat").isin(*feats)).groupBy("period").agg(label, *picks)


def export_period_csv(frames: DataFrame, path: str, pairs: Sequence[tuple[str, str]], pixels: DataFrame | None = None,
                      time_reduce: str = "mean", fmt: str = "yyyyMMdd-HH", header: bool = True) -> None:
    """Write the period table in time order as CSV; a sorted set of files whose names follow the order."""
    table = period_table(frames, pairs, pixels, time_reduce, fmt).orderBy("period").drop("period")
    table.write.mode("errorifexists").csv(path, header=header)


def raster_rows(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Dense grid rows for each group: one array over x per y, null where there is no pixel.

    The box spans all pixels. A grid row is gathered as a map of its pixels, so nothing larger than one row
    of the grid meets in one place. The rows are written once to the shared folder, from where the box, the groups and the
    cells are read; `df` is read once.
    """
    rows = cut_lineage(df.groupBy(*by, "y").agg(
        F.map_from_entries(F.collect_list(F.struct("x", value))).alias("_m"), F.min("x").alias("_lo"), F.max("x").alias("_hi")))
    box = rows.agg(F.struct(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("_lo").alias("x0"), F.max("_hi").alias("x1")).alias("box"))
    frame = rows.select(*by).distinct().withColumn("_box", box.scalar()).select(
        *by, F.sequence("_box.x0", "_box.x1").alias("_x"), F.explode(F.sequence("_box.y0", "_box.y1")).alias("y"))
    cells = F.transform("_x", lambda x: F.try_element_at(F.col("_m"), x))
    return frame.join(rows, [*by, "y"], "left").select(*by, "y", cells.alias("cells"))


def scale_frames(frames: DataFrame, bounds: DataFrame, metric: str, null_fill: float = 0.0) -> DataFrame:
    """Scale a metric to [0, 1] by the bounds of its feature (bounds: feat, metric, lo, hi; one row per feature)."""
    b = bounds.where(F.col("metric") == metric).select("feat", "lo", "hi")
    return frames.join(F.broadcast(b), "feat", "left").withColumn(
        "scaled", minmax_scale(metric, "lo", "hi", null_fill)).drop("lo", "hi")


HISTORY = T.StructType([
    T.StructField("epoch", T.IntegerType()), T.StructField("loss", T.DoubleType()),
    T.StructField("residual_loss", T.DoubleType()), T.StructField("val_loss", T.DoubleType()),
    T.StructField("val_residual_loss", T.DoubleType()),
])


def read_training_history(spark: SparkSession, path: str, schema: T.StructType = HISTORY) -> DataFrame:
    """Training curves of all models, `NA` as null; the model is named by its partition or by its file."""
    df = spark.read.option("recursiveFileLookup", "false").csv(path, header=True, schema=schema, nullValue="NA")
    if "model" in df.columns:
        return df
    return df.withColumn("model", F.regexp_extract(F.input_file_name(), r"([^/]+)_prog\.csv", 1))


def read_configs(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Model configurations, one JSON document per file."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def select_results(results: DataFrame, source: str | None = None, models: Sequence[str] | None = None,
                   feats: Sequence[str] | None = None, eval_type: str | None = None, err_type: str | None = None
                   ) -> DataFrame:
    """Complete evaluator results by their partition fields; partial ones are left out."""
    wanted = {"source": source and [source], "model": models, "feat": feats,
              "eval_type": eval_type and [eval_type], "err_type": err_type and [err_type]}
    out = results
    for name, values in wanted.items():
        if values:
            out = out.where(F.col(name).isin(*values))
    return out.where(~F.col("partial")) if "partial" in results.columns else out
