"""Streams of the fixture tables: files in time order, read one a trigger."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import verification as V
from ..session import cut_lineage
from ..sources import published
from ..sources.sinks import scratch_dir
from ..streaming import frames as SF
from ..streaming import partials as SP
from ..streaming import truth_join as TJ
from .registry import DYNAMIC, ERRORS, query, r6, settled, with_views
from .statistics import _PERIOD, long_sql

#: Ranges of time at least, rows of a range and rows of a file of it at most, about.
PARTS, PART_ROWS, FILE_ROWS = 4, 4_000_000, 500_000


def arriving(rows: DataFrame, by: str, name: str, parts: int = PARTS) -> DataFrame:
    """A stored table as a stream: written by ranges of time, `parts` or more, and read a range a trigger.

    A range has as many files as its rows need, the same number in all, so that many tasks write and read it. All are written
    in one pass; a stream reads files in the order of their times, so these are set to follow the ranges.
    """
    spark, path = rows.sparkSession, scratch_dir(rows.sparkSession, name)
    n = rows.count()
    parts = max(parts, -(-n // PART_ROWS))
    files = -(-n // (parts * FILE_ROWS)) or 1
    # Rows of one time are dealt by their hash, or few times would give few files, and a trigger as many ranges as it has files.
    rows.repartitionByRange(parts * files, F.col(by), F.xxhash64(*rows.columns)).write.parquet(path)
    if not in_order(spark, path):
        # This file system keeps no times that are set: the ranges are written again, one after the other.
        names, path = [str(f.getPath()) for f in data_files(spark, path)], scratch_dir(spark, name)
        for i in range(0, len(names), files):
            part = spark.read.schema(rows.schema).parquet(*names[i:i + files])
            part.repartition(len(names[i:i + files])).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def data_files(spark: SparkSession, path: str) -> list:
    """The files of a table that was written by ranges, in the order of the ranges."""
    place, fs = published.folder(spark, path)
    return sorted((f for f in fs.listStatus(place) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())


def in_order(spark: SparkSession, path: str) -> bool:
    """Set the times of the files a second apart, by name, and say whether the file system has kept them."""
    _, fs = published.folder(spark, path)
    files = data_files(spark, path)
    newest = max((f.getModificationTime() for f in files), default=0) // 1000 * 1000
    times = [newest - 1000 * i for i in reversed(range(len(files)))]
    try:
        for f, t in zip(files, times):
            fs.setTimes(f.getPath(), t, -1)
    except Py4JJavaError:
        return False
    return [f.getModificationTime() for f in data_files(spark, path)] == times


@query("d9_stream_frames", with_views(DYNAMIC, long_sql(["tmp", "apcp"]), body=_PERIOD.replace(
    "FROM lf", "FROM lf WHERE TIMESTAMP '2020-01-01' + INTERVAL '29' HOUR * CAST(24 * (floor(step / 24.0) + 1) AS INT) "
    "<= (SELECT max(t) FROM fx_dynamic) - INTERVAL '90' DAY") + " HAVING count(*) = 24"))
def stream_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The frames that are out when the last trigger is done: those that end 90 days or more before the newest row."""
    feats = ["tmp", "apcp"]
    stream = arriving(cut_lineage(fx.dynamic(spark, sf).select("y", "x", "step", "t", *feats)), "t", "arriving")
    path, checkpoint = scratch_dir(spark, "frames"), scratch_dir(spark, "stream-state")
    frames = SF.stream_frames(stream, 24, feats, fx.STEP_SECONDS, "90 days", origin=fx.FIRST)
    SF.write_frames(frames, path, checkpoint).awaitTermination()
    out = SF.whole_frames(SF.published(spark, path), feats)
    return out.select("y", "x", "period", "n", "feat", *r6("mean", "min", "max", "std", "sum_or_diff"))


@query("c3_stream_join_truth", with_views(ERRORS, body="""
SELECT step, feat, count(*) AS n_state, round(avg(abs(err_state)), 6) AS mean_state, round(var_pop(abs(err_state)), 4) AS var_state,
  round(avg(abs(err_res)), 6) AS mean_res FROM fx_err GROUP BY step, feat"""))
def stream_join_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Error by lead step of predictions and truth that arrive as two streams."""
    errors = cut_lineage(fx.errors(spark, sf))
    said = arriving(TJ.issued_predictions(errors, fx.STEP_SECONDS), "issued", "predictions")
    seen = arriving(errors.select("y", "x", "feat", "t", "true_prev", "true_state"), "t", "truth")
    horizon = fx.HORIZON * fx.STEP_SECONDS
    scored = TJ.score_arriving(said, seen, horizon, "60 days", block_seconds=horizon)
    m = V.horizon_moments()
    path, checkpoint = scratch_dir(spark, "batches"), scratch_dir(spark, "stream-state")
    SP.stream_merge(scored, m, path, checkpoint).awaitTermination()
    out = m.finish(SP.merged_partials(spark, path, m))
    return out.select("step", "feat", "n_state", *r6("mean_state"), settled("var_state", 4).alias("var_state"), *r6("mean_res"))
