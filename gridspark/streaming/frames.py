"""Period frames of a stream: tumbling windows of event time in append mode, and what came too late for them.

Spark holds one row of state for each open (pixel, period) and puts a period out once, when the watermark, the newest time stamp
of earlier triggers less the allowed delay, has passed its end. A row that comes for a period already out is late: it changes no
published frame. How many rows that were is not left to the engine's metrics: the rows that arrive are counted by period in a
side table, trigger by trigger, and `late_rows` is what arrived less what the published frames hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import PIXEL, vocab
from ..operators.statistics import FRAME_METRICS, each_step_seen, frame_aggregates, long_frames, steps_seen
from .partials import write_batches

EPOCH = "1970-01-01 00:00:00"


def period_of(t: Column | str, n: int, step_seconds: int, origin: str = EPOCH) -> Column:
    """Number of the period of n steps that a time is in, counted from the origin, the time of step 0."""
    at = F.col(t) if isinstance(t, str) else t
    start = F.unix_timestamp(F.lit(origin).cast("timestamp"))
    return F.floor((F.unix_timestamp(at) - start) / F.lit(n * step_seconds))


def stream_frames(rows: DataFrame, n: int, feats: Sequence[str], step_seconds: int, delay: str,
                  sum_feats: Sequence[str] = vocab.SUM_FEATS, keys: Sequence[str] = PIXEL, step: str = "step", t: str = "t",
                  origin: str = EPOCH) -> DataFrame:
    """The frames of `operators.statistics.period_frames` of a stream, features side by side, with `whole`.

    `origin` is the time of step 0 in UTC and steps are `step_seconds` apart. Frames that miss a step, or hold one twice, come out
    too and are told by `whole`, as their rows count in `late_rows`. Rows without a time are in no frame.
    """
    length = n * step_seconds
    shift = int(rows.sparkSession.sql(f"SELECT unix_timestamp(TIMESTAMP '{origin}')").first()[0]) % length
    span = F.window(t, f"{length} seconds", startTime=f"{shift} seconds")
    framed = rows.withWatermark(t, delay).groupBy(*keys, span.alias("_span")).agg(
        *frame_aggregates(feats, sum_feats, step, t), *each_step_seen(step, n))
    return framed.select(
        *keys, period_of("_span.start", n, step_seconds, origin).alias("period"), "t_start", "t_end", "n",
        ((F.col("n") == n) & (steps_seen(n) == n)).alias("whole"), *[f"{f}__{m}" for f in feats for m in FRAME_METRICS])


def write_frames(frames: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Store what each trigger puts out in a folder of its own; a replayed trigger overwrites its own folder."""
    return write_batches(frames, lambda batch: batch, path, checkpoint, once, "append")


def published(spark: SparkSession, path: str) -> DataFrame:
    """All frames put out so far, whole or not, features side by side."""
    return spark.read.parquet(path).drop("batch")


def whole_frames(frames: DataFrame, feats: Sequence[str], keys: Sequence[str] = PIXEL) -> DataFrame:
    """The whole ones of published frames in the long form of `period_frames`."""
    return long_frames(frames.where("whole"), feats, keys)


def count_arrivals(rows: DataFrame, n: int, step_seconds: int, path: str, checkpoint: str, keys: Sequence[str] = PIXEL, t: str = "t",
                   origin: str = EPOCH, once: bool = True) -> StreamingQuery:
    """The side table: rows that arrived by pixel and period, stored by trigger like the frames. The stream keeps no state."""
    def counted(batch: DataFrame) -> DataFrame:
        return batch.groupBy(*keys, period_of(t, n, step_seconds, origin).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return write_batches(rows, counted, path, checkpoint, once, "append")


def late_rows(spark: SparkSession, arrivals: str, frames: str, keys: Sequence[str] = PIXEL) -> DataFrame:
    """(keys, period, arrived, framed, late) of the periods with late rows.

    A period counts once one that ends as late or later is out. Rows without a time are late under a null period. Rows of a
    period may be late as a whole; then there is no frame and `framed` is 0.
    """
    came = spark.read.parquet(arrivals).groupBy(*keys, "period").agg(F.sum("n").alias("arrived"))
    out = published(spark, frames).select(*keys, "period", F.col("n").alias("_framed"))
    newest = out.agg(F.max("period"))
    both = came.join(out, [*keys, "period"], "left").withColumn("framed", F.coalesce("_framed", F.lit(0).cast("bigint")))
    closed = F.col("period").isNull() | (F.col("period") <= newest.scalar())
    return both.where(closed & (F.col("arrived") > F.col("framed"))).select(
        *keys, "period", "arrived", "framed", (F.col("arrived") - F.col("framed")).alias("late"))
