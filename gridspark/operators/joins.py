"""Joins between pixel-hour tables, static tables, samples, init times and tiles.

No side is hinted for broadcast: table sizes decide, so a static table or an init list that grows past the
threshold falls back to a shuffled join, and adaptive execution splits the partitions of hot pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import PIXEL


def join_forcing_model(forcing: DataFrame, model: DataFrame, keys: Sequence[str] = (*PIXEL, "t")) -> DataFrame:
    """Pair two hourly series by pixel and time stamp; unpaired rows are dropped."""
    return forcing.join(model, list(keys), "inner")


def join_static(df: DataFrame, static: DataFrame, keys: Sequence[str] = PIXEL, feats: Sequence[str] | None = None,
                salts: int = 1, salt_by: str = "t") -> DataFrame:
    """Give every row the static row of its pixel.

    Adaptive execution splits a hot pixel. Where it is off, `salts` spreads every pixel over that many
    sub-keys of the `salt_by` column, at the price of as many copies of the (short) static table.
    """
    side = static if feats is None else static.select(*keys, *feats)
    if salts <= 1:
        return df.join(side, list(keys), "inner")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], "inner").drop("_salt")


def join_sample_prediction(samples: DataFrame, predictions: DataFrame, keys: Sequence[str],
                           sample_parts: Sequence[str] | None = None, prediction_parts: Sequence[str] | None = None
                           ) -> DataFrame:
    """Pair samples with predictions by key; parts not asked for are never read."""
    left = samples if sample_parts is None else samples.select(*keys, *sample_parts)
    right = predictions if prediction_parts is None else predictions.select(*keys, *prediction_parts)
    return left.join(right, list(keys), "inner")


def align_steps(labels: DataFrame, predictions: DataFrame, keys: Sequence[str], step: str = "step") -> DataFrame:
    """Cut labels (step 0 is the initial state) and predictions (steps from 1) to the steps both have."""
    return labels.where(F.col(step) >= 1).join(predictions, [*keys, step], "inner")


def nearest_time(times: DataFrame, pivots: DataFrame, t: str = "t", pivot: str = "pivot", keys: Sequence[str] = (),
                 bucket_seconds: int = 86400) -> DataFrame:
    """For each requested time, the nearest time stamp of the axis; a tie takes the earlier one.

    Time stamps and requests are merged in time order inside (keys, bucket), where each request sees its
    neighbours. Neighbours in other buckets come from a table with one row per bucket. Nothing is paired up.
    """
    keys = list(keys)
    stamps = times.select(*keys, F.col(t).alias("_at")).distinct().withColumn("_stamp", F.col("_at"))
    asked = pivots.select(*keys, F.col(pivot).alias("_at")).distinct().withColumn(
        "_stamp", F.lit(None).cast(times.schema[t].dataType))
    seconds = F.unix_timestamp(F.col("_at").cast("timestamp"))
    points = stamps.unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True).withColumn(
        "_bucket", F.floor(seconds / F.lit(bucket_seconds)))

    def seen(column, partition, order, frame_end=None):
        w = Window.partitionBy(*partition).orderBy(order)
        w = w.rangeBetween(Window.unboundedPreceding, Window.currentRow) if frame_end is None \
            else w.rowsBetween(Window.unboundedPreceding, frame_end)
        return F.last(column, ignorenulls=True).over(w)

    local = points.select(
        *keys, "_bucket", "_at", "_asked",
        seen("_stamp", [*keys, "_bucket"], F.asc("_at")).alias("_below"),
        seen("_stamp", [*keys, "_bucket"], F.desc("_at")).alias("_above"),
    ).where("_asked")
    buckets = points.groupBy(*keys, "_bucket").agg(F.min("_stamp").alias("_lo"), F.max("_stamp").alias("_hi"))
    carried = buckets.select(
        *keys, "_bucket",
        seen("_hi", keys, F.asc("_bucket"), -1).alias("_carry_below"),
        seen("_lo", keys, F.desc("_bucket"), -1).alias("_carry_above"),
    )
    below, above = F.coalesce("_below", "_carry_below"), F.coalesce("_above", "_carry_above")
    as_seconds = lambda c: c.cast("timestamp").cast("double")
    at = as_seconds(F.col("_at"))
    nearest = (
        F.when(above.isNull(), below).when(below.isNull(), above)
        .when(at - as_seconds(below) <= as_seconds(above) - at, below).otherwise(above)
    )
    return local.join(carried, [*keys, "_bucket"]).select(
        *keys, F.col("_at").alias(pivot), nearest.alias(t))


def window_interval_join(rows: DataFrame, inits: DataFrame, before_seconds: int, after_seconds: int, t: str = "t",
                         init: str = "init_time", keys: Sequence[str] = ()) -> DataFrame:
    """Rows in each init time's [init - before, init + after), for init times at any spacing.

    Time is cut into bins as wide as the span, so an interval touches at most two bins and the range join
    becomes an equality join on the bin. For init times at a fixed spacing use `samples.grid_sample_rows`,
    which needs no join.
    """
    span = before_seconds + after_seconds
    keys = list(keys)
    begin = F.unix_timestamp(init) - F.lit(before_seconds)
    bins = F.sequence(F.floor(begin / F.lit(span)), F.floor((begin + F.lit(span - 1)) / F.lit(span)))
    wanted = inits.select(*keys, init).distinct().withColumn("_bin", F.explode(bins))
    seconds = F.unix_timestamp(t)
    lag = F.unix_timestamp(t) - F.unix_timestamp(init)
    return (
        rows.withColumn("_bin", F.floor(seconds / F.lit(span)))
        .join(wanted, [*keys, "_bin"])
        .where((lag >= -before_seconds) & (lag < after_seconds))
        .drop("_bin")
    )


def overlapping_tiles(spans: DataFrame, start: str, end: str, begin: str = "t_begin", finish: str = "t_end"
                      ) -> DataFrame:
    """Blocks whose [begin, finish] time range meets [start, end)."""
    return spans.where(
        (F.col(finish) >= F.lit(start).cast("timestamp")) & (F.col(begin) < F.lit(end).cast("timestamp")))


def missing_times(present: DataFrame, spans: DataFrame, step_seconds: int = 3600, t: str = "t",
                  keys: Sequence[str] = ()) -> DataFrame:
    """Expected times of each key's [begin, end] span that are not present.

    Spans are cut into days before the hours are listed, so no single row lists a long span.
    """
    keys = list(keys)
    hours = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(step_seconds))
    day_count = F.floor((F.unix_timestamp("end") - F.unix_timestamp("begin")) / F.lit(step_seconds * 24))
    expected = (
        spans.select(*keys, "begin", "end", F.explode(F.sequence(F.lit(0).cast("bigint"), day_count)).alias("_d"))
        .withColumn("_from", F.timestamp_seconds(F.unix_timestamp("begin") + F.col("_d") * (step_seconds * 24)))
        .withColumn("_to", F.least(
            F.timestamp_seconds(F.unix_timestamp("_from") + F.lit(step_seconds * 23)), F.col("end")))
        .select(*keys, F.explode(F.sequence("_from", "_to", hours)).alias(t))
    )
    return expected.join(present.select(*keys, t), [*keys, t], "left_anti")


def class_combinations(static: DataFrame, a: str = "int_veg", b: str = "int_soil") -> DataFrame:
    """Pixel count for every pair of the classes that occur, empty pairs included.

    There are at most 14 x 17 classes, so the two class sets of one aggregate row are expanded in place.
    """
    sets = static.agg(F.collect_set(a).alias("_a"), F.collect_set(b).alias("_b"))
    pairs = sets.select(F.explode("_a").alias(a), "_b").select(a, F.explode("_b").alias(b))
    counts = static.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(counts, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def global_index(df: DataFrame, tiles: DataFrame, tile: str = "tile") -> DataFrame:
    """Tile-local y and x plus the offset of the tile."""
    return (
        df.join(tiles.select(tile, "off_y", "off_x"), tile)
        .withColumns({"y": F.col("y") + F.col("off_y"), "x": F.col("x") + F.col("off_x")})
        .drop("off_y", "off_x")
    )


def join_results(efficiency: DataFrame, information: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Efficiency, information measures and configuration of each (model, feat)."""
    out = efficiency.join(information, ["model", "feat"], "left")
    return out if config is None else out.join(config, "model", "left")
