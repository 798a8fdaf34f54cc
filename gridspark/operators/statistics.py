"""Pixel-wise statistics, histograms, period frames and simple scores.

Features are aggregated side by side in their wide columns and turned to long form afterwards, so the rows
going into an aggregate are never multiplied by the number of features. All aggregates combine partial
results before the exchange, which also takes care of hot pixels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import PIXEL, vocab
from ..functions import expressions as E

STATS = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop}


def _long(df: DataFrame, keys: Sequence[str], feats: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Columns `<feat>__<name>` -> one row per feature."""
    parts = ", ".join(f"'{f}', " + ", ".join(f"`{f}__{n}`" for n in names) for f in feats)
    return df.select(*keys, F.expr(f"stack({len(feats)}, {parts}) AS (feat, {', '.join(names)})"))


def stats_by(df: DataFrame, by: Sequence[str], feats: Sequence[str], stats: Mapping = STATS) -> DataFrame:
    """Statistics of several features per group, long form."""
    aggs = [fn(F.col(f).cast("double")).alias(f"{f}__{n}") for f in feats for n, fn in stats.items()]
    return _long(df.groupBy(*by).agg(*aggs), by, feats, list(stats))


def gridstats_monthly(df: DataFrame, feats: Sequence[str], keys: Sequence[str] = PIXEL, t: str = "t") -> DataFrame:
    """Min, max, mean and population std per month of the year, pixel and feature."""
    return stats_by(df.withColumn("month", F.month(t)), ["month", *keys], feats)


def gridstats_year_month(df: DataFrame, feats: Sequence[str], keys: Sequence[str] = PIXEL, t: str = "t") -> DataFrame:
    """The same for each year and month."""
    dated = df.withColumns({"year": F.year(t), "month": F.month(t)})
    return stats_by(dated, ["year", "month", *keys], feats)


def gridstats_bulk(gridstats: DataFrame, keys: Sequence[str] = PIXEL) -> DataFrame:
    """Over the months: lowest min, highest max, mean of the means, mean of the stds."""
    return gridstats.groupBy(*keys, "feat").agg(
        F.min("min").alias("min"), F.max("max").alias("max"), F.avg("mean").alias("mean"), F.avg("std").alias("std"))


def _binned(df: DataFrame, keys: Sequence[str], bounds: Mapping[str, tuple[float, float]], bins: int) -> DataFrame:
    """(feat, bin, side) rows; side is -1 below the bounds, 1 above them, 0 inside."""
    entries = []
    for feat, (lo, hi) in bounds.items():
        v = F.col(feat).cast("double")
        side = F.when(v < lo, -1).when(v > hi, 1).otherwise(0)
        entries.append(F.struct(
            F.lit(feat).alias("feat"), E.bin_index(v, lo, hi, bins).alias("bin"), side.alias("side")))
    return df.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.*").where("bin IS NOT NULL")


def gridhist_monthly(df: DataFrame, bounds: Mapping[str, tuple[float, float]], bins: int,
                     keys: Sequence[str] = PIXEL, t: str = "t") -> DataFrame:
    """Sparse monthly histogram per pixel and feature; end bins also report what was under or over the bounds."""
    dated = df.withColumn("month", F.month(t))
    return _binned(dated, ["month", *keys], bounds, bins).groupBy("month", *keys, "feat", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == -1).alias("n_under"),
        F.count_if(F.col("side") == 1).alias("n_over"))


def hist_totals(hist: DataFrame, by: Sequence[str] = ("feat",), normalize: bool = False) -> DataFrame:
    """Sum histograms over everything but `by` and the bin; with `normalize` also the share in its group."""
    totals = hist.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    if not normalize:
        return totals
    sizes = hist.groupBy(*by).agg(F.sum("n").alias("_all"))
    return totals.join(sizes, list(by)).withColumn("frequency", F.col("n") / F.col("_all")).drop("_all")


def hist_centers(hist: DataFrame, bounds: Mapping[str, tuple[float, float]], bins: int) -> DataFrame:
    """Add the bin center of each feature's own bounds."""
    center = F.lit(None).cast("double")
    for feat, (lo, hi) in bounds.items():
        center = F.when(F.col("feat") == feat, E.bin_center("bin", lo, hi, bins)).otherwise(center)
    return hist.withColumn("center", center)


def relative_center(hist: DataFrame, feat: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Bin center of an area-density histogram as relative moisture of the row's soil class.

    Needs `porosity` and `wiltingp`; classes without parameters take the default ones.
    """
    density = E.bin_center("bin", lo, hi, bins) / F.lit(vocab.layer_depth(feat)) / 1000
    wilt = F.coalesce("wiltingp", F.lit(vocab.DEFAULT_WILTINGP))
    pore = F.coalesce("porosity", F.lit(vocab.DEFAULT_POROSITY))
    return hist.withColumn("center", (density - wilt) / (pore - wilt))


def hist_difference(hist: DataFrame, total: str, part: str, name: str) -> DataFrame:
    """Histogram `total` minus `part` bin by bin, as feature `name`; one pass, no self-join."""
    signed = F.sum(F.when(F.col("feat") == total, F.col("n")).otherwise(-F.col("n")))
    keys = [c for c in hist.columns if c not in ("feat", "n", "n_under", "n_over")]
    return (
        hist.where(F.col("feat").isin(total, part)).groupBy(*keys).agg(signed.alias("n"))
        .withColumn("feat", F.lit(name))
    )


def norm_coeffs(df: DataFrame, feats: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, std, min and max per feature, globally or per pixel."""
    return stats_by(df, list(by), feats)


def all_zero_rows(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """How many rows hold zero in every feature."""
    return df.agg(F.count_if(E.all_of([F.col(f) == 0 for f in feats])).alias("n_zero"), F.count(F.lit(1)).alias("n"))


# --- period frames --------------------------------------------------------------------------------

FRAME_METRICS = ("mean", "min", "max", "std", "sum_or_diff")
#: Steps whose occurrence one 64-bit mask holds, and the most masks kept side by side.
MASK_STEPS, MASKS = 63, 16


def each_step_seen(step: str, n: int) -> list[Column]:
    """Aggregates that tell which of a period's n steps occur, as bit masks `_seen0`, `_seen1`, ...; see `steps_seen`.

    Masks are plain buffers of a hash aggregate. Periods of over a thousand steps keep a set instead.
    """
    if n > MASK_STEPS * MASKS:
        return [F.collect_set(step).alias("_seen")]
    place = F.pmod(F.col(step), F.lit(n)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(MASK_STEPS)))
    return [F.bit_or(F.when(F.floor(place / F.lit(MASK_STEPS)) == i, bit)).alias(f"_seen{i}") for i in range(-(-n // MASK_STEPS))]


def steps_seen(n: int) -> Column:
    """Number of different steps that `each_step_seen` has found."""
    if n > MASK_STEPS * MASKS:
        return F.size("_seen")
    counts = [F.coalesce(F.bit_count(f"_seen{i}"), F.lit(0)) for i in range(-(-n // MASK_STEPS))]
    return sum(counts[1:], counts[0])


def frame_aggregates(feats: Sequence[str], sum_feats: Sequence[str], step: str, t: str) -> list[Column]:
    """Size, span and, for each feature, mean, min, max, std and the sum of a flux or last - first of a state."""
    aggs = [F.count(F.lit(1)).alias("n"), F.min(t).alias("t_start"), F.max(t).alias("t_end")]
    for f in feats:
        v = F.col(f).cast("double")
        total = F.sum(v) if f in sum_feats else F.max_by(v, F.col(step)) - F.min_by(v, F.col(step))
        aggs += [F.avg(v).alias(f"{f}__mean"), F.min(v).alias(f"{f}__min"), F.max(v).alias(f"{f}__max"),
                 F.stddev_pop(v).alias(f"{f}__std"), total.alias(f"{f}__sum_or_diff")]
    return aggs


def period_frames(df: DataFrame, n: int, feats: Sequence[str], sum_feats: Sequence[str] = vocab.SUM_FEATS,
                  keys: Sequence[str] = PIXEL, step: str = "step", t: str = "t", keep_incomplete: bool = False
                  ) -> DataFrame:
    """Per pixel and period of n steps: mean, min, max, std, and the sum of fluxes or last - first of states.

    Only periods that hold each step exactly once, unless `keep_incomplete`.
    """
    masks = [] if keep_incomplete else each_step_seen(step, n)
    grouped = df.withColumn("period", F.floor(F.col(step) / F.lit(n))).groupBy(*keys, "period").agg(
        *frame_aggregates(feats, sum_feats, step, t), *masks)
    if not keep_incomplete:
        grouped = grouped.where((F.col("n") == n) & (steps_seen(n) == n))
    return long_frames(grouped, feats, keys)


def long_frames(grouped: DataFrame, feats: Sequence[str], keys: Sequence[str] = PIXEL) -> DataFrame:
    """Frames with features side by side, one row per feature."""
    return _long(grouped, [*keys, "period", "t_start", "t_end", "n"], feats, FRAME_METRICS)


def frame_bounds(frames: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Global min and max per feature and metric over frames."""
    stats = {"lo": F.min, "hi": F.max}
    aggs = [fn(F.col(m)).alias(f"{m}__{n}") for m in metrics for n, fn in stats.items()]
    grouped = frames.groupBy("feat").agg(*aggs)
    return _long(grouped.withColumnRenamed("feat", "_feat"), ["_feat"], metrics, list(stats)).select(
        F.col("_feat").alias("feat"), F.col("feat").alias("metric"), "lo", "hi")


# --- scores and fits ------------------------------------------------------------------------------

def mae_rmse(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error and root mean squared error along the axes not in `by`."""
    e = F.col(pred) - F.col(truth)
    return df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(e).alias("n"))


def grid_mae(df: DataFrame, truth: str, pred: str, sample: Sequence[str], keys: Sequence[str] = PIXEL,
             extra: Sequence[str] = ("feat",)) -> DataFrame:
    """Mean over samples of the per-sample MAE, for each pixel."""
    per_sample = df.groupBy(*keys, *sample, *extra).agg(F.avg(F.abs(F.col(pred) - F.col(truth))).alias("_e"))
    return per_sample.groupBy(*keys, *extra).agg(F.avg("_e").alias("mae"), F.count(F.lit(1)).alias("n_samples"))


def range_histogram(df: DataFrame, truth: str, pred: str, bins: int, feat: str = "feat") -> DataFrame:
    """Histograms of truth and prediction on their common range, each value going to the nearest bin.

    The range is one row per feature, so it is broadcast: the feature list bounds its size.
    """
    ranges = df.groupBy(feat).agg(
        F.least(F.min(truth), F.min(pred)).alias("lo"), F.greatest(F.max(truth), F.max(pred)).alias("hi"))
    values = df.select(feat, F.explode(F.array(
        F.struct(F.lit("truth").alias("source"), F.col(truth).alias("v")),
        F.struct(F.lit("pred").alias("source"), F.col(pred).alias("v")))).alias("_e")).select(feat, "_e.*")
    scaled = E.ratio(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo"))
    binned = values.join(F.broadcast(ranges), feat).withColumn("bin", F.rint(scaled * (bins - 1)).cast("int"))
    return binned.where("bin IS NOT NULL").groupBy(feat, "source", "bin").agg(F.count(F.lit(1)).alias("n"))


def linear_fit(df: DataFrame, x: str, y: str, at: float, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line: slope, intercept, r2 and the value predicted at `at`; null where x is constant."""
    sxy, sxx, syy = F.regr_sxy(y, x), F.regr_sxx(y, x), F.regr_syy(y, x)
    slope = E.ratio(sxy, sxx)
    intercept = F.regr_avgy(y, x) - slope * F.regr_avgx(y, x)
    r2 = F.when((syy == 0) & (sxx > 0), F.lit(1.0)).otherwise(E.ratio(sxy * sxy, sxx * syy))
    return df.groupBy(*by).agg(
        slope.alias("slope"), intercept.alias("intercept"), r2.alias("r2"),
        (slope * F.lit(float(at)) + intercept).alias("predicted"))


def fit_scale(train: DataFrame, feats: Sequence[str]) -> DataFrame:
    """One row of mean and std per feature, fitted on the training rows."""
    return stats_by(train, [], feats, {"mean": F.avg, "std": F.stddev_pop})


def apply_scale(df: DataFrame, scales: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Scale by fitted means and stds, read as one struct of the one-row-per-feature table.

    The fit is run once for all features and statistics, next to the one pass over `df`.
    """
    def picked(feat: str, stat: str) -> Column:
        return F.max(F.when(F.col("feat") == feat, F.col(stat))).alias(stat)
    one = scales.agg(F.struct(*[F.struct(picked(f, "mean"), picked(f, "std")).alias(f) for f in feats]).alias("fit"))
    held = df.withColumn("_fit", one.scalar())
    return held.withColumns({f: E.ratio(F.col(f) - F.col(f"_fit.{f}.mean"), F.col(f"_fit.{f}.std")) for f in feats}).drop("_fit")
