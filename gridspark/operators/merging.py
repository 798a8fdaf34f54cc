"""Combining partial results, information measures, and summaries over pixels, classes and models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import PIXEL
from ..functions import expressions as E
from ..functions.lookups import lai_from_gvf
from .verification import Moments


def merge_partials(*partials: DataFrame, by: Sequence[str], add: Sequence[str]) -> DataFrame:
    """Add the sums and counts of partial results from tiles or batches."""
    rows = reduce(DataFrame.unionByName, partials)
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in add])


def combine_periods(partials: DataFrame, moments: Moments, levels: Sequence[str] = ("region", "season", "period")
                    ) -> DataFrame:
    """Count-weighted merge over regions, seasons and periods with totals under the key `all`."""
    rest = [k for k in moments.keys if k not in levels]
    sets = [[*map(F.col, levels[:i]), *map(F.col, rest)] for i in range(len(levels), -1, -1)]
    merged = partials.groupingSets(sets, *levels, *rest).agg(*moments.merging())
    return moments.finish(merged.withColumns({k: F.coalesce(k, F.lit("all")) for k in levels}))


def information_measures(counts: DataFrame, by: Sequence[str] = (), base: float | None = None) -> DataFrame:
    """Entropies of truth (b1), prediction (b2) and both, mutual information, loss and fractional information.

    H = ln N - sum(c ln c) / N, so one pass with three grouping sets gives all counts needed.
    """
    sets = [[*by, "b1", "b2"], [*by, "b1"], [*by, "b2"]]
    groups = [[F.col(c) for c in s] for s in sets]
    g = counts.groupingSets(groups, *by, "b1", "b2").agg(
        F.sum("n").cast("double").alias("c"), F.grouping("b1").alias("g1"), F.grouping("b2").alias("g2"))
    weight = F.when(F.col("c") > 0, F.col("c") * F.ln("c")).otherwise(F.lit(0.0))
    pick = lambda cond, v: F.sum(F.when(F.expr(cond), v).otherwise(F.lit(0.0)))
    sums = g.groupBy(*by).agg(
        pick("g1 = 0 AND g2 = 0", F.col("c")).alias("N"), pick("g1 = 0 AND g2 = 0", weight).alias("w_all"),
        pick("g1 = 0 AND g2 = 1", weight).alias("w_y"), pick("g1 = 1 AND g2 = 0", weight).alias("w_p"))
    unit = F.lit(1.0) if base is None else F.ln(F.lit(float(base)))
    h = lambda w: (F.ln("N") - F.col(w) / F.col("N")) / unit
    out = sums.where("N > 0").select(*by, h("w_y").alias("h_y"), h("w_p").alias("h_p"), h("w_all").alias("h_joint"))
    mi = F.col("h_y") + F.col("h_p") - F.col("h_joint")
    return out.select(
        *by, "h_y", "h_p", "h_joint", mi.alias("mutual_info"), (F.col("h_joint") - F.col("h_p")).alias("info_loss"),
        E.ratio(mi, "h_joint").alias("fractional_info"))


def marginal_error(hist: DataFrame, axis: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean covariate along one axis of a joint histogram, with the counts."""
    sums = hist.groupBy(*by, axis).agg(F.sum("cov_sum").alias("cov_sum"), F.sum("n").alias("n"))
    return sums.withColumn("mean", E.ratio("cov_sum", "n"))


def seasonal_means(df: DataFrame, feats: Sequence[str], keys: Sequence[str] = PIXEL, t: str = "t") -> DataFrame:
    """Pixel means of each meteorological season."""
    from .statistics import stats_by
    return stats_by(df.withColumn("season", E.season(t)), ["season", *keys], feats, {"mean": F.avg})


def time_series_means(df: DataFrame, feats: Sequence[str], group: str = "all", static: DataFrame | None = None,
                      elev_bins: Sequence[tuple[float, float]] = (), monthly: bool = False,
                      keys: Sequence[str] = PIXEL, t: str = "t") -> DataFrame:
    """Series averaged over all pixels, by soil class, or by elevation range [lo, hi).

    `monthly` averages the series by month of the year. Elevation ranges may overlap; a pixel counts in each.
    """
    from .statistics import stats_by
    if group == "all":
        rows = df.withColumn("key", F.lit("all"))
    elif group == "texture":
        rows = df.join(static.select(*keys, F.col("int_soil").cast("string").alias("key")), list(keys))
    elif group == "elev":
        inside = F.array(*[
            F.when((F.col("elev") >= F.lit(float(lo))) & (F.col("elev") < F.lit(float(hi))), F.lit(f"{lo}-{hi}"))
            for lo, hi in elev_bins])
        named = static.select(*keys, F.explode(F.array_compact(inside)).alias("key"))
        rows = df.join(named, list(keys))
    else:
        raise ValueError("group must be all, texture or elev")
    series = stats_by(rows, ["key", t], feats, {"mean": F.avg})
    if not monthly:
        return series
    return series.groupBy("key", F.month(t).alias("month"), "feat").agg(F.avg("mean").alias("mean"))


def ensemble_spread(df: DataFrame, value: str, averaging: str = "all", static: DataFrame | None = None,
                    by: Sequence[str] = ("step", "feat"), keys: Sequence[str] = PIXEL) -> DataFrame:
    """Mean and std across pixels per step: over all, by soil class, or untouched with zero spread."""
    if averaging == "none":
        return df.select(*keys, *by, F.col(value).alias("mean"), F.lit(0.0).alias("std"))
    rows, group = df, list(by)
    if averaging == "texture":
        rows, group = df.join(static.select(*keys, "int_soil"), list(keys)), ["int_soil", *by]
    elif averaging != "all":
        raise ValueError("averaging must be all, texture or none")
    return rows.groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def class_counts(static: DataFrame, region: str | None = None, classes: Sequence[str] = ("int_veg", "int_soil")
                 ) -> DataFrame:
    """Pixels per vegetation and soil class, overall (`all`) and, if given, for each region."""
    n = F.count(F.lit(1)).alias("n")
    if region is None:
        return static.groupBy(*classes).agg(n)
    sets = [[F.col(region), *map(F.col, classes)], [*map(F.col, classes)]]
    return static.groupingSets(sets, region, *classes).agg(n).withColumn(region, F.coalesce(region, F.lit("all")))


def class_params_table(static: DataFrame, params: Sequence[str], by: str = "int_soil") -> DataFrame:
    return static.groupBy(by).agg(*[F.avg(p).alias(p) for p in params])


def greenness_by_class(df: DataFrame, greenness: str = "veg", month: str = "month") -> DataFrame:
    """Mean and std of greenness and of the leaf area index it implies, by vegetation class and month."""
    return lai_from_gvf(df, greenness).groupBy("int_veg", month).agg(
        F.avg(greenness).alias("gvf_mean"), F.stddev_pop(greenness).alias("gvf_std"),
        F.avg("lai_gvf").alias("lai_mean"), F.stddev_pop("lai_gvf").alias("lai_std"))


def best_epoch(history: DataFrame, metric: str, model: str = "model", epoch: str = "epoch") -> DataFrame:
    """Lowest value of a metric for each model and the first epoch that reached it."""
    best = F.min(F.when(F.col(metric).isNotNull(), F.struct(metric, epoch)))
    return history.groupBy(model).agg(best.alias("_b")).select(
        model, F.col(f"_b.{metric}").alias("best"), F.col(f"_b.{epoch}").alias("epoch"))


def metric_curves(history: DataFrame, metrics: Sequence[str], model: str = "model", epoch: str = "epoch") -> DataFrame:
    """Metric curves in long form."""
    from ..functions.features import unpivot_feats
    return unpivot_feats(history, [model, epoch], metrics, "metric").where("value IS NOT NULL")


def model_rank(results: DataFrame, information: str = "fractional_info", mae: str = "mae", feat: str = "feat"
               ) -> DataFrame:
    """Rank the models of each feature by information (best is 1) and by mean absolute error."""
    w = Window.partitionBy(feat)
    return results.withColumns({
        "rank_information": F.rank().over(w.orderBy(F.desc_nulls_last(information))),
        "rank_mae": F.rank().over(w.orderBy(F.asc_nulls_last(mae)))})
