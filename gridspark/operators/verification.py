"""Forecast verification on the long scored table.

A scored row is (sample keys, step, feat, true_prev, true_state, pred_res): the observed state before and
after the step and the predicted increment. `error_columns` adds the rest. Every evaluator is an aggregate of
mergeable partials: `partial` on rows, `merge` on partials, `finish` to means and variances.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import PIXEL
from ..functions import expressions as E

Axis = tuple[str, float, float, int]
SAMPLE = (*PIXEL, "init")
SOURCES = ("true_res", "pred_res", "err_res", "true_state", "pred_state", "err_state")


def error_columns(scored: DataFrame, sample: Sequence[str] = SAMPLE, step: str = "step", absolute: bool = False
                  ) -> DataFrame:
    """Add true_res, pred_state, err_state and err_res; errors are bias, or magnitudes with `absolute`.

    The window holds one sample of one feature, so its length is the forecast horizon.
    """
    order = Window.partitionBy(*sample, "feat").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    shape = F.abs if absolute else (lambda c: c)
    out = scored.withColumns({
        "true_res": F.col("true_state") - F.col("true_prev"),
        "pred_state": F.first("true_prev").over(order) + F.sum("pred_res").over(order),
    })
    return out.withColumns({
        "err_state": shape(F.col("pred_state") - F.col("true_state")),
        "err_res": shape(F.col("pred_res") - F.col("true_res")),
    })


@dataclass(frozen=True)
class Moments:
    """Mergeable count, sum and sum of squared deviations of named measures per group.

    `measures` maps a name to a column expression. Partials carry n_, sum_ and m2_ columns; m2 is the sum of
    squared deviations from the partial's own mean, which merges without cancellation of large squares.
    """

    keys: Sequence[str]
    measures: Mapping[str, Column] = field(default_factory=dict)

    def aggregates(self) -> list[Column]:
        out = []
        for name, m in self.measures.items():
            v = m.cast("double")
            n = F.count(v)
            out += [n.alias(f"n_{name}"), F.coalesce(F.sum(v), F.lit(0.0)).alias(f"sum_{name}"),
                    F.coalesce(F.var_pop(v) * n, F.lit(0.0)).alias(f"m2_{name}")]
        return out

    def partial(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.keys).agg(*self.aggregates())

    def merge(self, *partials: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
        """Add partials of tiles, periods or batches; `by` may name fewer keys than the partials have."""
        rows = reduce(DataFrame.unionByName, partials)
        return rows.groupBy(*(self.keys if by is None else by)).agg(*self.merging())

    def merging(self) -> list[Column]:
        out = []
        for name in self.measures:
            n, s, m2 = (F.col(f"{p}_{name}") for p in ("n", "sum", "m2"))
            within = F.sum(m2)
            between = F.sum(F.coalesce(E.ratio(s * s, n), F.lit(0.0))) - F.coalesce(
                E.ratio(F.sum(s) * F.sum(s), F.sum(n)), F.lit(0.0))
            out += [F.sum(n).alias(f"n_{name}"), F.sum(s).alias(f"sum_{name}"),
                    (within + F.greatest(between, F.lit(0.0))).alias(f"m2_{name}")]
        return out

    def finish(self, partials: DataFrame) -> DataFrame:
        """Means and population variances of merged partials."""
        others = [c for c in partials.columns if not any(
            c in (f"n_{m}", f"sum_{m}", f"m2_{m}") for m in self.measures)]
        cols = []
        for m in self.measures:
            cols += [F.col(f"n_{m}"), E.ratio(f"sum_{m}", f"n_{m}").alias(f"mean_{m}"),
                     E.ratio(f"m2_{m}", f"n_{m}").alias(f"var_{m}")]
        return partials.select(*others, *cols)


@dataclass(frozen=True)
class Tally:
    """Mergeable counts and sums of named measures per group; rows are first turned into (keys, measures) by `prepare`.

    The counterpart of `Moments` for evaluators that keep sums: partials carry n and sum_ columns, which add.
    """

    keys: Sequence[str]
    measures: Sequence[str]
    prepare: Callable[[DataFrame], DataFrame]

    def partial(self, df: DataFrame) -> DataFrame:
        sums = [F.sum(F.col(m).cast("double")).alias(f"sum_{m}") for m in self.measures]
        return self.prepare(df).groupBy(*self.keys).agg(*sums, F.count(F.lit(1)).alias("n"))

    def merge(self, *partials: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
        """Add partials; `by` may name fewer keys than they have."""
        sums = [F.sum(f"sum_{m}").alias(f"sum_{m}") for m in self.measures]
        return reduce(DataFrame.unionByName, partials).groupBy(*(self.keys if by is None else by)).agg(*sums, F.sum("n").alias("n"))

    def finish(self, partials: DataFrame) -> DataFrame:
        return partials.withColumns({f"mean_{m}": E.ratio(f"sum_{m}", "n") for m in self.measures})


def time_tally(t: str = "t", horizon_limit: int | None = None, absolute: bool = False, by: Sequence[str] = ()) -> Tally:
    """`error_by_time` as partials: each row counts once for its hour and once for its day."""
    shape = F.abs if absolute else (lambda c: c)

    def prepare(errors: DataFrame) -> DataFrame:
        rows = errors if horizon_limit is None else errors.where(F.col("step") <= horizon_limit)
        axes = F.array(F.struct(F.lit("hour").alias("axis"), E.hour_of_day(t).alias("bin")),
                       F.struct(F.lit("day").alias("axis"), E.day_of_year(t).alias("bin")))
        return rows.select(*by, "feat", shape(F.col("err_state")).alias("state"), shape(F.col("err_res")).alias("res"),
                           F.explode(axes).alias("_a")).select(*by, "_a.*", "feat", "state", "res")
    return Tally((*by, "axis", "bin", "feat"), ("state", "res"), prepare)


def histogram_tally(ax1: Axis, ax2: Axis, covariate: str | None = None, by: Sequence[str] = ()) -> Tally:
    """`joint_histogram` as partials."""
    def prepare(df: DataFrame) -> DataFrame:
        rows = df.select(*by, *[E.bin_index(F.expr(e), lo, hi, n).alias(b) for b, (e, lo, hi, n) in (("b1", ax1), ("b2", ax2))],
                         *([F.expr(covariate).cast("double").alias("cov")] if covariate else []))
        return rows.where("b1 IS NOT NULL AND b2 IS NOT NULL")
    return Tally((*by, "b1", "b2"), ("cov",) if covariate else (), prepare)


# --- error by lead time, clock and class ----------------------------------------------------------

def horizon_moments(by: Sequence[str] = ()) -> Moments:
    return Moments([*by, "step", "feat"], {"state": F.abs("err_state"), "res": F.abs("err_res")})


def error_by_horizon(errors: DataFrame, coarseness: int = 1) -> DataFrame:
    """Mean and variance of the absolute state and increment error by lead step and feature."""
    m = horizon_moments()
    return m.finish(m.partial(errors)).withColumn("forecast_hour", step_hour("step", coarseness))


def step_hour(step: Column | str, coarseness: int = 1) -> Column:
    """Forecast hour of a lead step."""
    return E.col(step) * F.lit(coarseness)


def period_midpoint(start: Column | str, end: Column | str) -> Column:
    """Time half way between the first and the last step of a period."""
    return F.timestamp_seconds((F.unix_timestamp(E.col(start)) + F.unix_timestamp(E.col(end))) / F.lit(2))


def error_by_time(errors: DataFrame, t: str = "t", horizon_limit: int | None = None, absolute: bool = False
                  ) -> DataFrame:
    """Error sums and counts by hour of the day and by day of the year, in one pass with grouping sets."""
    shape = F.abs if absolute else (lambda c: c)
    rows = errors if horizon_limit is None else errors.where(F.col("step") <= horizon_limit)
    rows = rows.select("feat", E.hour_of_day(t).alias("hour"), E.day_of_year(t).alias("day"),
                       shape(F.col("err_state")).alias("s"), shape(F.col("err_res")).alias("r"))
    sets = [[F.col("hour"), F.col("feat")], [F.col("day"), F.col("feat")]]
    out = rows.groupingSets(sets, "hour", "day", "feat").agg(
        F.sum("s").alias("sum_state"), F.sum("r").alias("sum_res"), F.count(F.lit(1)).alias("n"),
        F.grouping("hour").alias("_no_hour"))
    axis = F.when(F.col("_no_hour") == 0, "hour").otherwise("day")
    return out.select(axis.alias("axis"), F.coalesce("hour", "day").alias("bin"), "feat", "sum_state", "sum_res", "n")


def sample_means(errors: DataFrame, sample: Sequence[str] = SAMPLE, absolute: bool = False) -> DataFrame:
    """Mean error of each sample over its steps."""
    shape = F.abs if absolute else (lambda c: c)
    return errors.groupBy(*sample, "feat").agg(
        F.avg(shape(F.col("err_state"))).alias("state"), F.avg(shape(F.col("err_res"))).alias("res"))


def error_by_class(errors: DataFrame, static: DataFrame, sample: Sequence[str] = SAMPLE, absolute: bool = False,
                   keys: Sequence[str] = PIXEL, classes: Sequence[str] = ("int_veg", "int_soil")) -> DataFrame:
    """Sums, counts and mean of the sample-mean error by vegetation and soil class."""
    means = sample_means(errors, sample, absolute)
    # Pixels are reduced before the classes are attached, so the join carries one row per pixel and feature.
    per_pixel = means.groupBy(*keys, "feat").agg(
        F.sum("state").alias("state"), F.sum("res").alias("res"), F.count(F.lit(1)).alias("n"))
    out = per_pixel.join(static.select(*keys, *classes), list(keys)).groupBy(*classes, "feat").agg(
        F.sum("state").alias("sum_state"), F.sum("res").alias("sum_res"), F.sum("n").alias("n"))
    return out.withColumns({"mean_state": E.ratio("sum_state", "n"), "mean_res": E.ratio("sum_res", "n")})


# --- joint histograms -----------------------------------------------------------------------------

def joint_histogram(df: DataFrame, ax1: Axis, ax2: Axis, covariate: str | None = None, absolute: bool = False,
                    by: Sequence[str] = ()) -> DataFrame:
    """Sparse 2-D histogram over two SQL expressions, with the sum and mean of a covariate per cell.

    Rows where an axis is null or NaN are left out. `absolute` takes the magnitude of err_state and err_res
    wherever they are used.
    """
    if absolute:
        df = df.withColumns({c: F.abs(c) for c in ("err_state", "err_res") if c in df.columns})
    def binned(axis):
        expression, lo, hi, n = axis
        return E.bin_index(F.expr(expression), lo, hi, n)
    rows = df.select(*by, binned(ax1).alias("b1"), binned(ax2).alias("b2"),
                     *([F.expr(covariate).cast("double").alias("c")] if covariate else []))
    rows = rows.where("b1 IS NOT NULL AND b2 IS NOT NULL")
    aggs = [F.count(F.lit(1)).alias("n")]
    if covariate:
        aggs += [F.sum("c").alias("cov_sum"), F.avg("c").alias("cov_mean")]
    return rows.groupBy(*by, "b1", "b2").agg(*aggs)


def histogram_nd(df: DataFrame, axes: Sequence[Axis], by: Sequence[str] = ()) -> DataFrame:
    """Sparse n-D histogram; bin columns are b1, b2, ..."""
    names = [f"b{i}" for i in range(1, len(axes) + 1)]
    rows = df.select(*by, *[
        E.bin_index(F.expr(e), lo, hi, n).alias(b) for b, (e, lo, hi, n) in zip(names, axes)])
    return rows.dropna(subset=names).groupBy(*by, *names).agg(F.count(F.lit(1)).alias("n"))


# --- efficiency -----------------------------------------------------------------------------------

def _efficiency(y: str, p: str, prefix: str) -> list[Column]:
    """Per-sequence metrics of prediction p for truth y; null where y is constant."""
    yc, pc = F.col(y), F.col(p)
    e = pc - yc
    mse = F.avg(e * e)
    idle = F.max(yc) == F.min(yc)
    flat = F.max(pc) == F.min(pc)
    # Not `corr`, which raises in ANSI mode where either side is constant.
    r = E.ratio(F.covar_pop(yc, pc), F.stddev_pop(yc) * F.stddev_pop(pc))
    cc = F.when(idle, None).when(flat, F.lit(0.0)).otherwise(r)
    alpha = E.ratio(F.stddev_pop(pc), F.stddev_pop(yc))
    beta = E.ratio(F.avg(pc), F.avg(yc))
    kge = 1 - F.sqrt(F.pow(cc - 1, 2) + F.pow(alpha - 1, 2) + F.pow(beta - 1, 2))
    nse = F.when(~idle, 1 - E.ratio(mse, F.var_pop(yc)))
    return [
        F.avg(F.abs(e)).alias(f"{prefix}_mae"), mse.alias(f"{prefix}_mse"), cc.alias(f"{prefix}_cc"),
        nse.alias(f"{prefix}_nse"), E.ratio(F.lit(1.0), 2 - nse).alias(f"{prefix}_nnse"),
        F.when(~idle, kge).alias(f"{prefix}_kge"), idle.alias(f"{prefix}_idle"),
    ]


METRICS = ("mae", "mse", "cc", "nse", "nnse", "kge")


def sequence_efficiency(errors: DataFrame, sample: Sequence[str] = SAMPLE) -> DataFrame:
    """MAE, MSE, correlation, NSE, NNSE and KGE of state (s_) and increment (r_) for each sequence."""
    return errors.groupBy(*sample, "feat").agg(
        *_efficiency("true_state", "pred_state", "s"), *_efficiency("true_res", "pred_res", "r"))


def efficiency_moments(by: Sequence[str] = ("feat",)) -> Moments:
    return Moments(list(by), {f"{p}_{m}": F.col(f"{p}_{m}") for p in ("s", "r") for m in METRICS})


def efficiency_summary(sequences: DataFrame, by: Sequence[str] = ("feat",)) -> DataFrame:
    """Mean and variance over sequences, with the number of constant ones left out; RMSE is sqrt(mean MSE)."""
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if("s_idle").alias("s_dropped"),
            F.count_if("r_idle").alias("r_dropped")]
    for p in ("s", "r"):
        for m in METRICS:
            aggs += [F.avg(f"{p}_{m}").alias(f"{p}_{m}_mean"), F.var_pop(f"{p}_{m}").alias(f"{p}_{m}_var")]
    out = sequences.groupBy(*by).agg(*aggs)
    return out.withColumns({f"{p}_rmse": F.sqrt(f"{p}_mse_mean") for p in ("s", "r")})


# --- statistics along chosen axes -----------------------------------------------------------------

AXIS_SETS = {
    "all": ("init", *PIXEL, "step"),
    "pixel": PIXEL,
    "init": ("init",),
    "pixel_step": (*PIXEL, "step"),
    "init_pixel": ("init", *PIXEL),
}


def grid_stats_axes(errors: DataFrame, values: Mapping[str, str], keep: Sequence[str] | None = None,
                    sets: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Mean and variance of any values, keeping chosen axes out of init, pixel and step.

    `keep` gives one set of axes; `sets` gives several by name, from one read of the rows with grouping sets; only the columns that the
    values need are copied for each set.
    """
    m = Moments([], {n: F.expr(e) for n, e in values.items()})
    if sets is None:
        return m.finish(errors.groupBy(*keep, "feat").agg(*m.aggregates()))
    axes = list(dict.fromkeys(a for s in sets.values() for a in s))
    rows = errors.select(*axes, "feat", *[F.expr(e).cast("double").alias(f"_v_{n}") for n, e in values.items()])
    copied = Moments([], {n: F.col(f"_v_{n}") for n in values})
    partial = rows.groupingSets([[*map(F.col, s), F.col("feat")] for s in sets.values()], *axes, "feat").agg(
        *copied.aggregates(), *[F.grouping(a).alias(f"_g_{a}") for a in axes])
    label = F.lit(None).cast("string")
    for name, s in sets.items():
        label = F.when(E.all_of([F.col(f"_g_{a}") == (0 if a in s else 1) for a in axes]), F.lit(name)).otherwise(label)
    return m.finish(partial.withColumn("kept", label).drop(*[f"_g_{a}" for a in axes]))


def grid_error_stats(errors: DataFrame, by: Sequence[str] = ("init", *PIXEL)) -> DataFrame:
    """Eleven error statistics per init time, pixel and feature."""
    es, er = F.abs("err_state"), F.abs("err_res")
    state = dict(zip((*METRICS, "idle"), _efficiency("true_state", "pred_state", "s")))
    res = dict(zip((*METRICS, "idle"), _efficiency("true_res", "pred_res", "r")))
    return errors.groupBy(*by, "feat").agg(
        F.max(es).alias("state_error_max"), F.avg(es).alias("state_error_mean"),
        F.stddev_pop(es).alias("state_error_stdev"),
        state["kge"].alias("state_kge"), state["cc"].alias("state_pearson"),
        F.max_by("err_state", "step").alias("state_bias_final"),
        F.max(er).alias("res_error_max"), F.avg(er).alias("res_error_mean"),
        F.stddev_pop(er).alias("res_error_stdev"),
        res["kge"].alias("res_kge"), res["cc"].alias("res_pearson"))


# --- losses ---------------------------------------------------------------------------------------

def residual_loss(errors: DataFrame, ratio: float = 0.5, norm: Mapping[str, float] | None = None,
                  magnitude_bias: float = 0.0, use_mse: bool = False, ignore_constant: bool = False,
                  epsilon: float = 1e-8, literal_constant: bool = False, sample: Sequence[str] = SAMPLE) -> DataFrame:
    """ratio * weighted increment loss + (1 - ratio) * state loss, as a score over all rows.

    Each (sample, step) has one weight, the sum over features of 1 + bias * |true increment|, and one
    increment loss, the mean over features of the scaled error. `literal_constant` takes any increment below
    epsilon, falling ones too, as no change.
    """
    per_step = _step_losses(errors, norm, use_mse, sample, (1 + F.lit(magnitude_bias) * F.abs("true_res")))
    if ignore_constant:
        moved = F.col("_rise") if literal_constant else F.col("_change")
        per_step = per_step.withColumn("_w", F.when(moved < F.lit(epsilon), F.lit(0.0)).otherwise(F.col("_w")))
    out = per_step.agg(
        F.avg(F.col("_r") * F.col("_w")).alias("residual_loss"),
        E.ratio(F.sum("_s"), F.sum("_n")).alias("state_loss"))
    return out.withColumn(
        "loss", F.col("residual_loss") * F.lit(ratio) + F.col("state_loss") * F.lit(1 - ratio))


def snow_loss(errors: DataFrame, zero_point: float = 0.0, norm: Mapping[str, float] | None = None,
              magnitude_bias: float = 0.0, use_mse: bool = False, epsilon: float = 1e-4,
              sample: Sequence[str] = SAMPLE) -> DataFrame:
    """Increment loss that ignores a negative guess where the true state and increment are zero."""
    per_feat = 1 + F.lit(magnitude_bias) * F.abs("true_res")
    per_step = _step_losses(errors, norm, use_mse, sample, per_feat, weight_by_norm=True, zero_point=zero_point,
                            epsilon=epsilon)
    weight = F.when(F.col("_quiet"), F.lit(0.0)).otherwise(F.col("_w"))
    return per_step.agg(F.avg(F.col("_r") * weight).alias("loss"), F.count_if("_quiet").alias("n_ignored"))


def _step_losses(errors, norm, use_mse, sample, weight, weight_by_norm=False, zero_point=0.0, epsilon=1e-4):
    shape = (lambda c: c * c) if use_mse else F.abs
    scale = F.lit(1.0)
    for feat, value in (norm or {}).items():
        scale = F.when(F.col("feat") == feat, F.lit(float(value))).otherwise(scale)
    state = F.col("pred_state") - F.col("true_state")
    quiet = (
        (F.col("true_res") == 0) & (F.col("true_state") - F.lit(zero_point) < F.lit(epsilon)) & (F.col("pred_res") < 0))
    return errors.groupBy(*sample, "step").agg(
        F.avg(shape((F.col("pred_res") - F.col("true_res")) / scale)).alias("_r"),
        F.sum(weight / scale if weight_by_norm else weight).alias("_w"),
        F.sum(shape(state)).alias("_s"), F.count(F.lit(1)).alias("_n"),
        F.max(F.abs("true_res")).alias("_change"), F.max("true_res").alias("_rise"), F.every(quiet).alias("_quiet"))
