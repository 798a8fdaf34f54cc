"""Evaluators by name, all reading one table of scored rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import PIXEL
from ..functions.expressions import ratio
from ..operators import presets, verification
from ..operators.verification import SAMPLE, Axis, Moments, Tally


@dataclass(frozen=True)
class Histogram:
    """A joint histogram of the user's own: axes (SQL expression, low, high, bins), and what is summed in each cell.

    Expressions read the error columns, `feat`, `step`, `t`, the plan's `inputs` and the columns of the static table named in
    `static`. `where` selects rows, for instance those of one feature. `absolute` takes errors as magnitudes.
    """

    ax1: Axis
    ax2: Axis
    covariate: str | None = None
    static: Sequence[str] = ()
    where: str | None = None
    absolute: bool = False


@dataclass(frozen=True)
class Evaluation:
    """What the evaluators need besides the scored rows. `histograms` adds evaluators by name."""

    static: DataFrame
    feat: str
    sample: Sequence[str] = SAMPLE
    absolute: bool = False
    bins: int = 128
    horizon_limit: int | None = None
    axes: Mapping[str, str] | None = None
    coarseness: int = 1
    histograms: Mapping[str, Histogram] = field(default_factory=dict)
    keys: Sequence[str] = PIXEL


def _histogram_rows(errors: DataFrame, h: Histogram, e: Evaluation) -> DataFrame:
    """The rows of a histogram with the static columns it reads, one row a pixel in the join."""
    rows = errors if h.where is None else errors.where(h.where)
    if h.static:
        rows = rows.join(e.static.select(*e.keys, *h.static), list(e.keys))
    return rows.withColumns({c: F.abs(c) for c in ("err_state", "err_res")}) if h.absolute or e.absolute else rows


def _preset(name: str) -> Callable[[DataFrame, Evaluation], DataFrame]:
    return lambda errors, e: presets.hist_preset(errors, name, e.feat, e.bins, e.absolute)


PRESETS = ("true-pred", "saturation-error", "infiltration", "state-increment", "humidity-temp", "snow-temp", "snow-increment")
EVALUATORS: dict[str, Callable[[DataFrame, Evaluation], DataFrame]] = {
    "horizon": lambda errors, e: verification.error_by_horizon(errors, e.coarseness),
    "temporal": lambda errors, e: verification.error_by_time(
        errors, horizon_limit=e.horizon_limit, absolute=e.absolute),
    "static-combos": lambda errors, e: verification.error_by_class(errors, e.static, e.sample, e.absolute),
    "efficiency": lambda errors, e: verification.efficiency_summary(
        verification.sequence_efficiency(errors, e.sample)),
    "grid-axes": lambda errors, e: verification.grid_stats_axes(
        errors, e.axes or {"err_state": "err_state"}, sets=verification.AXIS_SETS),
    "grid-errors": lambda errors, e: verification.grid_error_stats(errors, e.sample),
    **{f"hist-{name}": _preset(name) for name in PRESETS},
}


def _check(names: Sequence[str], setup: Evaluation) -> None:
    known = {*EVALUATORS, *setup.histograms}
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown evaluators {unknown}; choose from {sorted(known)}")


def _own_histogram(errors: DataFrame, h: Histogram, e: Evaluation) -> DataFrame:
    return verification.joint_histogram(_histogram_rows(errors, h, e), h.ax1, h.ax2, h.covariate)


def evaluate(errors: DataFrame, names: Sequence[str], setup: Evaluation) -> dict[str, DataFrame]:
    """Results of the named evaluators; an unknown name is an error before any job."""
    if setup is not None:
        _check(names, setup)
    elif any(n not in EVALUATORS for n in names):
        raise ValueError(f"unknown evaluators among {list(names)}; choose from {sorted(EVALUATORS)}")
    return {n: _own_histogram(errors, setup.histograms[n], setup) if n in setup.histograms else EVALUATORS[n](errors, setup) for n in names}


# --- several parts of the rows at once ------------------------------------------------------------

@dataclass(frozen=True)
class Mergeable:
    """An evaluator as partials by part of the rows: what is kept, of which rows, and how merged partials become the result."""

    kept: Moments | Tally
    rows: Callable[[DataFrame], DataFrame]
    result: Callable[[DataFrame], DataFrame]


def mergeable(name: str, setup: Evaluation, by: str) -> Mergeable | None:
    """The evaluator as partials by column `by`, or None if its results do not add."""
    if name == "horizon":
        m = verification.horizon_moments([by])
        return Mergeable(m, lambda rows: rows, lambda p: m.finish(p).withColumn("forecast_hour", verification.step_hour("step", setup.coarseness)))
    if name == "temporal":
        return Mergeable(verification.time_tally(horizon_limit=setup.horizon_limit, absolute=setup.absolute, by=[by]), lambda rows: rows, lambda p: p)
    if name in setup.histograms:
        h = setup.histograms[name]
    elif name.removeprefix("hist-") in PRESETS:
        h = Histogram(**presets.preset(name.removeprefix("hist-"), setup.feat, setup.bins), where=f"feat = '{setup.feat}'")
    else:
        return None
    tally = verification.histogram_tally(h.ax1, h.ax2, h.covariate, [by])
    if not h.covariate:
        return Mergeable(tally, lambda rows: _histogram_rows(rows, h, setup), lambda p: p)
    # The mean is over rows with a covariate, so these are counted too.
    told = Tally(tally.keys, ("cov", "has"), lambda rows: tally.prepare(rows).withColumn("has", F.col("cov").isNotNull().cast("int")))

    def result(p: DataFrame) -> DataFrame:
        return p.select(*[k for k in tally.keys if k in p.columns], "n", F.col("sum_cov").alias("cov_sum"), ratio("sum_cov", "sum_has").alias("cov_mean"))
    return Mergeable(told, lambda rows: _histogram_rows(rows, h, setup), result)


def evaluate_parts(errors: DataFrame, names: Sequence[str], setup: Evaluation, by: str, parts: Sequence[str], total: str = "all",
                   store: Callable[[DataFrame], DataFrame] = lambda p: p) -> dict[str, dict[str, DataFrame]]:
    """Results of each part of the rows, told by column `by`, and of all: evaluator -> part or `total` -> result.

    Evaluators whose partials add read the rows once for all parts and the total, which is their sum; `store` keeps the partials.
    Others read each part and then all rows.
    """
    _check(names, setup)
    out: dict[str, dict[str, DataFrame]] = {}
    for name in names:
        how = mergeable(name, setup, by)
        if how is None:
            out[name] = {p: evaluate(errors.where(F.col(by) == p), [name], setup)[name] for p in parts}
            out[name][total] = evaluate(errors, [name], setup)[name]
            continue
        partials = store(how.kept.partial(how.rows(errors)))
        rest = [k for k in how.kept.keys if k != by]
        out[name] = {p: how.result(partials.where(F.col(by) == p).drop(by)) for p in parts}
        out[name][total] = how.result(how.kept.merge(partials, by=rest))
    return out
