"""Cutting series into samples: windows, horizons, batches, partitions and splits.

A row finds the samples it belongs to by arithmetic on its step, so building samples takes one exchange by
(pixel, sample) and no join with a list of windows. Groups hold exactly one sample, never a whole series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import PIXEL
from ..functions import expressions as E
from .blocks import along_blocks, numbered_in_chunks


def _floor_div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b))


def _explode_range(df: DataFrame, first: Column, last: Column, out: str) -> DataFrame:
    steps = F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint")))
    return df.withColumn(out, F.explode(steps))


def _each_once(steps: str, n: int) -> Column:
    """Whether an array holds n values, all different."""
    return (F.size(steps) == n) & (F.size(F.array_distinct(steps)) == n)


# --- samples at common init times -----------------------------------------------------------------

def sample_count(first: int, final: int, frequency: int) -> int:
    """Number of init times in [first, final); one if the span is no longer than the frequency."""
    span = final - first
    return 1 if span <= frequency else span // frequency


def grid_sample_rows(df: DataFrame, window: int, horizon: int, frequency: int, first: int, final: int | None = None,
                     keys: Sequence[str] = PIXEL, step: str = "step", complete: bool = True) -> DataFrame:
    """Long form of samples at common init times: adds `init` (sample number) and `lead`.

    `first` is the step of the first predicted value. `lead` counts predicted steps from 1; lead 0 is the
    last observed state and the window reaches back to lead 1 - window. Samples that do not hold every lead
    exactly once are dropped.
    """
    s = F.col(step)
    lo = F.greatest(F.lit(0), F.ceil((s - F.lit(first + horizon - 1)) / F.lit(frequency)))
    hi = _floor_div(s - F.lit(first - window), frequency)
    if final is not None:
        hi = F.least(hi, F.lit(sample_count(first, final, frequency) - 1))
    out = _explode_range(df, lo, hi, "init")
    out = out.withColumn("lead", (s - F.lit(first) - F.col("init") * frequency + 1).cast("int")).withColumn(
        "init", F.col("init").cast("int"))
    if not complete:
        return out
    # Ordered like the windows that follow, so that one sort serves them all.
    whole = Window.partitionBy(*keys, "init").orderBy("lead").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.partitionBy(*keys, "init").orderBy("lead")
    out = out.withColumn("_jump", F.col("lead") - F.lag("lead").over(order) != 1)
    out = out.withColumns({"_n": F.count(F.lit(1)).over(whole), "_jumps": F.count_if("_jump").over(whole)})
    return out.where((F.col("_n") == window + horizon) & (F.col("_jumps") == 0)).drop("_n", "_jump", "_jumps")


def long_labels(rows: DataFrame, feats: Sequence[str], keys: Sequence[str] = PIXEL, carry: Sequence[str] = ()
                ) -> DataFrame:
    """From sample rows (lead >= 0) to (sample, step, feat, true_prev, true_state) rows, still one exchange."""
    order = Window.partitionBy(*keys, "init").orderBy("lead")
    cols = {f"_prev_{f}": F.lag(f).over(order) for f in feats}
    wide = rows.where("lead >= 0").withColumns(cols).where("lead >= 1")
    triples = ", ".join(f"'{f}', CAST(`_prev_{f}` AS DOUBLE), CAST(`{f}` AS DOUBLE)" for f in feats)
    return wide.select(
        *keys, "init", F.col("lead").alias("step"), *carry,
        F.expr(f"stack({len(feats)}, {triples}) AS (feat, true_prev, true_state)"))


# --- samples per pixel with random offsets --------------------------------------------------------

#: Sample starts listed by one row at a time.
STARTS_TOGETHER = 4096


@dataclass(frozen=True)
class SampleSpec:
    """What a sample holds and where samples start."""

    window: int
    horizon: int
    window_feats: Sequence[str]
    horizon_feats: Sequence[str]
    pred_feats: Sequence[str]
    static_feats: Sequence[str] = ()
    static_int: Mapping[str, int] = field(default_factory=dict)
    separation: int = 1
    max_offset: int = 0
    include_init: bool = True
    seed: int = 0

    @property
    def length(self) -> int:
        return self.window + self.horizon


def _offset(spec: SampleSpec, keys: Sequence[str]) -> Column:
    if spec.max_offset <= 0:
        return F.lit(0).cast("bigint")
    return F.pmod(E.hash_int(spec.seed, *keys), F.lit(spec.max_offset))


def sample_starts(df: DataFrame, spec: SampleSpec, keys: Sequence[str] = PIXEL, step: str = "step") -> DataFrame:
    """All sample starts: per pixel an offset from its hash, then one start every `separation` steps.

    Reads only keys and step. Limit this table (`selection.limit_per_block`) before cutting the samples.
    """
    lengths = df.groupBy(*keys).agg((F.max(step) + 1).alias("_len"))
    room = _floor_div(F.col("_len") - F.lit(spec.length + spec.max_offset), spec.separation)
    # In two steps, so that no row holds all starts of a long series at once.
    parts = _explode_range(lengths, F.lit(0), _floor_div(room - 1, STARTS_TOGETHER), "_part").repartition(*keys, "_part")
    low = F.col("_part") * STARTS_TOGETHER
    starts = _explode_range(parts, low, F.least(low + (STARTS_TOGETHER - 1), room - 1), "sample")
    return starts.select(
        *keys, "sample", (F.col("sample") * spec.separation + _offset(spec, keys)).cast("bigint").alias("start"))


def cut_samples(df: DataFrame, starts: DataFrame, spec: SampleSpec, keys: Sequence[str] = PIXEL, step: str = "step"
                ) -> DataFrame:
    """Long form of the chosen samples: adds `sample` and `pos` (0 is the first window step)."""
    s, off = F.col(step), _offset(spec, keys)
    lo = F.greatest(F.lit(0), F.ceil((s - off - F.lit(spec.length - 1)) / F.lit(spec.separation)))
    hi = _floor_div(s - off, spec.separation)
    rows = _explode_range(df, lo, hi, "sample")
    chosen = starts.select(*keys, "sample", "start")
    return rows.join(chosen, [*keys, "sample"]).withColumn("pos", (s - F.col("start")).cast("int"))


def cut_all_samples(df: DataFrame, spec: SampleSpec, keys: Sequence[str] = PIXEL, step: str = "step") -> DataFrame:
    """`cut_samples` of all starts, without a list of them.

    A row finds its samples by arithmetic, and the pixel's length tells which of them end inside the series. Both the length and
    its join keep the pixel, so that a table laid out by pixel needs no exchange; on other tables adaptive execution splits a hot
    pixel in the join.
    """
    lengths = df.groupBy(*keys).agg((F.max(step) + 1).alias("_len"))
    s, off = F.col(step), _offset(spec, keys)
    room = _floor_div(F.col("_len") - F.lit(spec.length + spec.max_offset), spec.separation)
    lo = F.greatest(F.lit(0), F.ceil((s - off - F.lit(spec.length - 1)) / F.lit(spec.separation)))
    hi = F.least(_floor_div(s - off, spec.separation), room - 1)
    rows = _explode_range(df.join(lengths, list(keys)), lo, hi, "sample").drop("_len")
    start = (F.col("sample") * spec.separation + off).cast("bigint")
    return rows.withColumn("start", start).withColumn("pos", (s - F.col("start")).cast("int"))


def to_arrays(rows: DataFrame, spec: SampleSpec, by: Sequence[str], static: DataFrame | None = None,
              static_keys: Sequence[str] = PIXEL, t: str = "t") -> DataFrame:
    """One row per sample with ordered window, horizon, pred and time arrays.

    Samples that do not hold every position exactly once are dropped.
    """
    def part(feats, condition):
        element = F.struct("pos", *[F.col(f).cast("double").alias(f) for f in feats])
        ordered = F.array_sort(F.collect_list(F.when(condition, element)))
        return F.transform(ordered, lambda e: F.struct(*[e[f].alias(f) for f in feats]))
    pos, w = F.col("pos"), spec.window
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.size(F.collect_set("pos")).alias("_places"),
        part(spec.window_feats, pos < w).alias("window"),
        part(spec.horizon_feats, pos >= w).alias("horizon"),
        part(spec.pred_feats, pos >= w - int(spec.include_init)).alias("pred"),
        F.array_sort(F.collect_list(t)).alias("time"),
    ).where((F.col("_n") == spec.length) & (F.col("_places") == spec.length)).drop("_n", "_places")
    if static is None:
        return out
    pixels = static.select(
        *static_keys,
        F.struct(*[F.col(f) for f in spec.static_feats]).alias("static"),
        (E.one_hot(*[(F.col(c), n) for c, n in spec.static_int.items()]) if spec.static_int
         else F.array().cast("array<int>")).alias("static_int"))
    return out.join(pixels, list(static_keys))


def make_samples(df: DataFrame, static: DataFrame, spec: SampleSpec, keys: Sequence[str] = PIXEL, step: str = "step",
                 limit: tuple[Sequence[str], int] | None = None, in_place: bool = False) -> DataFrame:
    """Array-form samples of all pixels in `static`; `limit` = (block columns, k) keeps k samples per block.

    `in_place` takes all samples without listing starts, for tables laid out by pixel (`sources.layout`).
    """
    from .selection import limit_per_block
    if in_place:
        if limit is not None:
            raise ValueError("a limit needs the list of starts")
        rows = cut_all_samples(df.join(static.select(*keys), list(keys), "left_semi"), spec, keys, step)
        return to_arrays(rows, spec, [*keys, "sample"], static, keys)
    starts = sample_starts(df, spec, keys, step).join(static.select(*keys), list(keys), "left_semi")
    if limit is not None:
        block, k = limit
        starts = limit_per_block(starts, block, k, spec.seed, [*keys, "sample"])
    rows = cut_samples(df, starts, spec, keys, step)
    return to_arrays(rows, spec, [*keys, "sample"], static, keys)


def to_long(samples: DataFrame, by: Sequence[str], part: str = "horizon") -> DataFrame:
    """Array-form samples back to one row per step."""
    return samples.select(*by, F.posexplode(part).alias("pos", "_e")).select(*by, "pos", "_e.*")


# --- windows along a series -----------------------------------------------------------------------

def sliding_windows(df: DataFrame, n: int, feats: Sequence[str], keys: Sequence[str] = PIXEL, step: str = "step",
                    out: str = "window") -> DataFrame:
    """Look-back window of n adjacent steps ending at every step that has one; none spans a gap or a repeated step."""
    def build(w):
        return F.collect_list(F.struct(*feats)).over(w.rowsBetween(-(n - 1), 0))
    return along_blocks(df, keys, step, {out: build}, before=n - 1, whole="_whole").where("_whole").drop("_whole")


def window_target(df: DataFrame, look_back: int, look_forward: int, feats: Sequence[str], target: str,
                  keys: Sequence[str] = PIXEL, step: str = "step", difference: bool = False) -> DataFrame:
    """Look-back window with the following `look_forward` values, or their increments, as target array.

    All steps of window and target are adjacent; none spans a gap or a repeated step.
    """
    value = F.col(target).cast("double")
    columns = {
        "window": lambda w: F.collect_list(F.struct(*feats)).over(w.rowsBetween(-(look_back - 1), 0)),
        "_ahead": lambda w: F.collect_list(value).over(w.rowsBetween(0 if difference else 1, look_forward)),
    }
    out = along_blocks(df, keys, step, columns, before=look_back - 1, after=look_forward, whole="_whole")
    goal = E.increments("_ahead") if difference else F.col("_ahead")
    return (
        out.where("_whole").withColumn("target", goal).drop("_ahead", "_whole")
    )


def increments(df: DataFrame, feat: str, keys: Sequence[str] = PIXEL, step: str = "step", out: str | None = None
               ) -> DataFrame:
    """Forward difference to the next step; null where that step or this one is missing or repeated."""
    name = out or f"res_{feat}"
    ahead = along_blocks(df, keys, step, {name: lambda w: F.lead(feat).over(w) - F.col(feat)}, after=1, whole="_whole")
    return ahead.withColumn(name, F.when(F.col("_whole"), F.col(name))).drop("_whole")


def accumulate(df: DataFrame, increment: str, initial: str, by: Sequence[str], step: str = "step",
               out: str = "state") -> DataFrame:
    """Running sum of increments from the initial state of each sample."""
    w = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.first(initial).over(w) + F.sum(increment).over(w))


# --- batches, partitions, cycles ------------------------------------------------------------------

def series_batches(df: DataFrame, frequency: int, steps: int, first: int, final: int, feats: Sequence[str],
                   include_residual: bool = True, keys: Sequence[str] = PIXEL, step: str = "step") -> DataFrame:
    """Time-ordered batches of `steps` steps, one every `frequency` steps of [first, final].

    Batches without every step exactly once, such as the short last one, are kept only with `include_residual`.
    """
    s = F.col(step)
    inside = df.where(s.between(first, final))
    lo = F.greatest(F.lit(0), F.ceil((s - F.lit(first + steps - 1)) / F.lit(frequency)))
    rows = _explode_range(inside, lo, _floor_div(s - F.lit(first), frequency), "batch")
    element = F.struct(step, *feats)
    out = rows.groupBy("batch", *keys).agg(F.array_sort(F.collect_list(element)).alias("rows"))
    return out if include_residual else out.where(_each_once(f"rows.{step}", steps))


def partition_sequences(df: DataFrame, n: int, pivot: int, feats: Sequence[str], keys: Sequence[str] = PIXEL,
                        step: str = "step", t: str = "t") -> DataFrame:
    """Non-overlapping n-step samples with the time at the pivot position.

    The tail is dropped, and so is every sample that does not hold each step exactly once.
    """
    at_pivot = F.max(F.when(F.pmod(F.col(step), F.lit(n)) == pivot, F.col(t)))
    return (
        df.withColumn("seq", _floor_div(F.col(step), n))
        .groupBy(*keys, "seq")
        .agg(F.array_sort(F.collect_list(F.struct(step, *feats))).alias("rows"), at_pivot.alias("pivot_time"))
        .where(_each_once(f"rows.{step}", n))
    )


def cycle_role(step: Column, train: int, validate: int, test: int, window: int) -> Column:
    """Role of a step in its train/validate/test cycle; lead-in steps of each span have none."""
    at = F.pmod(step, F.lit(3 * window + train + validate + test))
    a, b, c = window, 2 * window + train, 3 * window + train + validate
    return (
        F.when((at >= a) & (at < a + train), "train")
        .when((at >= b) & (at < b + validate), "validate")
        .when((at >= c) & (at < c + test), "test")
    )


def cycle_split(df: DataFrame, train: int, validate: int, test: int, window: int, cycles: int, feats: Sequence[str],
                keys: Sequence[str] = PIXEL, step: str = "step") -> DataFrame:
    """Targets of repeating train/validate/test spans with the window of adjacent steps before each target."""
    size = 3 * window + train + validate + test
    out = along_blocks(
        df.where(F.col(step) < cycles * size), keys, step,
        {"window": lambda w: F.collect_list(F.struct(*feats)).over(w.rowsBetween(-window, -1))}, before=window, whole="_whole")
    return (
        out.withColumn("role", cycle_role(F.col(step), train, validate, test, window))
        .withColumn("cycle", _floor_div(F.col(step), size))
        .where(F.col("role").isNotNull() & F.col("_whole")).drop("_whole")
    )


# --- splits ---------------------------------------------------------------------------------------

def split_train_val(df: DataFrame, block: Sequence[str], chunk: str, frequency: int, seed: int | str) -> DataFrame:
    """Adds `split`: every `frequency`-th chunk of a block in shuffled order validates, the others train.

    The shuffled order is numbered by hash prefix, so even a block with most of the chunks is not gathered.
    """
    chunks = (
        df.select(*block, chunk).distinct()
        .withColumn("_h", E.hash_order(seed, *block, chunk)).withColumn("_prefix", F.substring("_h", 1, 2))
    )
    order = numbered_in_chunks(chunks, list(block), "_prefix", ["_h", chunk], "_rn")
    on = F.pmod(F.col("_rn") - 1, F.lit(frequency)) == 0
    roles = order.select(*block, chunk, F.when(on, "validate").otherwise("train").alias("split"))
    return df.join(roles, [*block, chunk])


def random_split(df: DataFrame, p: float, seed: int | str, keys: Sequence[str]) -> DataFrame:
    """Adds `split`: each sample trains with probability p, decided by its hash."""
    return df.withColumn(
        "split", F.when(E.hash_uniform(seed, *keys) < F.lit(float(p)), "train").otherwise("validate"))


def period_split(df: DataFrame, train: tuple[str, str], validate: tuple[str, str], t: str = "t") -> DataFrame:
    """Adds `split` by two separate half-open periods; rows in neither are dropped."""
    def inside(period):
        lo, hi = (F.lit(b).cast("timestamp") for b in period)
        return (F.col(t) >= lo) & (F.col(t) < hi)
    role = F.when(inside(train), "train").when(inside(validate), "validate")
    return df.withColumn("split", role).where(F.col("split").isNotNull())


# --- prediction resolution ------------------------------------------------------------------------

def coarsen_pred(df: DataFrame, c: int, step: str = "step", include_init: bool = True) -> DataFrame:
    """Every c-th step: from offset 0 when step 0 is the initial state, else from c - 1."""
    return df.where(F.pmod(F.col(step), F.lit(c)) == (0 if include_init else c - 1))


def coarsen_horizon(df: DataFrame, c: int, feats: Sequence[str], by: Sequence[str], how: str = "mean",
                    step: str = "step") -> DataFrame:
    """Reduce the inputs of c steps (numbered from 1) to one coarse step; a short last block is dropped, as in `block_reduce`."""
    reduce = {"min": F.min, "max": F.max, "mean": F.avg}[how]
    block = F.ceil(F.col(step) / F.lit(c)).cast("int").alias(step)
    blocks = df.groupBy(*by, block).agg(F.count(F.lit(1)).alias("_n"), *[reduce(f).alias(f) for f in feats])
    return blocks.where(F.col("_n") == c).drop("_n")


def alt_source(samples: DataFrame, feats: Sequence[str], horizon: str = "horizon", pred: str = "pred") -> DataFrame:
    """Horizon features that only the labels hold: label i + 1 belongs to horizon step i."""
    def fill(h, i):
        for f in feats:
            h = h.withField(f, F.get(F.col(pred), i + 1)[f])
        return h
    return samples.withColumn(horizon, F.transform(horizon, fill))
