"""Batch scoring of samples: any array function or ONNX model, applied partition by partition.

Array parts travel as flat lists of doubles in Arrow batches, so a batch becomes a dense tensor by a reshape.
A predictor is made once per partition by its factory and maps
(window [B, Sw, Fw], horizon [B, Sh, Fh], static [B, Fs], static_int [B, Fi]) to increments [B, Sh, Fp].
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tasks carry these small helpers with them, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Factory = Callable[[], Callable]


@dataclass(frozen=True)
class Parts:
    """Feature names of each part of a sample, in predictor order."""

    window: Sequence[str]
    horizon: Sequence[str]
    pred: Sequence[str]
    static: Sequence[str] = ()


@dataclass(frozen=True)
class Scaling:
    """(mean, std) per feature for inputs and outputs; a missing feature is not scaled."""

    coeffs: Mapping[str, tuple[float, float]] = field(default_factory=dict)

    def arrays(self, feats: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        pairs = [self.coeffs.get(f, (0.0, 1.0)) for f in feats]
        return np.array([m for m, _ in pairs], dtype=float), np.array([s for _, s in pairs], dtype=float)


def _flat(part: str, feats: Sequence[str]) -> Column:
    return F.flatten(F.transform(part, lambda e: F.array(*[e[f].cast("double") for f in feats])))


def _tensor(batch: pa.RecordBatch, name: str, features: int) -> np.ndarray:
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1, features) if features else np.zeros((batch.num_rows, 0, 0))


def _lists(values: np.ndarray) -> pa.Array:
    rows = values.reshape(values.shape[0], -1)
    offsets = np.arange(rows.shape[0] + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel(), pa.float64()))


def _inputs(samples: DataFrame, keys: Sequence[str], parts: Parts, extra: Sequence[Column] = ()) -> DataFrame:
    statics = F.array(*[F.col(f"static.{f}").cast("double") for f in parts.static]) if parts.static \
        else F.array().cast("array<double>")
    onehot = F.transform("static_int", lambda v: v.cast("double")) if "static_int" in samples.columns \
        else F.array().cast("array<double>")
    return samples.select(
        *keys, _flat("window", parts.window).alias("_w"), _flat("horizon", parts.horizon).alias("_h"),
        statics.alias("_s"), onehot.alias("_i"), *extra)


def _run(rows: DataFrame, parts: Parts, scaling: Scaling, factory: Factory, apply) -> DataFrame:
    kept = [f for f in rows.schema if f.name not in ("_w", "_h", "_s", "_i")]
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", `_pred` array<double>"
    names = [f.name for f in kept]
    scales = {n: scaling.arrays(getattr(parts, n)) for n in ("window", "horizon", "pred", "static")}

    def score(batches):
        predictor = factory()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            scaled = lambda col, n: (
                (_tensor(batch, col, len(getattr(parts, n))) - scales[n][0]) / scales[n][1]
                if len(getattr(parts, n)) else np.zeros((batch.num_rows, 0, 0)))
            w, h = scaled("_w", "window"), scaled("_h", "horizon")
            s = scaled("_s", "static").reshape(batch.num_rows, -1)
            onehot = batch.column("_i").flatten().to_numpy(zero_copy_only=False)
            i = onehot.reshape(batch.num_rows, -1) if len(onehot) else np.zeros((batch.num_rows, 0))
            out = apply(predictor, w, h, s, i) * scales["pred"][1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [_lists(out)], names=names + ["_pred"])

    return rows.mapInArrow(score, out_schema)


def score_samples(samples: DataFrame, factory: Factory, keys: Sequence[str], parts: Parts,
                  scaling: Scaling = Scaling(), carry: Sequence[str] = ()) -> DataFrame:
    """Predicted increments and the initial state of each sample, in data units.

    `pred_res` has one struct per predicted step; `init_state` is the first label, the last observed state.
    Columns in `carry` (labels, times) pass through, which saves a join when they are needed again.
    """
    initial = F.get(F.col("pred"), F.lit(0))
    state = F.array(*[initial[f].cast("double") for f in parts.pred]).alias("init_state")
    rows = _inputs(samples, keys, parts, [state, *map(F.col, carry)])
    scored = _run(rows, parts, scaling, factory, lambda p, w, h, s, i: p(w, h, s, i))
    n = len(parts.pred)
    steps = F.sequence(F.lit(0), F.floor(F.size("_pred") / F.lit(n)).cast("int") - 1)
    res = F.transform(steps, lambda k: F.struct(*[
        F.get(F.col("_pred"), k * n + j).alias(f) for j, f in enumerate(parts.pred)]))
    first = F.struct(*[F.get(F.col("init_state"), F.lit(j)).alias(f) for j, f in enumerate(parts.pred)])
    return scored.select(*keys, *carry, res.alias("pred_res"), first.alias("init_state"))


def predictions_long(scored: DataFrame, keys: Sequence[str], feats: Sequence[str]) -> DataFrame:
    """(keys, step, feat, pred_res, init_state) rows, steps counted from 1."""
    rows = scored.select(*keys, "init_state", F.posexplode("pred_res").alias("_p", "_e"))
    items = F.array(*[F.struct(F.lit(f).alias("feat"), F.col(f"_e.{f}").alias("pred_res"),
                               F.col(f"init_state.{f}").alias("init_state")) for f in feats])
    return rows.select(*keys, (F.col("_p") + 1).alias("step"), F.explode(items).alias("_x")).select(
        *keys, "step", "_x.*")


def coarsened(factory: Factory, c: int, how: str = "mean") -> Factory:
    """A predictor of c-step increments: it sees the horizon reduced to one step in c."""
    reduce = {"mean": np.mean, "min": np.min, "max": np.max}[how]

    def make():
        predictor = factory()

        def predict(w, h, s, i):
            if h.shape[1] % c:
                raise ValueError(f"a horizon of {h.shape[1]} steps is not divisible by {c}")
            return predictor(w, reduce(h.reshape(h.shape[0], -1, c, h.shape[2]), axis=2), s, i)
        return predict
    return make


def scored_long(scored: DataFrame, keys: Sequence[str], feats: Sequence[str], window: int, inputs: Sequence[str] = (),
                coarseness: int = 1, reduce: str = "mean") -> DataFrame:
    """(keys, step, t, feat, true_prev, true_state, pred_res) rows of scored samples that carry `pred` and `time`.

    Label i + 1 is the state after step i; label 0 is the last observed one. `inputs` are features of the carried `horizon`
    that go along with their step. With a coarseness c, predicted step k spans the fine steps up to c * k: labels are the
    states at its ends, its time is that of its last fine step, and inputs are reduced over it (mean, min or max).
    """
    if reduce not in ("mean", "min", "max"):
        raise ValueError("reduce must be mean, min or max")
    n, c = F.size("pred_res"), coarseness
    def every(column, first):
        if c == 1:
            return F.slice(column, F.lit(first + 1), n)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(F.col(column), k * c + first))
    def over(k, f):
        fine = F.slice("horizon", k * c + 1, c)
        if reduce == "mean":
            return F.aggregate(fine, F.lit(0.0), lambda a, h: a + h[f].cast("double")) / c
        pick = F.array_min if reduce == "min" else F.array_max
        return pick(F.transform(fine, lambda h: h[f].cast("double")))
    ahead = []
    if inputs and c == 1:
        ahead = [F.slice("horizon", F.lit(1), n).alias("h")]
    elif inputs:
        ahead = [F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(*[over(k, f).alias(f) for f in inputs])).alias("h")]
    rows = F.arrays_zip(F.col("pred_res").alias("p"), every("pred", 0).alias("a"), every("pred", c).alias("b"),
                        every("time", window + c - 1).alias("t"), *ahead)
    steps = scored.select(*keys, F.posexplode(rows).alias("_k", "_r"))
    items = F.array(*[F.struct(
        F.lit(f).alias("feat"), F.col(f"_r.a.{f}").alias("true_prev"), F.col(f"_r.b.{f}").alias("true_state"),
        F.col(f"_r.p.{f}").alias("pred_res")) for f in feats])
    forcing = [F.col(f"_r.h.{f}").alias(f) for f in inputs]
    return steps.select(*keys, (F.col("_k") + 1).alias("step"), F.col("_r.t").alias("t"), *forcing, F.explode(items).alias("_x")
                        ).select(*keys, "step", "t", *inputs, "_x.*")


def score_grid(df: DataFrame, factory: Factory, parts: Parts, window: int, horizon: int, frequency: int, first: int,
               final: int | None = None, scaling: Scaling = Scaling(), static: DataFrame | None = None,
               static_int: Mapping[str, int] | None = None, keys: Sequence[str] = ("y", "x"), step: str = "step",
               t: str = "t") -> DataFrame:
    """Score every pixel at common init times; long form. Pixels spread over tasks by (pixel, init time)."""
    from .samples import SampleSpec, grid_sample_rows, to_arrays
    spec = SampleSpec(window, horizon, parts.window, parts.horizon, parts.pred, parts.static, static_int or {})
    rows = grid_sample_rows(df, window, horizon, frequency, first, final, keys, step)
    rows = rows.withColumn("pos", F.col("lead") + F.lit(window - 1))
    samples = to_arrays(rows, spec, [*keys, "init"], static, keys, t)
    scored = score_samples(samples, factory, [*keys, "init"], parts, scaling)
    return predictions_long(scored, [*keys, "init"], parts.pred)


def rolling_forecast(samples: DataFrame, factory: Factory, steps: int, keys: Sequence[str], parts: Parts,
                     scaling: Scaling = Scaling()) -> DataFrame:
    """Forecast `steps` steps with a one-step predictor that is fed its own output.

    The one-step predictor maps (window, next horizon step [B, 1, Fh], static, static_int) to states [B, 1, Fp].
    The window's features are the horizon's followed by the predicted ones; each step appends one row and
    drops the oldest. The loop is over steps, each of them for a whole batch of samples.
    """
    if tuple(parts.window) != (*parts.horizon, *parts.pred):
        raise ValueError("window features must be the horizon features followed by the predicted ones")
    mean, _ = scaling.arrays(parts.pred)

    def roll(one_step, w, h, s, i):
        states = []
        for k in range(steps):
            forcing = h[:, k:k + 1]
            state = one_step(w, forcing, s, i)
            states.append(state)
            w = np.concatenate([w[:, 1:], np.concatenate([forcing, state], axis=-1)], axis=1)
        return np.concatenate(states, axis=1)

    scored = _run(_inputs(samples, keys, parts), parts, scaling, factory, roll)
    n = len(parts.pred)
    rows = scored.select(*keys, F.posexplode("_pred").alias("_k", "_v"))
    names = F.array(*[F.lit(f) for f in parts.pred])
    means = F.array(*[F.lit(float(m)) for m in mean])
    which = F.pmod("_k", F.lit(n))
    return rows.select(
        *keys, (F.floor(F.col("_k") / F.lit(n)) + 1).cast("int").alias("step"), F.get(names, which).alias("feat"),
        (F.col("_v") + F.get(means, which)).alias("pred_state"))


# --- predictors -----------------------------------------------------------------------------------

def persistence(features: int) -> Factory:
    """No change: all increments are zero."""
    return lambda: lambda w, h, s, i: np.zeros((w.shape[0], h.shape[1], features))


def damped_trend(columns: Sequence[int], damping: float = 0.5) -> Factory:
    """The last observed increment, damped by a constant factor each step; `columns` are window positions."""
    def make():
        def predict(w, h, s, i):
            last = w[:, -1][:, columns] - w[:, -2][:, columns]
            factors = damping ** np.arange(1, h.shape[1] + 1)
            return last[:, None, :] * factors[None, :, None]
        return predict
    return make


def onnx_model(path: str, batch: int = 1024) -> Factory:
    """An ONNX model with inputs window, horizon, static and static_int; opened once per partition.

    Inputs the model does not declare are not passed. `path` must be readable on every executor.
    """
    def make():
        import onnxruntime
        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        declared = {x.name for x in session.get_inputs()}

        def predict(w, h, s, i):
            outs = []
            for k in range(0, w.shape[0], batch):
                feed = {"window": w, "horizon": h, "static": s, "static_int": i}
                feed = {n: v[k:k + batch].astype(np.float32) for n, v in feed.items() if n in declared}
                outs.append(session.run(None, feed)[0])
            return np.concatenate(outs).astype(float)
        return predict
    return make
