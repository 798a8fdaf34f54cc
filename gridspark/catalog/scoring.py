"""Batch scoring, rolling forecasts, user expressions and aggregates, and streamed partials."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import samples as S
from ..operators import scoring as C
from ..operators import verification as V
from ..sources.sinks import scratch_dir
from ..streaming import partials as P
from .registry import DYNAMIC, ERRORS, SCORED, bin_sql, query, r6, settled, with_views

_PARTS = C.Parts(window=["tmp", "soilm_10", "soilm_40"], horizon=["tmp"], pred=["soilm_10", "soilm_40"])
_TREND = """
, d AS (SELECT y, x, step, soilm_10 - lag(soilm_10) OVER w AS d10, soilm_40 - lag(soilm_40) OVER w AS d40 FROM fx_dynamic
        WINDOW w AS (PARTITION BY y, x ORDER BY step)),
s AS (SELECT d.y, d.x, CAST((d.step - 5) // 24 AS INT) AS init, d10, d40, n FROM d JOIN (
        SELECT y, x, max(step) AS n FROM fx_dynamic GROUP BY 1, 2) m USING (y, x) WHERE d.step >= 5 AND (d.step - 5) % 24 = 0),
p AS (SELECT y, x, init, k AS step, d10 * pow(0.5, k) AS r10, d40 * pow(0.5, k) AS r40 FROM s,
        (SELECT CAST(range AS INT) AS k FROM range(1, 25)) r WHERE 5 + init * 24 + 24 <= n)"""


@query("j1_user_expressions", with_views(DYNAMIC, body="""
SELECT y, x, step, round(tmp - 273.15, 6) AS celsius, round(CASE WHEN apcp > 0 THEN soilm_10 / apcp END, 6) AS wetness
FROM fx_dynamic WHERE soilm_10 + soilm_40 > 60 AND tmp BETWEEN 260 AND 310"""))
def user_expressions(spark, sf):
    from ..functions.features import derive_feats
    from ..operators.selection import filter_static_all
    rows = filter_static_all(fx.dynamic(spark, sf), ["soilm_10 + soilm_40 > 60", "tmp BETWEEN 260 AND 310"])
    out = derive_feats(rows, {"celsius": "tmp - 273.15D", "wetness": "CASE WHEN apcp > 0 THEN soilm_10 / apcp END"})
    return out.select("y", "x", "step", *r6("celsius", "wetness"))


@query("j2_user_aggregates", with_views(ERRORS, body="""
SELECT y, feat, count(*) AS n_drift, round(avg(err_state * step), 5) AS mean_drift, round(var_pop(err_state * step), 3) AS var_drift
FROM fx_err GROUP BY 1, 2"""))
def user_aggregates(spark, sf):
    m = V.Moments(["y", "feat"], {"drift": F.expr("err_state * step")})
    parts = V.Moments(["y", "x", "feat"], m.measures).partial(fx.errors(spark, sf))
    out = m.finish(m.merge(parts))
    return out.select("y", "feat", "n_drift", settled("mean_drift", 5).alias("mean_drift"),
                      settled("var_drift", 3).alias("var_drift"))


@query("j3_table_generators", with_views(SCORED, body="""
SELECT y, x, init, CAST(step - 1 AS INT) AS pos, round(tmp, 6) AS tmp FROM fx_scored WHERE feat = 'soilm_10'"""))
def table_generators(spark, sf):
    rows = S.grid_sample_rows(fx.dynamic(spark, sf), 1, 24, 24, first=1).withColumn("pos", F.col("lead"))
    samples = S.to_arrays(rows, S.SampleSpec(1, 24, ["tmp"], ["tmp"], ["soilm_10"]), ["y", "x", "init"])
    return S.to_long(samples, ["y", "x", "init"]).select("y", "x", "init", "pos", *r6("tmp"))


def grid_arrays(spark, sf):
    """Samples of 4 window and 24 horizon steps, one per 24 steps."""
    rows = S.grid_sample_rows(fx.dynamic(spark, sf), 4, 24, 24, first=6).withColumn("pos", F.col("lead") + 3)
    spec = S.SampleSpec(4, 24, _PARTS.window, _PARTS.horizon, _PARTS.pred)
    return S.to_arrays(rows, spec, ["y", "x", "init"])


@query("j4_score_samples", with_views(DYNAMIC, body=_TREND.lstrip() + """
SELECT y, x, init, step, 'soilm_10' AS feat, round(r10, 6) AS pred_res FROM p UNION ALL
SELECT y, x, init, step, 'soilm_40', round(r40, 6) FROM p"""))
def score_samples(spark, sf):
    keys = ["y", "x", "init"]
    scaling = C.Scaling({"tmp": (285.0, 5.0), "soilm_10": (24.0, 2.5), "soilm_40": (73.0, 4.0)})
    scored = C.score_samples(grid_arrays(spark, sf), C.damped_trend([1, 2], 0.5), keys, _PARTS, scaling)
    return C.predictions_long(scored, keys, _PARTS.pred).select(*keys, "step", "feat", *r6("pred_res"))


@query("j5_score_grid", with_views(SCORED, body="""
SELECT y, x, init, step, feat, CAST(0 AS DOUBLE) AS pred_res,
  round(first_value(true_prev) OVER (PARTITION BY y, x, init, feat ORDER BY step), 6) AS init_state FROM fx_scored"""))
def score_grid(spark, sf):
    parts = C.Parts(window=["tmp"], horizon=["tmp"], pred=["soilm_10", "soilm_40"])
    out = C.score_grid(fx.dynamic(spark, sf), C.persistence(2), parts, 1, 24, 24, first=1)
    return out.select("y", "x", "init", "step", "feat", "pred_res", *r6("init_state"))


@query("j6_rolling_forecast", with_views(DYNAMIC, body="""
, s AS (SELECT y, x, CAST((step - 5) // 24 AS INT) AS init, lag(soilm_10) OVER w AS a, soilm_10 AS b, step,
          max(step) OVER (PARTITION BY y, x) AS n FROM fx_dynamic WINDOW w AS (PARTITION BY y, x ORDER BY step)),
k AS (SELECT y, x, init, a, b FROM s WHERE step >= 5 AND (step - 5) % 24 = 0 AND step + 24 <= n)
SELECT y, x, init, step, 'soilm_10' AS feat, round(a + 2 / 3e0 * (b - a) * (1 - pow(-0.5e0, step + 1)), 5) AS pred_state
FROM k, (SELECT CAST(range AS INT) AS step FROM range(1, 13)) r""".lstrip()))
def rolling_forecast(spark, sf):
    def relaxing_step():
        """One-step predictor: the mean of the window's last two states."""
        return lambda w, h, s, i: w[:, -2:, 1:].mean(axis=1, keepdims=True)

    parts = C.Parts(window=["tmp", "soilm_10"], horizon=["tmp"], pred=["soilm_10"])
    keys = ["y", "x", "init"]
    out = C.rolling_forecast(grid_arrays(spark, sf), relaxing_step, 12, keys, parts,
                             C.Scaling({"soilm_10": (24.0, 2.5), "tmp": (285.0, 5.0)}))
    return out.select(*keys, "step", "feat", settled("pred_state", 5).alias("pred_state"))


# --- streams --------------------------------------------------------------------------------------

def scored_stream(spark, sf):
    """Events as a file stream of scored rows: the value is the error, the hour of the day the step."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    t = F.col("ts").cast("timestamp")
    return events.select(F.hour(t).alias("step"), F.col("event_type").alias("feat"),
                         (F.col("value") - 20).alias("err_state"), (F.col("value") / 10).alias("err_res"), t.alias("t"))


_STREAM_SQL = """
SELECT CAST(hour(ts) AS INT) AS step, event_type AS feat, count(*) AS n_state, round(avg(abs(value - 20)), 6) AS mean_state,
  round(var_pop(abs(value - 20)), 4) AS var_state, round(avg(abs(value / 10)), 6) AS mean_res FROM events GROUP BY 1, 2"""


def _streamed(df):
    return df.select("step", "feat", "n_state", *r6("mean_state"), settled("var_state", 4).alias("var_state"),
                     *r6("mean_res"))


@query("i1_stream_error_partials", _STREAM_SQL)
def stream_error_partials(spark, sf):
    m = V.horizon_moments()
    path, checkpoint = scratch_dir(spark, "snapshots"), scratch_dir(spark, "stream-state")
    P.write_snapshots(P.stream_error_partials(scored_stream(spark, sf), m), path, checkpoint).awaitTermination()
    return _streamed(m.finish(P.latest_snapshot(spark, path)))


@query("i2_stream_merge", _STREAM_SQL)
def stream_merge(spark, sf):
    m = V.horizon_moments()
    path, checkpoint = scratch_dir(spark, "batches"), scratch_dir(spark, "stream-log")
    P.stream_merge(scored_stream(spark, sf), m, path, checkpoint).awaitTermination()
    return _streamed(m.finish(P.merged_partials(spark, path, m)))


_TIME_SQL = """
WITH k AS (SELECT event_type AS feat, hour(ts + INTERVAL 30 MINUTE) AS h, dayofyear(ts) - 1 AS d, value - 20 AS s, value / 10 AS r FROM events)
SELECT 'hour' AS axis, CAST(h AS INT) AS bin, feat, round(sum(s), 3) AS sum_state, round(sum(r), 3) AS sum_res, count(*) AS n FROM k GROUP BY h, feat
UNION ALL SELECT 'day', CAST(d AS INT), feat, round(sum(s), 3), round(sum(r), 3), count(*) FROM k GROUP BY d, feat"""
_AXES = (("err_state", -20.0, 60.0, 8), ("step", 0.0, 24.0, 6))
_HIST_SQL = f"""
WITH k AS (SELECT event_type AS feat, value - 20 AS err_state, value / 10 AS err_res, hour(ts) AS step FROM events)
SELECT feat, {bin_sql(*_AXES[0])} AS b1, {bin_sql(*_AXES[1])} AS b2, count(*) AS n, round(sum(err_res), 3) AS cov_sum FROM k
WHERE err_state IS NOT NULL GROUP BY 1, 2, 3"""


def _running(spark, sf, tally):
    path, checkpoint = scratch_dir(spark, "snapshots"), scratch_dir(spark, "stream-state")
    P.write_snapshots(P.stream_error_partials(scored_stream(spark, sf), tally), path, checkpoint).awaitTermination()
    return tally.finish(P.latest_snapshot(spark, path))


def _merged(spark, sf, tally):
    path, checkpoint = scratch_dir(spark, "batches"), scratch_dir(spark, "stream-log")
    P.stream_merge(scored_stream(spark, sf), tally, path, checkpoint).awaitTermination()
    return tally.finish(P.merged_partials(spark, path, tally))


def _timed(df):
    return df.select("axis", "bin", "feat", settled("sum_state", 3).alias("sum_state"), settled("sum_res", 3).alias("sum_res"), "n")


def _binned(df):
    return df.select("feat", "b1", "b2", "n", settled("sum_cov", 3).alias("cov_sum"))


def _histogram():
    return V.histogram_tally(*_AXES, covariate="err_res", by=["feat"])


@query("i1_stream_error_by_time", _TIME_SQL)
def stream_error_by_time(spark, sf):
    return _timed(_running(spark, sf, V.time_tally()))


@query("i1_stream_histogram", _HIST_SQL)
def stream_histogram(spark, sf):
    return _binned(_running(spark, sf, _histogram()))


@query("i2_stream_merge_by_time", _TIME_SQL)
def stream_merge_by_time(spark, sf):
    return _timed(_merged(spark, sf, V.time_tally()))


@query("i2_stream_merge_histogram", _HIST_SQL)
def stream_merge_histogram(spark, sf):
    return _binned(_merged(spark, sf, _histogram()))
